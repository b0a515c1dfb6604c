"""Fits and their quality: exponents of ice and waves, ranking, calibration, feature preparation.

Everything is one aggregation over the samples; parameters are exploded from a literal list of stated size.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import clip
from .density import with_grid_values


def _with_exponents(samples: DataFrame, ps: list[float], qs: list[float]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(float(p)).alias("p"), F.lit(float(q)).alias("q")) for p, q in product(ps, qs)))
    usable = samples.filter("sic is not null and wave is not null and y is not null")
    rows = usable.withColumn("e", F.explode(pairs)).select("*", "e.p", "e.q").drop("e")
    return rows.withColumns({"x1": F.pow("sic", "p"), "x2": F.pow("wave", "q")})


def _least_squares(rows: DataFrame, *keys: str) -> DataFrame:
    """Intercept and two slopes per key, from variances and covariances; NULL where the regressors are collinear."""
    s = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("x1").alias("m1"), F.avg("x2").alias("m2"), F.avg("y").alias("my"),
        F.var_pop("x1").alias("s11"), F.var_pop("x2").alias("s22"), F.var_pop("y").alias("syy"),
        F.covar_pop("x1", "x2").alias("s12"), F.covar_pop("x1", "y").alias("s1y"), F.covar_pop("x2", "y").alias("s2y"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    det = F.when(det > 1e-15, det)
    b1 = (F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12")) / det
    b2 = (F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12")) / det
    fitted = s.withColumns({"b1": b1, "b2": b2})
    rest = F.col("syy") - F.col("b1") * F.col("s1y") - F.col("b2") * F.col("s2y")
    return fitted.select(*keys, "n", (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"), "b1", "b2", F.when(rest.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), rest))).alias("rmse"))


def exponent_errors(samples: DataFrame, ps: list[float], qs: list[float]) -> DataFrame:
    """Root mean square error of y on sic^p and wave^q, for every pair of exponents."""
    return _least_squares(_with_exponents(samples, ps, qs), "p", "q")


def best_exponents(samples: DataFrame, ps: list[float], qs: list[float]) -> DataFrame:
    """The pair of the least error; smaller exponents win a tie, errors alike to nine places tie."""
    e = exponent_errors(samples, ps, qs).filter("rmse is not null")
    return e.agg(F.min_by(F.struct("p", "q", F.round("rmse", 9).alias("rmse")), F.struct(F.round("rmse", 9), "p", "q")).alias("x")).filter("x is not null").select("x.*")


def refined_exponents(samples: DataFrame, ps: list[float], qs: list[float], step: float, reach: int = 2) -> DataFrame:
    """A second search around the best of a coarse one (A20); the coarse best is one row."""
    best = best_exponents(samples, ps, qs).collect()
    if not best:
        return best_exponents(samples, ps, qs)
    around = lambda x: [round(x + k * step, 6) for k in range(-reach, reach + 1) if x + k * step > 0]
    return best_exponents(samples, around(best[0]["p"]), around(best[0]["q"]))


def held_out_fit(samples: DataFrame, p: float, q: float, held_out: Column) -> DataFrame:
    """Fit on the rest, error and R2 on the held-out rows (A21): one row; a split without spread has no R2."""
    rows = _with_exponents(samples, [p], [q]).withColumn("_held", held_out)
    fit = _least_squares(rows.filter("not _held"), "p", "q").select("b0", "b1", "b2", F.col("rmse").alias("train_rmse"))
    rest = rows.filter("_held").crossJoin(F.broadcast(fit))  # the fit is one row
    off = F.pow(F.col("y") - F.col("b0") - F.col("b1") * F.col("x1") - F.col("b2") * F.col("x2"), 2)
    out = rest.groupBy("b0", "b1", "b2", "train_rmse").agg(F.avg(off).alias("mse"), F.var_pop("y").alias("spread"))
    return out.select("b0", "b1", "b2", "train_rmse", F.sqrt("mse").alias("holdout_rmse"), F.when(F.col("spread") > 0, 1 - F.col("mse") / F.col("spread")).alias("holdout_r2"))


def ranking_quality(scored: DataFrame, buckets: int = 1024) -> DataFrame:
    """Exact area under the ROC curve and log loss of scores in 0..1 against labels 0/1 (A22): one row.

    Equal scores count half.  Negatives below a score are counted in two steps, whole buckets of scores first
    and then within a bucket, so that no window holds all rows.
    """
    rows = scored.filter("score is not null and label is not null")
    by_score = rows.groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    by_score = by_score.withColumn("b", F.floor(F.col("score") * buckets))
    w = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    below = by_score.groupBy("b").agg(F.sum("neg").alias("n")).select("b", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("below"))  # one row a bucket
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = by_score.withColumn("inside", inside).join(F.broadcast(below), "b")
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("inside") + F.col("neg") / 2))
    auc = pairs.agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), wins / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"))
    p = clip(F.col("score"), 1e-15, 1 - 1e-15)
    loss = rows.agg(F.avg(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))
    return auc.crossJoin(F.broadcast(loss))  # one row each


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Rows, mean score and share of label 1 in each bin of the score."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins)).cast("long")
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("share"), F.sum(F.pow(F.col("score") - F.col("label"), 2)).alias("squares"))


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score (A36): one row."""
    r = reliability(scored, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("share"))) / F.sum("n")).alias("ece"), (F.sum("squares") / F.sum("n")).alias("brier"))


def split_by_id(rows: DataFrame, column: str, every: int = 5) -> DataFrame:
    """Marks one row in ``every`` as held out, by its id: the same rows at each run."""
    return rows.withColumn("held_out", F.col(column) % every == 0)


def prepared_features(rows: DataFrame, columns: list[str], scale: dict[str, float], bounded: list[str]) -> DataFrame:
    """Scaled, bounded features whose gaps hold the column's mean; a column without any value is 0."""
    made = rows
    for c in columns:
        x = F.col(c) / scale[c] if c in scale else F.col(c).cast("double")
        made = made.withColumn(c, clip(x, 0.0, 1.0) if c in bounded else x)
    means = with_grid_values(made, **{f"_m_{c}": F.avg(c) for c in columns})
    return means.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in columns}).drop(*(f"_m_{c}" for c in columns))


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Complete rows with label 0 or 1, the columns as z-scores; a flat column is 0."""
    whole = rows.filter("label in (0, 1)").dropna(subset=columns)
    made = with_grid_values(whole, **{f"_m_{c}": F.avg(c) for c in columns}, **{f"_s_{c}": F.stddev_pop(c) for c in columns})
    z = {c: F.when(F.col(f"_s_{c}") > 1e-12, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return made.withColumns(z).select(*rows.columns)
