"""Checks of layers and tables: gaps, extremes, resolution, thresholds, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from .density import with_grid_values

# fixed values: warnings of the monthly check
NAN_PERCENT_WARN, SIC_MAX_WARN, COST_MAX_WARN = 30.0, 1.2, 0.3
# fixed values: denominators of the usual grid resolutions
RESOLUTIONS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32)


def month_check(rows: DataFrame, keys: list[str], sic: str = "sic", cost: str = "ice_cost") -> DataFrame:
    """Gaps, extremes and means of ice and cost per key, with three warnings."""
    parts = []
    for name, c in (("sic", sic), ("cost", cost)):
        x = F.when(~F.isnan(c), F.col(c))
        parts += [(100 * F.avg(x.isNull().cast("int"))).alias(f"{name}_nan_pct"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max"), F.avg(x).alias(f"{name}_mean")]
    s = rows.groupBy(*keys).agg(*parts)
    warn = lambda c: F.coalesce(c, F.lit(False))
    return s.withColumns({
        "warn_gaps": warn(F.col("sic_nan_pct") > NAN_PERCENT_WARN),
        "warn_sic": warn(F.col("sic_max") > SIC_MAX_WARN),
        "warn_cost": warn(F.col("cost_max") < COST_MAX_WARN),
    })


def gap_shares(rows: DataFrame, time: str, column: str) -> DataFrame:
    """Share of gaps at the first, middle and last time (A26): one row.  Times are few against cells."""
    x = F.when(~F.isnan(column), F.col(column))
    per = rows.groupBy(time).agg(F.avg(x.isNull().cast("int")).alias("gaps"))
    w = Window.partitionBy(F.lit(0))
    ranked = per.withColumns({"r": F.row_number().over(w.orderBy(time)) - 1, "n": F.count("*").over(w)})
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("gaps")))
    return ranked.agg(at(F.lit(0)).alias("first"), at(F.expr("n div 2")).alias("middle"), at(F.col("n") - 1).alias("last"))


def resolution(axis: DataFrame, column: str) -> DataFrame:
    """Median step of an axis, and the usual fraction near it: within 0.01 degrees or 5 % (A28): one row."""
    values = axis.select(F.col(column).alias("x")).distinct()
    step = values.select(F.abs(F.col("x") - F.lag("x").over(Window.partitionBy(F.lit(0)).orderBy("x"))).alias("d"))  # an axis, not a grid
    one = step.agg(F.percentile("d", 0.5).alias("step"))
    near = F.array_min(F.array(*(F.struct(F.abs(F.col("step") - 1.0 / k).alias("off"), F.lit(k).alias("k")) for k in RESOLUTIONS)))
    fits = (near["off"] <= 0.01) | (near["off"] / F.greatest(F.col("step"), F.lit(1e-9)) <= 0.05)
    return one.select("step", F.when(fits, near["k"]).alias("denominator"))


def otsu(cells: DataFrame, column: str, bins: int = 256, most_gaps: float = 0.3) -> DataFrame:
    """Threshold between the two classes of a layer, or why there is none: flat_field, too_many_nan (C36): one row.

    The layer is counted into ``bins`` bins; the threshold is the middle of the bin after which the variance
    between the classes is largest, the first on a tie.
    """
    x = F.when(~F.isnan(column), F.col(column))
    facts = cells.agg(F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x.isNull().cast("int")).alias("gaps"))
    width = (F.col("high") - F.col("low")) / bins
    binned = cells.select(x.alias("x")).filter("x is not null").crossJoin(F.broadcast(facts)).filter("high > low")  # one row of facts
    counts = binned.groupBy(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / width)).alias("b"), "low", "high").agg(F.count("*").alias("n"))
    everything = counts.select(F.lit(0).alias("k"), "b", "n", (F.col("low") + (F.col("b") + 0.5) * width).alias("mid"))
    w = Window.partitionBy("k").orderBy("b")  # at most `bins` rows
    sums = everything.withColumns({"n1": F.sum("n").over(w), "s1": F.sum(F.col("n") * F.col("mid")).over(w), "n0": F.sum("n").over(Window.partitionBy("k")), "s0": F.sum(F.col("n") * F.col("mid")).over(Window.partitionBy("k"))})
    n2 = F.col("n0") - F.col("n1")
    apart = F.when(n2 > 0, F.col("n1") * n2 * F.pow(F.col("s1") / F.col("n1") - (F.col("s0") - F.col("s1")) / n2, 2))
    best = sums.withColumn("v", F.round(apart, 3)).agg(F.max_by("mid", F.struct("v", -F.col("b"))).alias("mid"), F.max("v").alias("v"))
    out = facts.crossJoin(F.broadcast(best))
    reason = F.when(F.col("low").isNull() | (F.col("gaps") > most_gaps), "too_many_nan").when(F.col("high") <= F.col("low"), "flat_field").otherwise("ok")
    return out.select(reason.alias("reason"), F.when(reason == "ok", F.col("mid")).alias("threshold"))


def mostly_missing(cells: DataFrame, column: str, least: float = 0.001) -> DataFrame:
    """A layer with next to no values counts as missing altogether."""
    x = finite(column)
    share = with_grid_values(cells, _share=F.avg(x.isNotNull().cast("int")))
    return share.withColumn(column, F.when(F.col("_share") >= least, x)).drop("_share")


def rescaled_if_large(cells: DataFrame, column: str) -> DataFrame:
    """Divided by the maximum where that is over one."""
    top = with_grid_values(cells, _top=F.max(finite(column)))
    return top.withColumn(column, F.when(F.col("_top") > 1, F.col(column) / F.col("_top")).otherwise(F.col(column))).drop("_top")


def label_balance(rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows and mean of each feature per label."""
    return rows.groupBy("label").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in features))


def moments(surfaces: DataFrame, column: str) -> DataFrame:
    """Mean and variance of a field at each cell over its surfaces."""
    return surfaces.groupBy("i", "j").agg(F.avg(column).alias("mean"), F.var_pop(column).alias("variance"))


def softmax(columns: list[Column], temperature: float) -> list[Column]:
    """Shares of experts, more alike the hotter."""
    top = F.greatest(*columns)
    e = [F.exp((c - top) / temperature) for c in columns]
    whole = e[0]
    for x in e[1:]:
        whole = whole + x
    return [x / whole for x in e]
