"""Logistic regressions over powers of ice and waves, very many at once, and how well they rank.

Samples become rows of features, label, and weights: how much a row counts in each variant of a fit (all rows,
all but one block of latitudes, one resample) and in its test.  Rows alike in features and label are added
up first.  A Newton step of all models is one pass: tasks add the gradient and the normal equations of every model over
their rows, Spark adds the tasks, and the driver solves one small system for each model, at most ``MODELS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import clip
from ..functions.numbers import finite
from ..sources.scratch import Written
from .selection import quantiles

MODELS = 100_000
STEPS = 60
DIGITS = 12  # decimals to which scores count as equal
BUCKETS = 512


@dataclass(frozen=True)
class Fits:
    """Coefficients (exponents, variants, features), mean loss and ends of the scores of each model."""

    exponents: list[tuple[float, float]]
    others: tuple[str, ...]
    beta: np.ndarray
    loss: np.ndarray
    low: np.ndarray
    high: np.ndarray


def weighted(samples: DataFrame, others: tuple[str, ...], train: list[Column], test: list[Column]) -> DataFrame:
    """sic and wave within their bounds, ``others``, label, and arrays of the weights; incomplete rows go."""
    features = [clip(finite("sic"), 0.0, 1.0).alias("sic"), clip(finite("wave"), 0.0, 10.0).alias("wave"), *(finite(c).alias(c) for c in others)]
    rows = samples.filter("label in (0, 1)").select(*features, F.col("label").cast("int"), *(x.cast("double").alias(f"_{n}{k}") for n, part in (("a", train), ("b", test)) for k, x in enumerate(part)))
    added = [F.array(*(F.sum(f"_{n}{k}") for k in range(len(part)))).alias(name) for n, name, part in (("a", "train", train), ("b", "test", test))]
    return rows.dropna(subset=["sic", "wave", *others]).groupBy("sic", "wave", *others, "label").agg(*added)


def _designs(batch: pa.RecordBatch, exponents: list[tuple[float, float]], others: tuple[str, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """Features of the rows of a batch under each pair of exponents."""
    column = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("sic", "wave", *others)}
    ice, waves = ({e: column[n] ** e for e in {x[k] for x in exponents}} for k, n in ((0, "sic"), (1, "wave")))
    rest = [column[n] for n in others]
    for k, (p, q) in enumerate(exponents):
        yield k, np.stack([np.ones(batch.num_rows), ice[p], waves[q], *rest], axis=1)


def _arrays(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _scores(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """(rows, variants), term by term, so that a row has the same score in whatever batch it comes."""
    z = np.zeros((len(x), len(beta)))
    for k in range(x.shape[1]):
        z += x[:, k : k + 1] * beta[:, k]
    return np.round(z, DIGITS)


def _pass(rows: DataFrame, exponents: list[tuple[float, float]], others: tuple[str, ...], beta: np.ndarray) -> dict[str, np.ndarray]:
    """Loss, gradient, normal equations and ends of the scores of all models at ``beta``."""
    _, variants, d = beta.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(exponents), variants, 1 + d + d * d))
        ends = np.full((2, len(exponents), variants), np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, w = batch.column("label").to_numpy(zero_copy_only=False)[:, None], _arrays(batch, "train")
            for k, x in _designs(batch, exponents, others):
                z = _scores(x, beta[k])
                m = 1 / (1 + np.exp(-z))
                outer = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                sums[k, :, 0] += (w * (np.logaddexp(0, z) - y * z)).sum(axis=0)
                sums[k, :, 1 : 1 + d] += (x.T @ (w * (y - m))).T
                sums[k, :, 1 + d :] += (outer.T @ (w * m * (1 - m))).T
                ends[0, k], ends[1, k] = np.minimum(ends[0, k], z.min(axis=0)), np.minimum(ends[1, k], -z.max(axis=0))
        model = np.arange(len(exponents) * variants)
        yield pa.RecordBatch.from_arrays([pa.array(model, pa.int32()), pa.array(list(sums.reshape(len(model), -1)), pa.list_(pa.float64())), pa.array(ends[0].ravel()), pa.array(ends[1].ravel())], names=["model", "sums", "low", "high"])

    size = 1 + d + d * d
    parts = rows.mapInArrow(run, "model int, sums array<double>, low double, high double")
    total = parts.groupBy("model").agg(F.array(*(F.sum(F.col("sums")[k]) for k in range(size))).alias("sums"), F.min("low").alias("low"), F.min("high").alias("high"))
    got = sorted(total.collect(), key=lambda r: r["model"])  # one row a model
    flat = np.array([r["sums"] for r in got]) if got else np.zeros((len(exponents) * variants, size))
    ends = np.array([[r["low"], -r["high"]] for r in got]) if got else np.zeros((len(flat), 2))
    shape = (len(exponents), variants)
    return {"loss": flat[:, 0].reshape(shape), "gradient": flat[:, 1 : 1 + d].reshape(*shape, d), "normal": flat[:, 1 + d :].reshape(*shape, d, d), "low": ends[:, 0].reshape(shape), "high": ends[:, 1].reshape(shape)}


def fit(rows: DataFrame, exponents: list[tuple[float, float]], others: tuple[str, ...] = (), ridge: float = 1.0, tolerance: float = 1e-9) -> Fits:
    """Newton fits of all pairs of exponents and variants, the slopes held by ``ridge``; steps that raise the loss are halved."""
    first = rows.select(F.size("train").alias("n")).first()
    variants, d = first["n"] if first else 1, 3 + len(others)
    if len(exponents) * variants > MODELS:
        raise ValueError(f"more than {MODELS} models")
    held = ridge * np.diag([0.0] + [1.0] * (d - 1))
    best = beta = np.zeros((len(exponents), variants, d))
    least = np.full(beta.shape[:2], np.inf)
    step = np.zeros_like(beta)
    for _ in range(STEPS):
        s = _pass(rows, exponents, others, beta)
        value = s["loss"] + ridge / 2 * (beta[..., 1:] ** 2).sum(axis=-1)
        good = value <= least + 1e-9 * (1 + np.abs(least, where=np.isfinite(least), out=np.zeros_like(least)))
        least, best = np.where(good, value, least), np.where(good[..., None], beta, best)
        newton = np.linalg.solve(s["normal"] + held + 1e-12 * np.eye(d), (s["gradient"] - beta @ held)[..., None])[..., 0]
        step = np.where(good[..., None], newton, step / 2)
        if np.abs(step).max() <= tolerance:
            break
        beta = best + step
    weight = rows.select(F.array(*(F.col("train")[k] for k in range(variants))).alias("w")).agg(*(F.sum(F.col("w")[k]).alias(f"w{k}") for k in range(variants))).first()
    total = np.array([x or np.nan for x in weight])
    return Fits(exponents, others, beta, s["loss"] / total, s["low"], s["high"])


def areas(rows: DataFrame, fits: Fits) -> DataFrame:
    """e, v, auc: exact area under the curve of each pair of exponents and variant over its test rows; equal scores count half.

    Negatives below a row are counted in two steps, whole buckets of a model's scores and then within a bucket, so
    that no window holds all rows of a model.
    """
    exponents, others, beta, low, high = fits.exponents, fits.others, fits.beta, fits.low, fits.high
    span = np.where(high > low, high - low, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y, w = batch.column("label").to_numpy(zero_copy_only=False), _arrays(batch, "test")
            for k, x in _designs(batch, exponents, others):
                z = _scores(x, beta[k])
                b = np.clip(np.floor((z - low[k]) / span[k] * BUCKETS), 0, BUCKETS - 1).astype(np.int32)
                at, v = np.nonzero(w)
                model = np.full(len(v), k, dtype=np.int32)
                weight = w[at, v]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (model, v.astype(np.int32), b[at, v], z[at, v], weight * y[at], weight * (1 - y[at]))], names=["e", "v", "b", "z", "pos", "neg"])

    scored = rows.mapInArrow(run, "e int, v int, b int, z double, pos double, neg double")
    w = Window.partitionBy("e", "v", "b").orderBy("z")
    upto = F.sum("neg").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum("neg").over(w.rangeBetween(Window.currentRow, Window.currentRow))
    buckets = scored.withColumn("won", F.col("pos") * (upto - equal / 2)).groupBy("e", "v", "b").agg(*(F.sum(c).alias(c) for c in ("won", "pos", "neg")))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("e", "v").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # at most BUCKETS rows a model
    won = F.sum(F.col("won") + F.col("pos") * F.col("below"))
    pairs = F.sum("pos") * F.sum("neg")
    return buckets.withColumn("below", below).groupBy("e", "v").agg(F.when(pairs > 0, won / pairs).alias("auc"))


def calibrate(samples: DataFrame, exponents: list[tuple[float, float]], blocks: int = 0, others: tuple[str, ...] = (), ridge: float = 1.0) -> DataFrame:
    """p, q, b0.., auc, log_loss, cv_auc_mean, cv_auc_std, n, n_positive of each pair of exponents.

    Each of ``blocks`` ranges of latitude between neighbouring quantiles, both ends included, is the test of a fit on all rows
    outside it.
    """
    train, test = [F.lit(1.0)], [F.lit(1.0)]
    if blocks:
        given = samples.filter("label in (0, 1)").dropna(subset=["sic", "wave", *others])
        ends = quantiles(given, "lat", [k / blocks for k in range(blocks + 1)])
        for k in range(blocks if ends[0] is not None else 0):
            inside = F.coalesce(F.col("lat").between(ends[k], ends[k + 1]), F.lit(False)).cast("double")
            train.append(1 - inside)
            test.append(inside)
    kept = Written(weighted(samples, others, train, test), "samples")
    fits = fit(kept.table, exponents, others, ridge)
    table = Written(areas(kept.table, fits), "areas")
    counts = kept.table.agg(F.sum(F.col("train")[0]).cast("long").alias("n"), F.sum(F.when(F.col("label") == 1, F.col("train")[0])).cast("long").alias("n_positive")).first()
    kept.drop()
    d = fits.beta.shape[2]
    spark = samples.sparkSession
    names = [f"b{k}" for k in range(d)]
    facts = [(k, float(p), float(q), *map(float, fits.beta[k, 0]), float(fits.loss[k, 0]), counts["n"], counts["n_positive"] or 0) for k, (p, q) in enumerate(exponents)] if counts["n"] else []
    made = spark.createDataFrame(facts, ", ".join(["e int, p double, q double", *(f"{n} double" for n in names), "log_loss double, n long, n_positive long"]))
    one = table.table.groupBy("e").agg(F.max(F.when(F.col("v") == 0, F.col("auc"))).alias("auc"), F.avg(F.when(F.col("v") > 0, F.col("auc"))).alias("cv_auc_mean"), F.stddev_pop(F.when(F.col("v") > 0, F.col("auc"))).alias("cv_auc_std"))
    return made.join(one, "e", "left").select("p", "q", *names, "auc", "log_loss", F.coalesce("cv_auc_mean", "auc").alias("cv_auc_mean"), F.coalesce("cv_auc_std", F.lit(0.0)).alias("cv_auc_std"), "n", "n_positive")


def resampling_weight(key: str, draw: int) -> Column:
    """How often a row is drawn in resample ``draw``: Poisson of mean one, from an MD5 of its key."""
    u = (F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{draw}"))), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32
    weight, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(10):
        total += term
        weight = weight + (u > total).cast("int")
        term /= k + 1
    return weight


def intervals(samples: DataFrame, key: str, p: float, q: float, draws: int = 200, reach: int = 3, step: float = 0.1, share: float = 0.95, ridge: float = 1.0) -> DataFrame:
    """One row: the bounds between which the best exponents around (p, q) fall in ``share`` of the resamples.

    Every resample has its own search over exponents up to ``reach`` steps away within 0.5..3; the largest area wins,
    the smaller exponents on a tie to nine places.
    """
    near = lambda x: sorted({round(min(3.0, max(0.5, x + k * step)), 6) for k in range(-reach, reach + 1)})
    exponents = [(a, b) for a in near(p) for b in near(q)]
    weights = [resampling_weight(key, k) for k in range(draws)]
    kept = Written(weighted(samples, (), weights, weights), "resamples")
    fits = fit(kept.table, exponents, (), ridge)
    spark = samples.sparkSession
    names = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(exponents)], "e int, p double, q double")
    best = areas(kept.table, fits).filter("auc is not null").join(F.broadcast(names), "e").groupBy("v").agg(F.min_by(F.struct("p", "q"), F.struct(-F.round("auc", 9), "p", "q")).alias("x"))
    tail = (1 - share) / 2
    ends = [F.percentile(f"x.{c}", s).alias(f"{c}_{n}") for c in ("p", "q") for n, s in (("low", tail), ("high", 1 - tail))]
    return best.agg(*ends, F.count("*").alias("draws"))  # one value a draw
