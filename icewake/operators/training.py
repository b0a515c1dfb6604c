"""Training tables for the risk models, and small models with weights as data."""

from __future__ import annotations

from math import cos, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite
from .selection import smallest

HIDDEN = (16, 8)


def frame(cells: DataFrame, features: list[str], month: int, vessel_class: int) -> DataFrame:
    """Rows of a training frame: features, a missing layer as NULL, and the month and vessel constants."""
    have = [F.col(c).cast("double").alias(c) if c in cells.columns else F.lit(None).cast("double").alias(c) for c in features]
    return cells.select("i", "j", *have, F.lit(month).alias("month"), F.lit(vessel_class).alias("vessel_class"))


def with_density(cells: DataFrame, density: DataFrame | None) -> DataFrame:
    """``cells`` with the density of (i, j, density), 0 where there is none or no table at all."""
    if density is None:
        return cells.withColumn("density", F.lit(0.0))
    own = density.select("i", "j", F.col("density").alias("_density"))
    return cells.drop("density").join(own, ["i", "j"], "left").withColumn("density", F.coalesce(finite("_density"), F.lit(0.0))).drop("_density")


def sampled_cells(positive: DataFrame, ocean: DataFrame, ratio: float = 3.0, least: int = 100, seed: int = 42) -> DataFrame:
    """Visited ocean cells (label 1) and ``ratio`` times as many others (label 0), at least ``least`` if there are.

    The others are those of smallest draw key, so the draw is the same wherever it runs; the key that bounds them is
    found by counting in ranges of keys (``selection``), and a filter takes them.
    """
    hit = ocean.select("i", "j").join(positive.select("i", "j").distinct(), ["i", "j"], "left_semi").withColumn("label", F.lit(1))
    rest = ocean.select("i", "j").join(positive.select("i", "j").distinct(), ["i", "j"], "left_anti")
    wanted = max(int(hit.count() * ratio), least)
    return hit.union(smallest(rest, ["i", "j"], lambda n: wanted, seed).select("i", "j", F.lit(0).alias("label")))


def export_frame(cells: DataFrame, labels: DataFrame, features: list[str], month: int = 8, day: int = 220, vessel_class: int = 1) -> DataFrame:
    """The training table: features of labelled cells with the constants of the export."""
    return frame(cells, features, month, vessel_class).join(labels.select("i", "j", "label"), ["i", "j"]).withColumn("day", F.lit(day))


def full_export(cells: DataFrame, labels: DataFrame, features: list[str], path: str, month: int = 8, day: int = 220, vessel_class: int = 1) -> DataFrame:
    """Writes the training table as Parquet and reads it back; a missing layer or value is 0."""
    table = export_frame(cells, labels, features, month, day, vessel_class)
    whole = table.withColumns({c: F.coalesce(finite(c), F.lit(0.0)) for c in features})
    whole.write.mode("errorifexists").option("compression", "snappy").parquet(path)
    return cells.sparkSession.read.schema(whole.schema).parquet(path)


def fixed_weights(rows: int, columns: int, layer: int) -> list[list[float]]:
    """An untrained layer: values within the Xavier bound, from a rule in place of a random state."""
    bound = sqrt(6.0 / (rows + columns))
    return [[round(bound * cos(1.0 + 7 * layer + 3 * r + 5 * c), 6) for c in range(columns)] for r in range(rows)]


def dense(inputs: list[Column], layer: int, outputs: int) -> list[Column]:
    """Weighted sums of the inputs, one for each output."""
    w = fixed_weights(len(inputs), outputs, layer)
    return [sum((x * w[r][c] for r, x in enumerate(inputs)), F.lit(0.0)) for c in range(outputs)]


def network_evidence(cells: DataFrame, inputs: list[str]) -> DataFrame:
    """Outputs o0..o2 of the 5-16-8-3 network (M02), layer by layer so that expressions stay small."""
    rows, names = cells, inputs
    for layer, size in enumerate((*HIDDEN, 3)):
        out = dense([F.col(c) for c in names], layer, size)
        last = size == 3
        rows = rows.withColumns({f"{'o' if last else f'h{layer}_'}{k}": x if last else F.greatest(x, F.lit(0.0)) for k, x in enumerate(out)})
        names = [f"h{layer}_{k}" for k in range(size)]
    return rows.select(*cells.columns, "o0", "o1", "o2")


def network_risk(cells: DataFrame, inputs: list[str]) -> DataFrame:
    """Risk, the last class's share of the Dirichlet head, and uncertainty K / S."""
    a = [F.log1p(F.exp(f"o{k}")) + 1.0 for k in range(3)]
    whole = a[0] + a[1] + a[2]
    return network_evidence(cells, inputs).withColumns({"risk": a[2] / whole, "uncertainty": 3.0 / whole}).drop("o0", "o1", "o2")


def small_model(cells: DataFrame, weights: dict[str, tuple[float, float, float]], bias: float) -> DataFrame:
    """Risk of the small two-class model (M04): columns z-scored by (mean, deviation, weight), risk = 1 - p(safe), u = K / S."""
    z = F.lit(bias)
    for c, (mean, deviation, weight) in weights.items():
        z = z + weight * (F.coalesce(finite(c), F.lit(mean)) - mean) / deviation
    safe, risky = F.log1p(F.exp(-z)) + 1.0, F.log1p(F.exp(z)) + 1.0
    return cells.withColumns({"risk": 1.0 - safe / (safe + risky), "uncertainty": 2.0 / (safe + risky)})


def _beta_tail(one: np.ndarray, two: np.ndarray, alpha: float, steps: int) -> np.ndarray:
    """Quantile and tail mean of Beta densities with the exponents ``one`` and ``two``; NaN without them."""
    middle = [(k + 0.5) / steps for k in range(steps)]
    raw = one[:, None] * np.array([log(x) for x in middle]) + two[:, None] * np.array([log(1 - x) for x in middle])
    weight = np.exp(raw - raw.max(axis=1, keepdims=True))
    share = (weight / weight.cumsum(axis=1)[:, -1:])[:, ::-1]  # from the top
    k = np.arange(steps, 0, -1)
    mass, total = share.cumsum(axis=1), (share * (k - 0.5) / steps).cumsum(axis=1)
    last = (mass >= 1 - alpha).argmax(axis=1)[:, None]
    own = lambda x: np.take_along_axis(x, last, axis=1)[:, 0]
    known = ~np.isnan(one)
    return np.stack([np.where(known, (k[last[:, 0]] - 0.5) / steps, np.nan), np.where(known, own(total) / own(mass), np.nan)])


def beta_risk(cells: DataFrame, mean: str, variance: str, alpha: float = 0.9, steps: int = 200) -> DataFrame:
    """Mean, quantile and tail mean (CVaR) of the Beta distribution with this mean and variance.

    The density is summed on a grid of ``steps`` points a cell, for a batch of cells at once, in a fixed order; without variance all three are
    the mean.
    """
    m, v = F.col(mean), F.coalesce(finite(variance), F.lit(0.0))
    n = m * (1 - m) / v - 1
    spread = F.coalesce((v > 1e-12) & (m > 0) & (m < 1) & (n > 0), F.lit(False))

    @F.arrow_udf("struct<q double, cvar double>")
    def tail(one: pa.Array, two: pa.Array) -> pa.Array:
        parts = [_beta_tail(one.slice(k, 1024).to_numpy(False), two.slice(k, 1024).to_numpy(False), alpha, steps) for k in range(0, len(one), 1024)] or [np.empty((2, 0))]
        q, cvar = np.concatenate(parts, axis=1)
        return pa.StructArray.from_arrays([pa.array(q, from_pandas=True), pa.array(cvar, from_pandas=True)], names=["q", "cvar"])

    rows = cells.withColumn("_tail", tail(F.when(spread, m * n - 1), F.when(spread, (1 - m) * n - 1)))
    quantile = F.greatest(F.coalesce("_tail.q", mean), m)
    return rows.withColumns({"risk_mean": m, "risk_q": quantile, "risk_cvar": F.greatest(F.coalesce("_tail.cvar", m), quantile)}).drop("_tail")
