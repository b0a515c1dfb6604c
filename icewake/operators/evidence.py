"""Evidential models over cells: loss terms, a small network whose weights are a table, and who provides the risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..functions.special import digamma, log_gamma

WEIGHTS = 1_000_000  # of a network, at most: they go to every task
SAFE = 1  # number of the class that is safe


def loss_terms(rows: DataFrame, alphas: list[str], label: str, strength: float = 1e-3) -> DataFrame:
    """``rows`` with mse, variance, divergence and loss of a Dirichlet prediction for class number ``label``.

    The divergence is that from the uniform Dirichlet.  Parameters that are missing or not positive, or a label that is no class, give NULL.
    """
    a = [F.when(finite(c) > 0, finite(c)) for c in alphas]
    s = sum(a[1:], a[0])
    y = [F.when(F.col(label).between(0, len(a) - 1), (F.col(label) == k).cast("double")) for k in range(len(a))]
    mse = sum(((y[k] - x / s) * (y[k] - x / s) for k, x in enumerate(a)), F.lit(0.0))
    variance = sum((x / s * (1 - x / s) / (s + 1) for x in a), F.lit(0.0))
    apart = log_gamma(s) - lgamma(len(a)) - sum((log_gamma(x) for x in a), F.lit(0.0)) + sum(((x - 1) * (digamma(x) - digamma(s)) for x in a), F.lit(0.0))
    terms = rows.withColumns({"mse": mse, "variance": variance, "divergence": F.when(mse.isNotNull(), apart)}).withColumn("variance", F.when(F.col("mse").isNotNull(), F.col("variance")))
    return terms.withColumn("loss", F.col("mse") + F.col("variance") + strength * F.col("divergence"))


@dataclass
class Network:
    """A feed-forward network with ReLU between layers; ``scaled`` features are z-scored by (mean, deviation)."""

    features: list[str]
    layers: list[tuple[np.ndarray, np.ndarray]]  # weights (inputs, outputs) and biases
    scaled: dict[str, tuple[float, float]] = field(default_factory=dict)

    @staticmethod
    def from_table(weights: DataFrame, features: list[str], scaled: dict[str, tuple[float, float]]) -> Network:
        """From rows (layer, input, output, value); input -1 is the bias."""
        rows = weights.select("layer", "input", "output", "value").limit(WEIGHTS + 1).collect()
        if len(rows) > WEIGHTS:
            raise ValueError(f"more than {WEIGHTS} weights")
        layers = []
        for n in sorted({r["layer"] for r in rows}):
            own = [r for r in rows if r["layer"] == n]
            w, b = (np.zeros((max(r["input"] for r in own) + 1, max(r["output"] for r in own) + 1)) for _ in range(2))
            b = b[0]
            for r in own:
                if r["input"] < 0:
                    b[r["output"]] = r["value"]
                else:
                    w[r["input"], r["output"]] = r["value"]
            layers.append((w, b))
        sizes = [len(features), *(w.shape[1] for w, _ in layers)]
        if not layers or any(w.shape[0] != n for (w, _), n in zip(layers, sizes, strict=False)):
            raise ValueError("layers do not fit each other and the features")
        return Network(features, layers, scaled)

    def alphas(self, x: np.ndarray) -> np.ndarray:
        """Dirichlet parameters of rows of features: softplus of the last layer, plus 1."""
        for w, b in self.layers[:-1]:
            x = np.maximum(x @ w + b, 0)
        w, b = self.layers[-1]
        return np.logaddexp(0, x @ w + b) + 1


def network_risk(cells: DataFrame, network: Network) -> DataFrame:
    """``cells`` with risk = 1 - p(safe) and uncertainty = K / S, in blocks of rows.

    A feature without a column, or without a finite value, is 0 before it is scaled.
    """
    names = {c.lower() for c in cells.columns}
    given = [F.coalesce(finite(c), F.lit(0.0)) if c.lower() in names else F.lit(0.0) for c in network.features]
    shifted = [(x - network.scaled[c][0]) / (network.scaled[c][1] or 1.0) if c in network.scaled else x for c, x in zip(network.features, given, strict=True)]
    rows = cells.drop("risk", "uncertainty")
    place = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            a = network.alphas(x)
            s = a.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 - a[:, SAFE] / s), pa.array(a.shape[1] / s)], names=[*place, "risk", "uncertainty"])

    schema = rows.select("*", F.lit(0.0).alias("risk"), F.lit(0.0).alias("uncertainty")).schema
    return rows.withColumn("_x", F.array(*shifted)).mapInArrow(run, schema)


def provided_risk(cells: DataFrame, network: Network | None = None, external: DataFrame | None = None) -> DataFrame:
    """``cells`` with risk, uncertainty, and which provider gave them and why.

    The trained network if there is one and the cells have its first feature; else ``external`` (i, j, risk, uncertainty) where
    it has rows, cells that it lacks being uncertain; else nothing is known: risk 0, uncertainty 0.5.
    """
    told = lambda source, reason: [F.lit(source).alias("source"), F.lit(reason).alias("reason")]
    rows, why = cells.drop("risk", "uncertainty", "source", "reason"), "no_network"
    if network is not None:
        if network.features[0].lower() in {c.lower() for c in cells.columns}:
            return network_risk(rows, network).select("*", *told("small_network", ""))
        why = f"no_{network.features[0]}"
    if external is not None and not external.isEmpty():
        own = external.select("i", "j", finite("risk").alias("risk"), finite("uncertainty").alias("uncertainty"))
        met = rows.join(own, ["i", "j"], "left")
        bounded = {"risk": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("risk", F.lit(0.0)))), "uncertainty": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("uncertainty", F.lit(1.0))))}
        return met.withColumns(bounded).select(*rows.columns, "risk", "uncertainty", *told("external", why))
    return rows.select("*", F.lit(0.0).alias("risk"), F.lit(0.5).alias("uncertainty"), *told("placeholder", f"{why},no_external"))
