"""Traffic density over grid cells, and reductions over a whole grid.

A raster is a table of cells.  Reductions over a grid are aggregated to one row a grid and joined back
as a broadcast of that size, never an unpartitioned window over all cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import clip, nearest_index
from ..functions.numbers import finite
from .grid import GridAxes
from .selection import quantiles


def points_to_cells(points: DataFrame, axes: GridAxes) -> DataFrame:
    """``points`` with the indexes i, j of their nearest cell."""
    return points.withColumns({
        "i": nearest_index(F.col("lat"), axes.lat0, axes.dlat, axes.ny),
        "j": nearest_index(F.col("lon"), axes.lon0, axes.dlon, axes.nx),
    })


def rasterise(points: DataFrame, axes: GridAxes) -> DataFrame:
    """Points per cell that has any: i, j, n (A01, A03); partial counts before the shuffle."""
    return points_to_cells(points.filter("lat is not null and lon is not null"), axes).groupBy("i", "j").agg(F.count("*").alias("n"))


def on_grid(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Every cell of ``cells`` with its count, 0 where there is none."""
    return cells.join(counts, ["i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def with_grid_values(cells: DataFrame, **values: Column) -> DataFrame:
    """``cells`` with one-row aggregates over all of them as columns."""
    return cells.crossJoin(F.broadcast(cells.agg(*(c.alias(k) for k, c in values.items()))))


def normalised(cells: DataFrame, column: str, out: str) -> DataFrame:
    """No data and negatives to 0, divided by the maximum if that is positive."""
    x = F.coalesce(finite(column), F.lit(0.0))
    top = with_grid_values(cells, _top=F.max(x))
    return top.withColumn(out, clip(F.when(F.col("_top") > 0, x / F.col("_top")).otherwise(x), 0.0, 1.0)).drop("_top")


def min_max(cells: DataFrame, column: str, out: str) -> DataFrame:
    """(x - min) / (max - min) of finite values, 0 where all are alike; others stay NULL or NaN."""
    x = finite(column)
    both = with_grid_values(cells, _low=F.min(x), _high=F.max(x))
    span = F.col("_high") - F.col("_low")
    return both.withColumn(out, F.when(x.isNull(), F.when(F.col(column).isNotNull(), float("nan"))).when(span > 1e-12, (x - F.col("_low")) / span).otherwise(0.0)).drop("_low", "_high")


def from_percent(cells: DataFrame, column: str, out: str, above: float = 1.5) -> DataFrame:
    """Divided by 100 if the maximum says these are percents, then within 0..1."""
    x = finite(column)
    top = with_grid_values(cells, _top=F.max(x))
    return top.withColumn(out, clip(F.when(F.col("_top") > above, x / 100.0).otherwise(x), 0.0, 1.0)).drop("_top")


def quantile_scaled(cells: DataFrame, column: str, out: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(x - q_low) / (q_high - q_low) within 0..1; a flat field is measured from q_low on."""
    x = finite(column)
    bottom, top = quantiles(cells, column, [low, high])
    if bottom is None:
        return cells.withColumn(out, F.lit(None).cast("double"))
    span = top - bottom if top > bottom else 1.0
    return cells.withColumn(out, clip((x - bottom) / span, 0.0, 1.0))


def log_congestion(cells: DataFrame, column: str, out: str) -> DataFrame:
    """Logarithmic density between its extremes."""
    logged = cells.withColumn("_x", F.log1p(column))
    both = with_grid_values(logged, _low=F.min("_x"), _high=F.max("_x"))
    return both.withColumn(out, (F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low") + 1e-6)).drop("_x", "_low", "_high")


def statistics(cells: DataFrame, column: str) -> DataFrame:
    """Count, finite share, extremes, mean and five quantiles of a layer."""
    shares = [0.01, 0.05, 0.5, 0.95, 0.99]
    x = finite(column)
    return cells.agg(
        F.count("*").alias("n"),
        F.avg(x.isNotNull().cast("int")).alias("finite_ratio"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
        F.avg(x).alias("mean"),
        *(F.lit(q).cast("double").alias(f"q{int(100 * p):02d}") for p, q in zip(shares, quantiles(cells, column, shares), strict=True)),
    )


def signature(cells: DataFrame) -> DataFrame:
    """Text that tells a grid by its shape and extent."""
    return cells.agg(F.format_string("%dx%d_%.4f_%.4f_%.4f_%.4f", F.max("i") + 1, F.max("j") + 1, F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).alias("signature"))


def traffic_labels(cells: DataFrame, column: str, threshold: float) -> DataFrame:
    """1 where ships pass, 0 where none do, on ocean; other cells go."""
    label = F.when(F.col(column) > threshold, 1).when(F.col(column) == 0, 0)
    return cells.filter("not is_land").withColumn("label", label).filter("label is not null")


def build_result(points: DataFrame) -> DataFrame:
    """Points, those that fall into a cell, and their share (A02): every point with a position does."""
    binned = F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return points.agg(F.count("*").alias("num_points"), binned.alias("num_binned"), F.when(F.count("*") > 0, binned / F.count("*")).otherwise(0.0).alias("frac_binned"))


def dataset(counts: DataFrame, cells: DataFrame, title: str) -> DataFrame:
    """A density raster with its axes and attributes: i, j, lat, lon, count, density, title."""
    return normalised(on_grid(counts, cells), "n", "density").select("i", "j", "lat", "lon", "n", "density", F.lit(title).alias("title"))
