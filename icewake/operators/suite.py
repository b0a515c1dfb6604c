"""Scenario suites, and layers, routes and reports as they come from files.

Scenarios, profiles and time steps are configuration: lists whose length does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import risk
from ..functions.numbers import finite
from . import cost, grid, inventory, planning, routes
from .density import from_percent, with_grid_values
from .points import first_of

# fixed values: names under which evaluations carry the reported metrics
REPORTED = {
    "dist_km": ["delta_distance_km", "delta_dist_km", "d_dist_km"],
    "dist_pct": ["delta_distance_pct", "rel_dist_pct"],
    "cost": ["delta_cost"],
    "cost_pct": ["delta_cost_pct", "rel_cost_pct"],
    "risk_reduction": ["risk_reduction_pct"],
}


def snapped(scenarios: DataFrame, cells: DataFrame, axes: grid.GridAxes) -> DataFrame:
    """``scenarios`` (scenario_id, start_lat, start_lon, end_lat, end_lon) with the ocean cells of both ends, NULL where none is near."""
    ends = scenarios.select("scenario_id", F.explode(F.array(
        F.struct(F.lit("start").alias("end"), F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")),
        F.struct(F.lit("goal").alias("end"), F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon")),
    )).alias("x")).select(F.struct("scenario_id", "x.end").alias("point_id"), "x.lat", "x.lon")
    at = grid.nearest_ocean(ends, cells, axes).select("point_id.scenario_id", "point_id.end", "i", "j")
    of = lambda end, c: F.max(F.when(F.col("end") == end, F.col(c))).alias(f"{end}_{c}")
    placed = at.groupBy("scenario_id").agg(*(of(end, c) for end in ("start", "goal") for c in ("i", "j")))
    return scenarios.select("scenario_id").join(placed, "scenario_id", "left")


def suite(scenarios: DataFrame, fields: DataFrame, cells: DataFrame, axes: grid.GridAxes) -> DataFrame:
    """Steps of every scenario under every profile of ``fields`` (run_id is the profile).

    A run without a route has one row with its reason and no step, so every scenario and mode is there.
    """
    keys = fields.select(F.col("run_id").alias("mode")).distinct()
    runs = snapped(scenarios, cells, axes).crossJoin(keys).withColumn("run_id", F.concat_ws("/", "scenario_id", "mode"))
    own = fields.withColumnRenamed("run_id", "mode").join(runs.select("run_id", "mode"), "mode").drop("mode")
    steps = planning.planned(own, runs.drop("scenario_id", "mode"))
    return steps.join(runs.select("run_id", "scenario_id", "mode"), "run_id")


def suite_table(steps: DataFrame, components: list[str]) -> DataFrame:
    """One row a scenario and mode: reachable, reason, length, cost of the cells, cost of the search, component sums."""
    w = Window.partitionBy("run_id").orderBy("seq")
    stride = F.hypot(F.col("i") - F.lag("i").over(w), F.col("j") - F.lag("j").over(w))
    zero = F.lit(0.0)
    sums = [F.coalesce(F.sum(finite(c)), zero).alias(f"{c}_total") for c in components]
    costs = steps.withColumn("entered", stride * F.col("step_cost")).groupBy("run_id", "scenario_id", "mode").agg(
        F.max("reason").alias("reason"), F.coalesce(F.sum(finite("step_cost")), zero).alias("total_cost"), F.coalesce(F.sum("entered"), zero).alias("search_cost"), *sums
    )
    return costs.join(planning.run_table(steps), "run_id").drop("run_id")


def density_by_mode(steps: DataFrame, low: float, high: float) -> DataFrame:
    """What each run met of the density, one row a scenario and mode."""
    met = routes.density_along(steps.filter("i is not null").withColumn("route_id", F.struct("scenario_id", "mode")), F.lit(low), F.lit(high))
    return met.select("route_id.scenario_id", "route_id.mode", *(c for c in met.columns if c != "route_id"))


def cost_or_demo(cells: DataFrame, max_thickness: float, margin: float) -> DataFrame:
    """Cost from the layers, or the demonstration's where the grid has no ice layer at all (C20); ``real`` tells which."""
    known = with_grid_values(cells, real=F.count(finite("sic")) > 0)
    rows = cost.vessel_cost(known, max_thickness, margin)
    demo = F.when(~F.col("is_land"), 1.0 + risk.demo_ice_risk(F.col("lat"), F.col("is_land")))
    return rows.withColumn("cost", F.when(F.col("real"), F.col("cost")).otherwise(demo))


def chosen_density(files: DataFrame, exact: Column, demo: Column, explicit: str | None = None, fallback: str | None = None) -> DataFrame:
    """The density file of each month (ym, path): the explicit one, else the best ranked and newest, else the fallback."""
    months = files.select("ym").distinct()
    if explicit is not None:
        return months.withColumn("path", F.lit(explicit))
    best = inventory.ranked_candidates(files, exact, demo).groupBy("ym").agg(F.min_by("path", F.struct("rank", -F.col("mtime"), "path")).alias("path"))
    return months.join(best, "ym", "left").withColumn("path", F.coalesce("path", F.lit(fallback)))


def layer(cells: DataFrame, names: list[str], step: int, strict: bool = False) -> DataFrame:
    """``(i, j, value)`` of the first of ``names`` that there is, at one time step, percents scaled to 0..1.

    A step out of range is an error if ``strict``, else the nearest step.  No such column gives NULL values.
    """
    times = cells.select("time").distinct()
    n = times.count()
    if strict and not 0 <= step < n:
        raise IndexError(f"time step {step} of {n}")
    one = times.orderBy("time").offset(max(0, min(step, n - 1))).limit(1)
    rows = cells.withColumn("value", first_of(cells, names).cast("double")).join(one, "time").select("i", "j", "value")
    return from_percent(rows, "value", "value")


def month_slice(layers: DataFrame, ym: str, column: str, order: list[str]) -> DataFrame:
    """First value of each cell in a month, as sic_pred."""
    rows = layers.filter(F.date_format("ts", "yyyyMM") == ym)
    return rows.groupBy("i", "j").agg(F.min_by(column, F.struct(*order)).alias("sic_pred"))


def line_points(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, seq, lat, lon)`` of the line in GeoJSON texts: a collection's first feature, a feature or a bare line.

    Texts that are no JSON or hold no line give no rows.
    """
    kind = "array<array<double>>"
    parsed = texts.select(key, F.try_parse_json(text).alias("v"))
    found = F.coalesce(*(F.try_variant_get("v", p, kind) for p in ("$.features[0].geometry.coordinates", "$.geometry.coordinates", "$.coordinates")))
    each = parsed.select(key, F.posexplode(found).alias("seq", "at"))
    return each.select(key, "seq", F.get("at", F.lit(1)).alias("lat"), F.get("at", F.lit(0)).alias("lon"))


def reported(evaluation: DataFrame, keys: list[str]) -> DataFrame:
    """The reported metrics of an evaluation under one name each, whatever names it has; NULL where it has none."""
    return evaluation.select(*keys, *(first_of(evaluation, names).alias(n) for n, names in REPORTED.items()))


def report_lines(evaluation: DataFrame, columns: list[str]) -> DataFrame:
    """A Markdown table row for each row (S36); missing values are empty."""
    return evaluation.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |")).alias("line"))


def demo_raster(spark: SparkSession, size: int = 64) -> DataFrame:
    """``(i, j, value)``: two peaks and a broad valley, scaled to 0..1."""
    cells = spark.range(size * size).select(F.expr(f"id div {size}").alias("i"), (F.col("id") % size).alias("j"))

    def peak(x: float, y: float, width: float) -> Column:
        dx, dy = F.col("j") - size * x, F.col("i") - size * y
        return F.exp(-(dx * dx + dy * dy) / (2.0 * (size * width) ** 2))

    raw = cells.withColumn("raw", peak(0.25, 0.35, 0.12) + 0.8 * peak(0.7, 0.6, 0.18) - 0.2 * peak(0.5, 0.8, 0.5))
    both = with_grid_values(raw, _low=F.min("raw"), _high=F.max("raw"))
    span = F.col("_high") - F.col("_low")
    return both.select("i", "j", F.when(span > 0, (F.col("raw") - F.col("_low")) / span).otherwise(0.0).alias("value"))
