"""Planning over several profiles: weights, fields, searches and their evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from . import routes, search

# fixed values: components that count as risk
RISK_KEYS = ("ice_risk", "wave_risk", "ais_density", "edl_risk", "edl_uncertainty_penalty", "ice_class_soft", "ice_class_hard")


@dataclass(frozen=True)
class Profile:
    """Factors that a planning mode applies to the base weights."""

    key: str
    ice: float = 1.0
    wave: float = 1.0
    risk: float = 1.0
    uncertainty: float = 0.0


PROFILES = (Profile("efficient", 0.5, 0.5, 0.3), Profile("safe", 2.0, 1.5, 1.0), Profile("robust", 2.0, 1.5, 1.0, 1.0))


def resolved_traffic_weights(legacy: Column, corridor: Column, congestion: Column, to_corridor: Column) -> dict[str, Column]:
    """Traffic weights that count (C12, C13): newer ones silence the legacy weight, which becomes the corridor's on demand."""
    old, lane, jam = (F.coalesce(c, F.lit(0.0)) for c in (legacy, corridor, congestion))
    newer = (lane > 0) | (jam > 0)
    mapped = F.coalesce(to_corridor, F.lit(False)) & (old > 0) & ~newer
    return {"w_corridor": F.when(mapped, old).otherwise(lane), "w_congestion": jam, "w_legacy": F.when(mapped | newer, 0.0).otherwise(old), "mapped": mapped}


def with_traffic_component(fields: DataFrame, density: str, weight: float) -> DataFrame:
    """Cost plus weighted density, kept as component ais_density (C15); no density or weight adds nothing."""
    part = F.lit(float(weight)) * F.coalesce(finite(density), F.lit(0.0)) if weight > 0 else F.lit(0.0)
    return fields.withColumn("ais_density", part).withColumn("cost", F.col("cost") + F.col("ais_density"))


def profile_fields(cells: DataFrame, profiles: tuple[Profile, ...] = PROFILES) -> DataFrame:
    """Cost fields of all profiles (run_id) from components ice_cost, wave_cost, risk_cost and uncertainty.

    The profiles are a handful of rows.  Land, or a cell without a base cost, stays without a cost.
    """
    spark = cells.sparkSession
    rows = spark.createDataFrame([(p.key, p.ice, p.wave, p.risk, p.uncertainty) for p in profiles], "run_id string, f_ice double, f_wave double, f_risk double, f_unc double")
    part = lambda f, c: F.col(f) * F.coalesce(finite(c), F.lit(0.0))
    parts = {"p_ice": part("f_ice", "ice_cost"), "p_wave": part("f_wave", "wave_cost"), "p_risk": part("f_risk", "risk_cost"), "p_uncertainty": part("f_unc", "uncertainty")}
    both = cells.crossJoin(F.broadcast(rows)).withColumns(parts)
    return both.withColumn("cost", F.when(~F.col("is_land"), 1.0 + sum((F.col(c) for c in parts), F.lit(0.0))))


def planned(fields: DataFrame, runs: DataFrame) -> DataFrame:
    """Steps of the least-cost route of every run, with the cell's position and components.

    ``fields`` has a row per run and cell; a run without a route has one row without a step and its reason.
    """
    found = search.search_routes(fields.select("run_id", "i", "j", "lat", "lon", "cost"), runs)
    return found.join(fields.drop("cost"), ["run_id", "i", "j"], "left")


def run_table(steps: DataFrame) -> DataFrame:
    """One row a run: reachable, steps, length, mean and largest uncertainty and density met."""
    w = Window.partitionBy("run_id").orderBy("seq")
    from ..functions.geo import haversine_km

    leg = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    measures = [f(finite(c)).alias(f"{n}_{c}") for c in ("uncertainty", "density") if c in steps.columns for n, f in (("mean", F.avg), ("max", F.max))]
    return steps.withColumn("leg", leg).groupBy("run_id").agg(
        F.count("i").alias("steps"), F.coalesce(F.sum("leg"), F.lit(0.0)).alias("distance_km"), F.count_if("is_land").alias("on_land"), *measures
    ).withColumn("reachable", (F.col("steps") > 0) & (F.col("on_land") == 0))


def route_total(steps: DataFrame, column: str) -> DataFrame:
    """Sum of the finite costs of all steps of a route, its first included."""
    return steps.groupBy("route_id").agg(F.coalesce(F.sum(finite(column)), F.lit(0.0)).alias("total"))


def breakdown(steps: DataFrame, components: list[str]) -> DataFrame:
    """Total, length and each component's sum and share, one row a route."""
    sums = [F.coalesce(F.sum(finite(c)), F.lit(0.0)).alias(c) for c in components]
    parts = steps.groupBy("route_id").agg(*sums)
    total = sum((F.col(c) for c in components), F.lit(0.0))
    shares = [F.when(total > 0, F.col(c) / total).otherwise(0.0).alias(f"{c}_share") for c in components]
    return parts.select("route_id", total.alias("total"), *components, *shares).join(routes.lengths(steps).select("route_id", "length_km"), "route_id")


def risk_totals(components: DataFrame) -> DataFrame:
    """Sum of the risk components of each route (route_id, component, total); NULL where it has none."""
    x = F.when(F.col("component").isin(*RISK_KEYS), finite("total"))
    return components.groupBy("route_id").agg(F.sum(x).alias("risk_total"))


def share_labels(steps: DataFrame) -> DataFrame:
    """Whether the model's share of the cost is small, and whether much of the route is uncertain."""
    unsure = F.when(finite("uncertainty").isNotNull(), (F.col("uncertainty") > 0.7).cast("int"))
    sums = steps.groupBy("route_id").agg(F.sum("model_cost").alias("m"), F.sum("total_cost").alias("t"), F.avg(unsure).alias("share_unsure"))
    return sums.select("route_id", F.coalesce(F.when(F.col("t") > 0, F.round(F.col("m") / F.col("t"), 9) < 0.05), F.lit(False)).alias("small_model_share"), "share_unsure", F.coalesce(F.round("share_unsure", 9) > 0.3, F.lit(False)).alias("warn"))


def hot_stretch(steps: DataFrame, columns: list[str], above: float = 0.6) -> DataFrame:
    """First and last step where all columns, smoothed and scaled to 0..1 along the route, exceed a bound.

    Smoothed values count to nine digits, so that the order in which a window is summed never decides a step on the bound.
    """
    whole = Window.partitionBy("route_id")
    rows = steps
    for c in columns:
        rows = routes.smoothed(rows, c, f"_{c}").withColumn(f"_{c}", F.round(f"_{c}", 9))
    scaled = {}
    for c in columns:
        low, high = F.min(f"_{c}").over(whole), F.max(f"_{c}").over(whole)
        scaled[f"_{c}"] = F.when(high - low > 1e-12, (F.col(f"_{c}") - low) / (high - low)).otherwise(0.0)
    return routes.hot_segment(rows.withColumns(scaled), [f"_{c}" for c in columns], above)


def along_raster(steps: DataFrame, raster: DataFrame) -> DataFrame:
    """Mean of a raster (i, j, value) at the cells of a route's steps."""
    return steps.join(raster, ["i", "j"], "left").groupBy("route_id").agg(F.avg(finite("value")).alias("mean_value"), F.count(finite("value")).alias("met"))


def route_quality(counts: DataFrame) -> DataFrame:
    """Routes that touch no land, and the others (G14), of (route_id, on_land)."""
    return counts.agg(F.count_if(F.col("on_land") == 0).alias("ok"), F.count_if(F.col("on_land") > 0).alias("failed"))
