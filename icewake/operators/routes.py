"""Route analytics: distances, cost totals, profiles and scores over ordered steps.

A step table has route_id and seq; every window is within one route.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import clip, haversine_km

CO2_PER_FUEL = 3.114
KM_PER_NM = 1.852


def _route() -> Window:
    return Window.partitionBy("route_id").orderBy("seq")


def with_distance(steps: DataFrame) -> DataFrame:
    """Adds the length of the leg to each step and the distance so far."""
    w = _route()
    leg = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    rows = steps.withColumn("leg_km", F.coalesce(leg, F.lit(0.0)))
    return rows.withColumn("distance_km", F.sum("leg_km").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def lengths(steps: DataFrame) -> DataFrame:
    """Length and number of points of each route."""
    return with_distance(steps).groupBy("route_id").agg(F.sum("leg_km").alias("length_km"), F.count("*").alias("points"))


def cost_totals(steps: DataFrame, components: list[str]) -> DataFrame:
    """Total of each component per route, and its share of all (A05, A06, A13): long rows."""
    long = steps.select("route_id", F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("value")) for c in components))).alias("x")).select("route_id", "x.*")
    totals = long.groupBy("route_id", "component").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
    whole = F.sum("total").over(Window.partitionBy("route_id"))
    return totals.withColumn("fraction", F.when(whole > 0, F.col("total") / whole).otherwise(0.0))


def land_crossings(steps: DataFrame) -> DataFrame:
    """Steps on land and ocean, and the first on land."""
    land = F.col("is_land")
    return steps.groupBy("route_id").agg(
        F.sum(land.cast("long")).alias("on_land"),
        F.sum((~land).cast("long")).alias("on_ocean"),
        F.min(F.when(land, F.col("seq"))).alias("first_land"),
    )


def density_along(steps: DataFrame, low: Column, high: Column) -> DataFrame:
    """Mean, maximum and shares beyond two thresholds of the density that routes meet (A10)."""
    d = F.col("density")
    return steps.groupBy("route_id").agg(
        F.avg(d).alias("mean_density"),
        F.max(d).alias("max_density"),
        F.avg(F.when(d.isNotNull(), (d > high).cast("int"))).alias("share_high"),
        F.avg(F.when(d.isNotNull(), (d < low).cast("int"))).alias("share_low"),
        F.sum(d.isNull().cast("long")).alias("missing"),
    )


def emissions(routes: DataFrame, speed_kn: Column, fuel_per_km: Column) -> DataFrame:
    """Hours, fuel and CO2 of routes by length; zero for fewer than two points."""
    km = F.when(F.col("points") >= 2, F.col("length_km")).otherwise(0.0)
    return routes.withColumns({"hours": km / (speed_kn * KM_PER_NM), "fuel": km * fuel_per_km, "co2": km * fuel_per_km * CO2_PER_FUEL})


def uncertainty_along(steps: DataFrame, above: float = 0.5) -> DataFrame:
    """Mean uncertainty and share of steps over a bound."""
    u = clip(F.col("uncertainty"), 0.0, 1.0)
    return steps.groupBy("route_id").agg(F.avg(u).alias("mean_uncertainty"), F.avg(F.when(u.isNotNull(), (u > above).cast("int"))).alias("share_uncertain"))


def scores(routes: DataFrame, weights: dict[str, float], request: str = "request") -> DataFrame:
    """Weighted sum of measures, each between its extremes within a request."""
    w = Window.partitionBy(request)
    total = F.lit(0.0)
    for column, weight in weights.items():
        x = F.coalesce(F.col(column), F.lit(0.0))
        span = F.max(x).over(w) - F.min(x).over(w)
        total = total + F.lit(weight) * F.when(span > 1e-12, (x - F.min(x).over(w)) / span).otherwise(0.0)
    return routes.withColumn("score", total)


def recommended(scored: DataFrame, request: str = "request") -> DataFrame:
    """Route of the lowest score per request; the smaller id wins a tie."""
    return scored.groupBy(request).agg(F.min_by("route_id", F.struct("score", "route_id")).alias("route_id"), F.min("score").alias("score"))


def smoothed(steps: DataFrame, column: str, out: str) -> DataFrame:
    """Moving mean of five with zeros beyond the ends; routes of fewer than five steps stay."""
    w = _route().rowsBetween(-2, 2)
    n = F.count("*").over(Window.partitionBy("route_id"))
    return steps.withColumn(out, F.when(n < 5, F.col(column)).otherwise(F.sum(column).over(w) / 5))


def hot_segment(steps: DataFrame, columns: list[str], above: float = 0.6) -> DataFrame:
    """First and last step where all columns exceed a bound."""
    hot = F.lit(True)
    for c in columns:
        hot = hot & (F.col(c) > above)
    at = F.when(hot, F.col("seq"))
    return steps.groupBy("route_id").agg(F.min(at).alias("first_hot"), F.max(at).alias("last_hot"))


def segment_attribution(steps: DataFrame, column: str, weight: float) -> DataFrame:
    """Trapezoid of a field over each leg, summed per route."""
    w = _route()
    nxt = F.lead(column).over(w)
    leg = haversine_km(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    part = F.lit(weight) * (F.col(column) + nxt) / 2 * leg
    return steps.withColumn("part", part).groupBy("route_id").agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("attributed"))


def thinned(steps: DataFrame, min_km: float) -> DataFrame:
    """Points at least ``min_km`` from the last one kept; both ends stay.

    The fold runs over each route's ordered array, so one route is one row here.
    """
    points = steps.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p"))
    last = F.element_at("p", -1)

    def keep(kept: Column, x: Column) -> Column:
        before = F.element_at(kept, -1)
        far = haversine_km(before["lat"], before["lon"], x["lat"], x["lon"]) >= min_km
        return F.when(far | (x["seq"] == last["seq"]), F.concat(kept, F.array(x))).otherwise(kept)

    rest = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    return points.select("route_id", F.explode(F.aggregate(rest, F.slice("p", 1, 1), keep)).alias("x")).select("route_id", "x.seq", "x.lat", "x.lon")
