"""Series along a route: profiles, thinning, interpolation, centre lines.  Every window is within one route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import clip
from .routes import with_distance


def profile(steps: DataFrame, layers: list[str]) -> DataFrame:
    """Distance so far and the layers met, without gaps; uncertainty within 0..1."""
    filled = {c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)) for c in layers}
    if "uncertainty" in filled:
        filled["uncertainty"] = clip(filled["uncertainty"], 0.0, 1.0)
    return with_distance(steps).withColumns(filled).select("route_id", "seq", "distance_km", *layers)


def thinned_evenly(steps: DataFrame, most: int) -> DataFrame:
    """At most ``most`` (two or more) steps of each route at even positions, both ends among them."""
    w = Window.partitionBy("route_id")
    rows = steps.withColumns({"_r": F.row_number().over(w.orderBy("seq")).cast("long") - 1, "_n": F.count("*").over(w)})
    k = F.expr(f"(_r * {most - 1} + _n - 2) div greatest(_n - 1, 1)")
    return rows.withColumn("_k", k).filter(f"_n <= {most} or _k * (_n - 1) div {most - 1} = _r").drop("_r", "_n", "_k")


def series_scaled(steps: DataFrame, column: str, out: str) -> DataFrame:
    """The series between its extremes per route; flat series are 0, gaps stay."""
    w = Window.partitionBy("route_id")
    low, high = F.min(column).over(w), F.max(column).over(w)
    return steps.withColumn(out, F.when(F.col(column).isNull(), None).when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.0))


def interpolated(knots: DataFrame, targets: DataFrame, values: list[str]) -> DataFrame:
    """``targets`` (route_id, s, id) with ``values`` of ``knots`` (route_id, s, ...) at s, linear between knots and
    held at the ends (W15).

    Knots and targets are sorted together, so each target sees the knots around it in one window: no range join.
    A route without knots has NULL values; knots of equal s: the last in any order of values counts.
    """
    knot = F.struct("s", *values)
    k = knots.filter("s is not null").groupBy("route_id", "s").agg(*(F.max(v).alias(v) for v in values))
    both = k.select("route_id", "s", F.lit(None).cast("long").alias("id"), knot.alias("knot"))
    both = both.unionByName(targets.select("route_id", "s", F.col("id").cast("long"), F.lit(None).alias("knot")), allowMissingColumns=True)
    w = Window.partitionBy("route_id").orderBy("s")
    before = F.last("knot", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    # from the far end, so that the frame only grows
    after = F.last("knot", ignorenulls=True).over(Window.partitionBy("route_id").orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, 0))
    rows = both.withColumns({"a": before, "b": after}).filter("id is not null")
    share = (F.col("s") - F.col("a.s")) / (F.col("b.s") - F.col("a.s"))
    at = lambda v: F.when(F.col("a").isNull(), F.col(f"b.{v}")).when(F.col("b").isNull() | (F.col("b.s") == F.col("a.s")), F.col(f"a.{v}")).otherwise(F.col(f"a.{v}") + share * (F.col(f"b.{v}") - F.col(f"a.{v}")))
    return rows.select("route_id", "id", "s", *(at(v).alias(v) for v in values))


def centre_line(steps: DataFrame, group: str, points: int = 5) -> DataFrame:
    """Mean position at ``points`` even shares of the trajectories of a group, and how many met there."""
    w = Window.partitionBy("route_id")
    knots = steps.withColumn("_n", F.count("*").over(w)).withColumn("s", (F.col("seq") - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    owners = steps.select("route_id", group).distinct()
    targets = owners.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("s", F.col("id") / (points - 1))
    at = interpolated(knots.select("route_id", "s", "lat", "lon"), targets, ["lat", "lon"]).join(owners, "route_id")
    return at.groupBy(group, F.col("id").alias("point")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"))
