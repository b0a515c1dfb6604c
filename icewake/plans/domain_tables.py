"""Domain tables derived from the driver's tables: points, cells, routes and mode results.

Integer arithmetic over ids makes the same values in any engine; the SQL text of each table stands next
to it for the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 400  # columns of the grid that event ids fill row by row


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking points: point_id, mmsi, ts, sog, lat, lon; the extent overshoots the demo grid."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("point_id"),
        F.col("user_id").alias("mmsi"),
        "ts",
        (F.col("value") + F.lit(0.0)).alias("sog"),
        (64 + (F.col("event_id") * 7919 % 17001) / 1000).alias("lat"),
        (-2 + (F.col("event_id") * 104729 % 164001) / 1000).alias("lon"),
        "event_type",
        "props",
    )


POINTS = """points AS (SELECT event_id AS point_id, user_id AS mmsi, ts, value + 0e0 AS sog,
  64 + (event_id * 7919 % 17001) / 1e3 AS lat, -2 + (event_id * 104729 % 164001) / 1e3 AS lon, event_type, props FROM events)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide grid of cells with layers; every 97th has no ice data, the last columns are land."""
    e = _read(spark, sf_dir, "events").select(F.expr(f"event_id div {WIDTH}").alias("i"), (F.col("event_id") % WIDTH).alias("j"), "event_id", "value")
    gap = F.col("event_id") % 97 == 0
    return e.select(
        "i",
        "j",
        (60 + (F.col("i") * 13 % 301) / 10).alias("lat"),
        (-180 + F.col("j") * 9 / 10).alias("lon"),
        (F.col("j") >= WIDTH - 40).alias("is_land"),
        F.when(~gap, ((F.col("i") * 37 + F.col("j") * 17) % 101) / 100).alias("sic"),
        (((F.col("i") * 13 + F.col("j") * 29) % 71) / 10).alias("wave"),
        F.when(~gap, ((F.col("i") * 7 + F.col("j") * 11) % 211) / 100).alias("thick"),
        ((F.col("event_id") * 31 % 1009) / 1008).alias("density"),
        (F.abs("value") + F.lit(0.0)).alias("traffic"),
    )


CELLS = f"""cells AS (SELECT i, j, 60 + (i * 13 % 301) / 1e1 AS lat, -180 + j * 9 / 1e1 AS lon, j >= {WIDTH - 40} AS is_land,
  CASE WHEN event_id % 97 <> 0 THEN ((i * 37 + j * 17) % 101) / 1e2 END AS sic, ((i * 13 + j * 29) % 71) / 1e1 AS wave,
  CASE WHEN event_id % 97 <> 0 THEN ((i * 7 + j * 11) % 211) / 1e2 END AS thick, (event_id * 31 % 1009) / 1008e0 AS density,
  abs(value) + 0e0 AS traffic
  FROM (SELECT event_id // {WIDTH} AS i, event_id % {WIDTH} AS j, event_id, value FROM events))"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes: the points of each vessel and day in time order, with the values met."""
    p = points(spark, sf_dir)
    w = Window.partitionBy("route_id").orderBy("ts", "point_id")
    rows = p.select(F.concat_ws("-", "mmsi", F.date_format("ts", "yyyyMMdd")).alias("route_id"), "mmsi", "ts", "point_id", "lat", "lon")
    k = F.col("point_id")
    return rows.withColumn("seq", F.row_number().over(w)).select(
        "route_id", "mmsi", "seq", "lat", "lon",
        (k * 13 % 41 / 10).alias("ice_cost"), (k * 29 % 23 / 10).alias("wave_cost"), (k * 7 % 11 / 10).alias("ais_cost"),
        F.when(k % 53 != 0, k * 17 % 101 / 100).alias("uncertainty"), F.when(k % 47 != 0, k * 31 % 1009 / 1008).alias("density"),
        (k % 19 == 0).alias("is_land"),
    )


STEPS = f"""{POINTS}, steps AS (SELECT route_id, mmsi, row_number() OVER (PARTITION BY route_id ORDER BY ts, point_id)::BIGINT AS seq, lat, lon,
  point_id * 13 % 41 / 1e1 AS ice_cost, point_id * 29 % 23 / 1e1 AS wave_cost, point_id * 7 % 11 / 1e1 AS ais_cost,
  CASE WHEN point_id % 53 <> 0 THEN point_id * 17 % 101 / 1e2 END AS uncertainty,
  CASE WHEN point_id % 47 <> 0 THEN point_id * 31 % 1009 / 1008e0 END AS density, point_id % 19 = 0 AS is_land
  FROM (SELECT *, mmsi || '-' || strftime(ts, '%Y%m%d') AS route_id FROM points))"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode results: an order is a run, its customer the scenario."""
    o = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    mode = F.when(k % 3 == 0, "efficient").when(k % 3 == 1, "safe").otherwise("robust")
    return o.select(
        k.alias("run_id"), F.col("o_custkey").alias("scenario_id"), mode.alias("mode"), (k % 11 != 0).alias("reachable"),
        (k * 37 % 4001 + 1000).cast("double").alias("distance_km"), F.col("o_totalprice").alias("total_cost"), (k * 91 % 503 / 10).alias("risk"), (k * 17 % 101 / 100).alias("uncertainty"),
    )


RESULTS = """results AS (SELECT o_orderkey AS run_id, o_custkey AS scenario_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'efficient' WHEN 1 THEN 'safe' ELSE 'robust' END AS mode, o_orderkey % 11 <> 0 AS reachable,
  (o_orderkey * 37 % 4001 + 1000)::DOUBLE AS distance_km, o_totalprice AS total_cost, o_orderkey * 91 % 503 / 1e1 AS risk,
  o_orderkey * 17 % 101 / 1e2 AS uncertainty FROM orders)"""
