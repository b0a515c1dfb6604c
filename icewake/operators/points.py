"""Vessel-tracking points: validity, time windows, speeds, sampling intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import smallest


def in_time(points: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from start to end, both included; rows without a time go only if a bound is given."""
    if start is not None:
        points = points.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        points = points.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return points


def valid(points: DataFrame, south: float = 60.0, north: float = 90.0, max_knots: float = 60.0) -> DataFrame:
    """Positions on the globe and in the range, speeds that are plausible or missing."""
    on_globe = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.col("lat").between(south, north)
    return points.filter(on_globe & F.col("mmsi").isNotNull() & F.col("ts").isNotNull() & (F.col("sog").isNull() | (F.abs("sog") <= max_knots)))


def complete(points: DataFrame) -> DataFrame:
    """Rows with all five fields, a position on the globe and a speed that is not negative."""
    given = points.dropna(subset=["ts", "lat", "lon", "sog", "mmsi"])
    return given.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & (F.col("sog") >= 0))


def in_month(points: DataFrame, year_month: str) -> DataFrame:
    """Rows of one month, given as YYYYMM."""
    return points.filter(F.date_format("ts", "yyyyMM") == year_month)


def first_of(df: DataFrame, candidates: list[str]) -> Column:
    """First non-null of the candidate columns that exist, by any letter case."""
    by_name = {c.lower(): c for c in reversed(df.columns)}
    found = [F.col(by_name[c.lower()]) for c in candidates if c.lower() in by_name]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def speed_ratio(points: DataFrame, share: float = 0.8) -> DataFrame:
    """Speed against the vessel's own percentile, within 0.05..1.2, and its logarithm."""
    usual = points.groupBy("mmsi").agg(F.percentile("sog", share).alias("usual"))
    ratio = F.when(F.col("usual") > 0, F.greatest(F.lit(0.05), F.least(F.lit(1.2), F.col("sog") / F.col("usual"))))
    return points.join(usual, "mmsi").withColumn("ratio", ratio).withColumn("log_ratio", F.ln("ratio"))


def interval_label(points: DataFrame) -> DataFrame:
    """Median seconds between a vessel's points, and what that is called."""
    w = Window.partitionBy("mmsi").orderBy("ts", "point_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    median = points.withColumn("gap", gap / 1e6).groupBy("mmsi").agg(F.percentile("gap", 0.5).alias("median_s"))
    label = F.when(F.col("median_s") >= 25 * 86400, "monthly").when(F.col("median_s") >= 20 * 3600, "D").when(F.col("median_s") >= 5 * 3600, "6H").when(F.col("median_s") >= 2.5 * 3600, "3H").otherwise("H")
    return median.withColumn("label", F.when(F.col("median_s").isNotNull(), label))


def profile(points: DataFrame) -> DataFrame:
    """Rows, vessels and extents of a point table."""
    return points.agg(F.count("*").alias("n"), F.count_distinct("mmsi").alias("vessels"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"))


def json_fields(points: DataFrame, column: str) -> DataFrame:
    """Fields of a JSON column with their counts and types."""
    v = points.select(F.try_parse_json(F.col(column)).alias("v"))
    fields = v.selectExpr("explode(map_entries(cast(v as map<string, variant>))) as e")
    return fields.selectExpr("e.key as field", "schema_of_variant(e.value) as kind").groupBy("field", "kind").agg(F.count("*").alias("n"))


def sampled(points: DataFrame, key: str, per_class: int, label: str, seed: int = 42) -> DataFrame:
    """At most ``per_class`` rows of each class, those of smallest draw key: a sample that repeats (O03).  Classes are few."""
    return smallest(points, [key], lambda n: per_class, seed, label)


def drawn(points: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, those of smallest draw key."""
    return smallest(points, [key], lambda _: n, seed)
