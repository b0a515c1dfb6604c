"""Queries of file readers: files are written from a given table, then scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import modes, suite
from .plans import domain_tables as t
from .registry import _COMPARED, _query
from .registry_layers import _folder
from .sources import ais

_SHOWN = "mmsi, lat, lon, round(sog, 6) + 0e0 AS sog"
_TIME = "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS at"


def _shown(points: DataFrame, *more: Column) -> DataFrame:
    return points.select("mmsi", "lat", "lon", (F.round("sog", 6) + F.lit(0.0)).alias("sog"), *more)


def _at(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _raw(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Points as files name their fields; every 13th has a position that is no number."""
    bad = F.col("point_id") % 13 == 0
    return t.points(spark, d).select(F.col("mmsi").alias("Ship_ID"), F.when(bad, "n/a").otherwise(F.col("lat").cast("string")).alias("Latitude"), F.col("lon").alias("LNG"), F.col("sog").alias("speed"), _at("ts").alias("BaseDateTime"), *more)


@_query("s01_csv_points", f"WITH {t.POINTS} SELECT {_SHOWN}, {_TIME} FROM points WHERE point_id % 13 <> 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csv")
    ais.write_csv(_raw(spark, d), path)
    points = ais.read_csv(spark, path)
    return _shown(points, _at("ts").alias("at"))


@_query("s01_csv_totals", f"WITH {t.POINTS} SELECT count(*) AS total, count(*) FILTER (WHERE point_id % 13 <> 0) AS parsed FROM points")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csv")
    ais.write_csv(_raw(spark, d).withColumnsRenamed({"Latitude": "pos_lat_deg", "LNG": "pos_lon_deg"}), path)
    return ais.csv_totals(spark, path)


def _nested(spark: SparkSession, d: str, path: str) -> None:
    """JSON files of a thousand points each, in four layouts: a list, a data list, lists in a list, items with data lists."""
    record = F.to_json(F.struct("Ship_ID", "Latitude", "LNG", "speed", "BaseDateTime"))
    rows = _raw(spark, d, "point_id").withColumn("file", F.expr("point_id div 1000"))
    whole = rows.groupBy("file").agg(F.concat_ws(", ", F.collect_list(record)).alias("x"))  # at most 1,000 points
    k, x = F.col("file") % 4, F.col("x")
    text = F.when(k == 0, F.concat(F.lit("["), x, F.lit("]"))).when(k == 1, F.concat(F.lit('{"code": 0, "data": ['), x, F.lit("]}"))).when(k == 2, F.concat(F.lit("[[["), x, F.lit('], []], 7, "x"]'))).otherwise(F.concat(F.lit('[{"data": ['), x, F.lit(']}, {"code": 1}, null]')))
    whole.select("file", text.alias("value")).repartition("file").write.partitionBy("file").text(path)


@_query("s07_nested_records", f"WITH {t.POINTS} SELECT {_SHOWN} FROM points WHERE point_id % 13 <> 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "nested")
    _nested(spark, d, path)
    return _shown(ais.read_json_records(spark, f"{path}/file=*/*.txt"))


_MONTH = "strftime(ts, '%Y%m') = '202401'"


@_query("s09_json_lines", f"WITH {t.POINTS} SELECT {_SHOWN}, (SELECT count(*) FROM points WHERE point_id % 7 = 3) AS bad_lines FROM points WHERE point_id % 13 <> 0 AND point_id % 7 <> 3 AND {_MONTH}")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "lines")
    record = F.to_json(F.struct("Ship_ID", "Latitude", "LNG", "speed", "BaseDateTime"))
    _raw(spark, d, "point_id").select(F.when(F.col("point_id") % 7 == 3, F.concat(F.lit("{bad "), record)).otherwise(record).alias("value")).write.text(path)
    points, bad = ais.read_json_lines(spark, path, "202401")
    return _shown(ais.placed(points).crossJoin(F.broadcast(bad)), F.col("bad_lines"))  # one row


@_query("s10_geojson_features", f"WITH {t.POINTS} SELECT {_SHOWN} FROM points WHERE point_id % 13 <> 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "features")
    rows = _raw(spark, d).filter("Latitude <> 'n/a'").withColumn("y", F.col("Latitude").cast("double"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("Ship_ID", "speed", "BaseDateTime").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("LNG", "y").alias("coordinates")).alias("geometry"))
    rows.select(F.to_json(feature).alias("value")).write.text(path)
    return _shown(ais.read_json_lines(spark, path)[0])


@_query("s25_evaluation_file", f"WITH {_COMPARED} SELECT scenario_id::VARCHAR AS scenario_id, mode, delta_km AS dist_km, round(risk_reduction_pct, 6) + 0e0 AS risk_reduction, NULL::VARCHAR AS note FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "evaluation")
    ais.write_csv(modes.compare(t.results(spark, d)).withColumnRenamed("delta_km", "d_dist_km"), path, ["scenario_id", "mode", "d_dist_km", "risk_reduction_pct", "note"])
    rows = ais.read_evaluation(spark, path, ["d_dist_km", "risk_reduction_pct"])
    told = suite.reported(rows, ["scenario_id", "mode", "note"])
    return told.select("scenario_id", "mode", "dist_km", (F.round("risk_reduction", 6) + F.lit(0.0)).alias("risk_reduction"), "note")
