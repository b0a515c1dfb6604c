"""Reading vessel-tracking files whose layout varies, and writing results.

Field names are looked up in candidate lists, whatever the letter case; what is missing is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.points import first_of

# fixed values: names under which tracking files carry each field
CANDIDATES: dict[str, list[str]] = {
    "mmsi": ["mmsi", "ship_id"],
    "ts": ["timestamp", "basedatetime", "datetime", "time", "basedatetimeutc", "postime", "ts"],
    "lat": ["lat", "latitude"],
    "lon": ["lon", "lng", "longitude"],
    "sog": ["sog", "speed", "sog_knots"],
    "cog": ["cog", "course", "cog_deg"],
    "nav_status": ["nav_status", "navstatus", "status"],
}
TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss"]


def parsed_time(text: Column) -> Column:
    """First of the known formats that reads the text, else NULL."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS))


def standard_points(raw: DataFrame) -> DataFrame:
    """mmsi, ts, lat, lon, sog, cog, nav_status from columns of any known name."""
    text = {k: first_of(raw, v).cast("string") for k, v in CANDIDATES.items()}
    number = lambda k, kind: text[k].try_cast(kind)
    return raw.select(
        number("mmsi", "long").alias("mmsi"),
        parsed_time(text["ts"]).alias("ts"),
        *(number(k, "double").alias(k) for k in ("lat", "lon", "sog", "cog")),
        text["nav_status"].alias("nav_status"),
    )


def _with_position(raw: DataFrame) -> DataFrame:
    """A file without a known name for lat or lon: the first column whose name holds it stands in."""
    have = {c.lower() for c in raw.columns}
    for name in ("lat", "lon"):
        if not have & set(CANDIDATES[name]):
            like = next((c for c in raw.columns if name in c.lower()), None)
            raw = raw if like is None else raw.withColumnRenamed(like, name)
    return raw


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Points of CSV files with a header (S01, S03); rows without a position are left out."""
    return placed(_csv(spark, path))


def _csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return standard_points(_with_position(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)))


def placed(points: DataFrame) -> DataFrame:
    """Points that have a position."""
    return points.filter("lat is not null and lon is not null")


def csv_totals(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of CSV files, and how many of them are points: one row."""
    return _csv(spark, path).agg(F.count("*").alias("total"), F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("parsed"))


def read_folder(spark: SparkSession, folder: str, prefer_json: bool = False) -> DataFrame:
    """Points of all CSV files of a folder, or, if preferred and there are any, those of its JSON files in their place."""
    if prefer_json:
        told = read_json_records(spark, f"{folder}/*.json")
        if not told.isEmpty():
            return told
    return read_csv(spark, f"{folder}/*.csv")


def read_json_lines(spark: SparkSession, path: str | list[str], month: str | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Points of line JSON, and the number of lines that are no JSON (S09, A31); GeoJSON features are flattened.

    With ``month`` (yyyyMM) only points of it, with ``most`` at most so many of them; bad lines are counted over the whole files.
    """
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("v"), F.trim("value").alias("t")).filter("t <> ''")
    points = from_variant(lines.filter("v is not null").select("v"))
    if month is not None:
        points = points.filter(F.date_format("ts", "yyyyMM") == month)
    return points if most is None else points.limit(most), lines.agg(F.count_if(F.col("v").isNull()).alias("bad_lines"))


def read_json_records(spark: SparkSession, path: str | list[str], depth: int = 4) -> DataFrame:
    """Points of whole-file JSON: lists, and lists under ``data``, in one another down to ``depth`` levels.

    What is no object, and objects without a position, are left out; lists nested deeper are an error.
    """
    whole = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v")).filter("v is not null")
    inner = "coalesce(try_variant_get(x, '$.data', 'array<variant>'), try_variant_get(x, '$', 'array<variant>'), array(x))"
    items = whole.selectExpr("array(v) as items")
    for _ in range(depth):
        items = items.selectExpr(f"flatten(transform(items, x -> {inner})) as items")
    each = items.selectExpr("explode(items) as v").selectExpr("v", "schema_of_variant(v) as kind")
    deeper = "kind like 'ARRAY%' or try_variant_get(v, '$.data', 'array<variant>') is not null"
    whole_depth = each.filter(f"if({deeper}, raise_error('lists are nested deeper than {depth} levels'), kind like 'OBJECT%')")
    return placed(from_variant(whole_depth.select("v")))


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header in a fixed column order, or that of ``rows`` (S23); columns that ``rows`` lacks, and NULL, are empty."""
    have = {c.lower() for c in rows.columns}
    out = rows.select(*(F.col(c) if c.lower() in have else F.lit(None).cast("string").alias(c) for c in columns or rows.columns))
    out.write.mode("errorifexists").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def read_evaluation(spark: SparkSession, path: str | list[str], numbers: list[str]) -> DataFrame:
    """Evaluation tables as CSV (S25): ``numbers`` are read as doubles, NULL where they are none; other columns stay text."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    wanted = {n.lower() for n in numbers}
    return raw.select(*(F.col(c).try_cast("double").alias(c) if c.lower() in wanted else F.col(c) for c in raw.columns))


def from_variant(rows: DataFrame) -> DataFrame:
    """Standard points of one variant column ``v``; properties and coordinates of GeoJSON count as fields; what is no object has none."""
    fields = rows.selectExpr("coalesce(try_variant_get(v, '$.properties', 'map<string, variant>'), try_variant_get(v, '$', 'map<string, variant>')) as m", "v")
    lower = fields.withColumn("m", F.transform_keys("m", lambda k, _: F.lower(k)))
    pick = lambda names: F.coalesce(*(F.expr(f"try_variant_get(try_element_at(m, '{n}'), '$', 'string')") for n in names))
    flat = lower.select(*(pick(v).alias(k) for k, v in CANDIDATES.items()), "v")
    lon, lat = (F.expr(f"try_variant_get(v, '$.geometry.coordinates[{k}]', 'string')") for k in (0, 1))
    return standard_points(flat.withColumns({"lat": F.coalesce("lat", lat), "lon": F.coalesce("lon", lon)}).drop("v"))


def write_cells(cells: DataFrame, path: str) -> None:
    """A layer or density as Parquet, split by grid."""
    cells.write.mode("errorifexists").option("compression", "snappy").partitionBy("grid_id").parquet(path)
