"""Loose records: detection, normalising, encounters of two ships, and rules on conditions along a voyage."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.numbers import finite

TEXT_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy/MM/dd HH:mm:ss")
# fixed values: words that tell what a field means
KEYWORDS = {"lat": ("lat",), "lon": ("lon", "lng"), "mmsi": ("mmsi",), "time": ("time", "date"), "speed": ("sog", "speed"), "course": ("cog", "course"), "type": ("type",)}
FORECASTS = ("Clear", "Partly Cloudy", "Overcast", "Snow", "Blizzard")


def json_layout(head: str) -> str:
    """What the first characters of a file look like: list, dict, jsonl or unknown (S06); decides multiLine."""
    text = head.lstrip("﻿ \t\r\n")
    if text.startswith("["):
        return "list"
    if not text.startswith("{"):
        return "unknown"
    first = text.split("\n", 1)[0]
    try:
        whole = isinstance(json.loads(first), dict)
    except ValueError:
        return "dict"
    return "jsonl" if whole and "\n" in text.rstrip() else "dict"


def in_text_month(text: Column, month: str) -> Column:
    """Whether a time text lies in a month (yyyyMM): four formats, then the text's first seven characters."""
    parsed = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in TEXT_FORMATS))
    prefix = F.regexp_replace(F.substring(text, 1, 7), "[-/]", "")
    by_prefix = (F.length(text) >= 7) & (prefix == month)
    return F.coalesce(F.when(parsed.isNotNull(), F.date_format(parsed, "yyyyMM") == month).otherwise(by_prefix), F.lit(False))


def field_meanings(fields: DataFrame) -> DataFrame:
    """Guessed meaning of each field name, the first keyword that it contains."""
    name = F.lower("field")
    guess = F.coalesce(*(F.when(F.greatest(*(F.contains(name, F.lit(w)) for w in (*words, words[0]))), meaning) for meaning, words in KEYWORDS.items()))
    return fields.withColumn("meaning", guess)


def epoch_seconds(text: Column) -> Column:
    """Epoch seconds of a text in seconds, milliseconds (over 1e11) or ISO form; NULL otherwise."""
    number = text.try_cast("double")
    iso = F.unix_timestamp(F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in TEXT_FORMATS)))
    return F.when(number.isNotNull(), F.floor(F.when(number > 1e11, number / 1000).otherwise(number))).otherwise(iso).cast("long")


def normalised_records(records: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Records under canonical names, whatever the case of theirs (A40); incomplete or invalid ones go.

    ``keys`` maps a name to the canonical one; mmsi, ts, lat and lon are required.
    """
    have = {c.lower(): c for c in records.columns}
    out: dict[str, list[Column]] = {}
    for name, to in [*keys.items(), *((to, to) for to in keys.values())]:
        if name.lower() in have:
            out.setdefault(to, []).append(F.col(f"`{have[name.lower()]}`").cast("string"))
    value = {to: F.coalesce(*c) for to, c in out.items()}
    missing = F.lit(None).cast("string")
    typed = {"mmsi": value.get("mmsi", missing).try_cast("long"), "ts": epoch_seconds(value.get("ts", missing)), **{c: value.get(c, missing).try_cast("double") for c in ("lat", "lon", "sog", "cog")}}
    rows = records.select(*(c.alias(k) for k, c in typed.items()), *(c.alias(k) for k, c in value.items() if k not in typed))
    return rows.filter("mmsi is not null and ts is not null and lat between -90 and 90 and lon between -180 and 180")


def alerts(conditions: DataFrame) -> DataFrame:
    """Alerts that fixed rules raise on iceberg, wind, ice and congestion."""
    # fixed values: column, bound, kind, severity
    rules = (("iceberg", 70, "Collision", "High"), ("wind", 30, "Weather", "Medium"), ("ice", 80, "Weather", "High"), ("congestion", 80, "Traffic", "Medium"))
    raised = F.filter(F.array(*(F.when(F.col(c) > bound, F.struct(F.lit(c).alias("cause"), F.lit(kind).alias("kind"), F.lit(level).alias("severity"))) for c, bound, kind, level in rules)), lambda x: x.isNotNull())
    return conditions.select("*", F.explode(raised).alias("_a")).select(*conditions.columns, "_a.*")


def in_any_box(points: DataFrame, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Points with whether they lie in one of a few boxes (south, north, west, east)."""
    inside = F.lit(False)
    for south, north, west, east in boxes:
        inside = inside | (F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return points.withColumn("in_water", F.coalesce(inside, F.lit(False)))


def port_distances(pairs: DataFrame) -> DataFrame:
    """Whole kilometres between two places."""
    return pairs.withColumn("km", F.round(haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))).cast("long"))


def waypoints(legs: DataFrame, ports: DataFrame, known: DataFrame) -> DataFrame:
    """Way points of a leg (a, b) by its a-b key, or its two ports where none are predefined."""
    start = ports.select(F.col("port").alias("a"), F.struct("lat", "lon").alias("pa"))
    end = ports.select(F.col("port").alias("b"), F.struct("lat", "lon").alias("pb"))
    keyed = legs.join(start, "a").join(end, "b").withColumn("key", F.concat_ws("-", "a", "b"))
    return keyed.join(known.select("key", "points"), "key", "left").select("a", "b", F.coalesce("points", F.array("pa", "pb")).alias("points"))


def base_conditions(lat: Column, month: Column) -> dict[str, Column]:
    """Base temperature and wind by hemisphere and season (T05); May to September is summer."""
    summer = month.between(5, 9)
    return {"temperature": F.when(lat > 0, F.when(summer, -5).otherwise(-25)).otherwise(F.when(summer, 0).otherwise(-15)), "wind": F.when(summer, 15).otherwise(25)}


def cluster_summary(ships: DataFrame) -> DataFrame:
    """Ships, centre and mean speed of each cluster."""
    return ships.groupBy("cluster").agg(F.count("*").alias("ships"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg(finite("sog")).alias("mean_speed"))


def visibility(value: Column) -> Column:
    """Class of a value within 0..1."""
    return F.when(value < 0.33, "Poor").when(value < 0.66, "Moderate").when(value.isNotNull(), "Good")


def forecast(value: Column) -> Column:
    """Weather word of a value within 0..1."""
    return F.element_at(F.array(*(F.lit(x) for x in FORECASTS)), F.least(F.lit(len(FORECASTS)), F.floor(value * len(FORECASTS)).cast("int") + 1))


def every_kth(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """Every k-th row of each group in order, its first included."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return rows.withColumn("_n", n).filter(F.col("_n") % k == 0).drop("_n")


def stacked(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of frames one after another, by column name; a missing column is NULL."""
    for f in others:
        first = first.unionByName(f, allowMissingColumns=True)
    return first


def flattened(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """A struct column as columns with a prefix."""
    inner = [f.name for f in rows.schema[column].dataType.fields]
    return rows.select(*(c for c in rows.columns if c != column), *(F.col(f"{column}.{c}").alias(f"{prefix}{c}") for c in inner))
