"""Layers on disk with what they are: a manifest row next to the cells, which readers hold against what they expect.

A layer is a folder with ``cells`` (Parquet, one folder for each grid signature) and ``manifest`` (one row: signature, cells,
checksum, provenance).  Any Hadoop path works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.density import signature


class SignatureMismatch(ValueError):
    """A layer is of another grid, or not whole."""


def _check() -> list[Column]:
    return [F.count("*").alias("cells"), F.coalesce(F.sum(F.xxhash64("i", "j", F.round(F.col("value").cast("double"), 9)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("checksum")]


def write_layer(cells: DataFrame, path: str, provenance: dict[str, str] | None = None) -> str:
    """Writes ``cells`` (i, j, lat, lon, value) and their manifest; returns the signature.

    A folder that exists is an error.  The manifest is written last: a folder without one is no layer.
    """
    spark = cells.sparkSession
    sign = signature(cells).first()["signature"]
    if cells.isEmpty():
        raise SignatureMismatch("a layer without cells has no signature")
    cells.select("i", "j", "lat", "lon", "value", F.lit(sign).alias("grid")).write.mode("errorifexists").option("compression", "snappy").partitionBy("grid").parquet(f"{path}/cells")
    held = spark.read.parquet(f"{path}/cells").agg(*_check())
    known = provenance or {}
    notes = F.map_from_arrays(F.array(*(F.lit(k) for k in known)), F.array(*(F.lit(str(v)) for v in known.values()))) if known else F.create_map().cast("map<string,string>")
    held.select(F.lit(sign).alias("signature"), "cells", "checksum", notes.alias("provenance")).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")
    return sign


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """signature, cells, checksum, provenance: one row."""
    return spark.read.parquet(f"{path}/manifest")


def read_layer(spark: SparkSession, path: str, expected: str | None = None, whole: bool = True) -> DataFrame:
    """The cells of a layer; one of another signature than ``expected``, or that differs from its manifest, is refused."""
    told = read_manifest(spark, path).first()
    if expected is not None and told["signature"] != expected:
        raise SignatureMismatch(f"{path} is of grid {told['signature']}, not {expected}")
    cells = spark.read.parquet(f"{path}/cells").filter(F.col("grid") == told["signature"]).drop("grid")
    if whole:
        held = cells.agg(*_check()).first()
        if (held["cells"], held["checksum"]) != (told["cells"], told["checksum"]):
            raise SignatureMismatch(f"{path} does not hold what its manifest says")
    return cells


def read_parquet_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """All Parquet files that a pattern names, with their paths (S22); columns that a file lacks are NULL."""
    return spark.read.option("mergeSchema", "true").parquet(pattern).withColumn("path", F.input_file_name())


def scan_files(spark: SparkSession, pattern: str, kinds: dict[str, str], digest: bool = True) -> DataFrame:
    """path, ym, type, size, mtime and sha1 of all files below a pattern.

    Paths tell month and type; without ``digest`` no content is read.  Spark's reader leaves out files without content.
    """
    from ..operators.inventory import month_of, type_of

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(pattern)
    content = F.sha1("content") if digest else F.lit(None).cast("string")
    return files.select("path", month_of(F.col("path")).alias("ym"), type_of(F.col("path"), kinds).alias("type"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), content.alias("sha1"))
