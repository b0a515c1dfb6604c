"""File inventories as tables: what to delete, what is twice, which density file fits a grid.

An inventory has path, ym, type, size and mtime; nothing here touches a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_of(name: Column) -> Column:
    """The six digits of a year and month in a file name, NULL without any."""
    found = F.regexp_extract(name, r"((?:19|20)\d{2}(?:0[1-9]|1[0-2]))", 1)
    return F.when(found != "", found)


def type_of(name: Column, marks: dict[str, str]) -> Column:
    """Type by the first mark that the name holds; others are blocks."""
    kind = F.lit("block")
    for mark, value in reversed(marks.items()):
        kind = F.when(F.lower(name).contains(mark), value).otherwise(kind)
    return kind


def ranked_candidates(files: DataFrame, exact: Column, demo: Column) -> DataFrame:
    """Density files by how well they fit, exact before demo before any; training files are none."""
    rank = F.when(exact, 0).when(demo, 1).otherwise(2)
    return files.filter(~F.lower("path").contains("train")).withColumn("rank", rank)


def newest_of_each(files: DataFrame) -> DataFrame:
    """Marks the newest file of a month and type (then the largest, then the last path) as kept (A35, W10); others name it."""
    best = F.max(F.struct("mtime", "size", "path")).over(Window.partitionBy("ym", "type"))
    named = F.col("ym").isNotNull() & F.col("type").isNotNull()
    keep = F.when(named, best["path"]).otherwise(F.col("path"))
    return files.withColumn("keep", keep).withColumn("redundant", F.col("path") != keep)


def clean_plan(files: DataFrame, priority: Column, keep_months: int, limit: int | None, protected: tuple[str, ...] = (), types: tuple[str, ...] | None = None) -> DataFrame:
    """Files to delete until the inventory fits ``limit`` bytes, or all that may go without a limit.

    The last ``keep_months`` months and the protected ones stay.  First go low priorities, then old months, then
    large files.  The running total is taken over groups of priority and month first, then within a group, so
    no window holds the whole inventory.
    """
    months = files.filter("ym is not null").select("ym").distinct()
    recent = months.orderBy(F.desc("ym")).limit(keep_months).withColumn("_recent", F.lit(True))
    marked = files.join(F.broadcast(recent), "ym", "left")
    may_go = F.col("_recent").isNull() & ~F.coalesce(F.col("ym").isin(*protected) if protected else F.lit(False), F.lit(False))
    if types is not None:
        may_go = may_go & F.col("type").isin(*types)
    rows = marked.filter(may_go).drop("_recent").withColumns({"priority": priority, "_month": F.coalesce("ym", F.lit(""))})
    if limit is None:
        return rows.drop("_month")
    w = Window.partitionBy(F.lit(0)).orderBy("priority", "_month").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("priority", "_month").agg(F.sum("size").alias("_bytes"))
    groups = groups.select("priority", "_month", F.coalesce(F.sum("_bytes").over(w), F.lit(0)).alias("_before"))  # one row a month and type
    inside = Window.partitionBy("priority", "_month").orderBy(F.desc("size"), "path").rowsBetween(Window.unboundedPreceding, -1)
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_total"))
    placed = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(groups, ["priority", "_month"]).crossJoin(F.broadcast(total))
    return placed.filter(F.col("_total") - F.col("_before") - F.col("_inside") > limit).drop("_month", "_inside", "_before", "_total")


def expired(files: DataFrame, now: int, age: int, protected: tuple[str, ...] = ()) -> DataFrame:
    """Files last changed more than ``age`` before ``now``, but for those of protected months (A53); the rest of A53 is ``clean_plan``."""
    kept = F.coalesce(F.col("ym").isin(*protected), F.lit(False)) if protected else F.lit(False)
    return files.filter((F.col("mtime") < now - age) & ~kept)
