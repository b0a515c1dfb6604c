"""Order statistics of whole tables: values are counted in ranges, and the range that holds a rank is counted again.

No row is sorted and nothing grows with the number of distinct values: a pass is one grouped count of at most ``BINS`` ranges
for each rank that is looked for, whose ends are the smallest and largest value met in them, so that every pass
narrows every range.  A range of few rows is read as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, floor
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite

BINS = 1024
FEW = 4096  # rows of a range that are read as they are
CLASSES = 64


@dataclass(frozen=True)
class _Range:
    group: Any
    low: Any
    high: Any
    below: int  # rows of the group under the range
    n: int

    def holds(self, value: Column, group: Column) -> Column:
        return group.eqNullSafe(F.lit(self.group)) & (value >= F.lit(self.low)) & (value <= F.lit(self.high))

    def bin(self, value: Column) -> Column:
        """Number of a part of the range: never falls as the value grows, and differs between the ends."""
        if isinstance(self.low, int) and self.high - self.low < 1 << 53:
            share = (value - F.lit(self.low)).cast("double") / float(self.high - self.low)
        else:
            low, high = float(self.low) / 2, float(self.high) / 2
            share = (value.cast("double") / 2 - low) / (high - low)
        return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(share * BINS).cast("int")))


def values_at(rows: DataFrame, value: Column, ranks: Callable[[int], list[int]], group: Column | None = None) -> dict[Any, dict[int, Any]]:
    """Values at the ranks (from 0, in ascending order) that ``ranks`` names for a number of rows, by group.

    Rows without a value do not count.  ``value`` is a long or a double without NaN; groups are few.
    """
    own = F.lit(0) if group is None else group
    rows = rows.select(own.alias("_g"), value.alias("_v")).filter("_v is not null")
    g, v = F.col("_g"), F.col("_v")
    first = rows.groupBy(g).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).limit(CLASSES + 1).collect()
    if len(first) > CLASSES:
        raise ValueError(f"more than {CLASSES} groups")
    found: dict[Any, dict[int, Any]] = {r["_g"]: {} for r in first}
    sought: dict[_Range, list[int]] = {}
    for r in first:
        wanted = sorted({k for k in ranks(r["n"]) if 0 <= k < r["n"]})
        if wanted:
            sought[_Range(r["_g"], r["low"], r["high"], 0, r["n"])] = wanted
    while sought:
        for x in [x for x in sought if x.low == x.high]:
            found[x.group] |= dict.fromkeys(sought.pop(x), x.low)
        few, many = [x for x in sought if x.n <= FEW], [x for x in sought if x.n > FEW]
        if few:
            met = _numbered(rows, few, lambda x: v).groupBy("k", "b").agg(F.count("*").alias("n")).collect()
            for k, x in enumerate(few):
                _pick(found[x.group], sought.pop(x), x.below, sorted((r["b"], r["n"]) for r in met if r["k"] == k))
        if many:
            met = _numbered(rows, many, lambda x: x.bin(v)).groupBy("k", "b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
            for k, x in enumerate(many):
                below, wanted = x.below, sought.pop(x)
                for r in sorted((r for r in met if r["k"] == k), key=lambda r: r["b"]):
                    inside = [w for w in wanted if below <= w < below + r["n"]]
                    if inside:
                        sought[_Range(x.group, r["low"], r["high"], below, r["n"])] = inside
                    below += r["n"]
    return found


def _numbered(rows: DataFrame, ranges: list[_Range], what: Callable[[_Range], Column]) -> DataFrame:
    """k, b, v: rows with the numbers of the ranges that hold them (ranges of a group do not overlap)."""
    g, v = F.col("_g"), F.col("_v")
    case = F.lit(None)
    for k, x in reversed(list(enumerate(ranges))):
        case = F.when(x.holds(v, g), F.struct(F.lit(k).alias("k"), what(x).alias("b"))).otherwise(case)
    return rows.select(case.alias("_x"), v.alias("v")).filter("_x is not null").select("_x.k", "_x.b", "v")


def _pick(found: dict[int, Any], wanted: list[int], below: int, counts: list[tuple[Any, int]]) -> None:
    for value, n in counts:
        found |= {w: value for w in wanted if below <= w < below + n}
        below += n


def quantiles(rows: DataFrame, value: Column | str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of the finite values, linear between neighbouring ranks; None without any."""
    at: list[float] = []

    def ranks(n: int) -> list[int]:
        at.extend(s * (n - 1) for s in shares)
        return [f(a) for a in at for f in (floor, ceil)]

    found = values_at(rows, finite(value), ranks).get(0)
    if not found:
        return [None] * len(shares)
    return [found[floor(a)] + (found[ceil(a)] - found[floor(a)]) * (a - floor(a)) for a in at]


def draw_key(columns: list[str], seed: int) -> Column:
    """A number of 60 bits from the values of ``columns`` and a seed, alike in every engine that has MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def smallest(rows: DataFrame, columns: list[str], wanted: Callable[[int], int], seed: int = 42, group: str | None = None) -> DataFrame:
    """Of each group as many rows as ``wanted`` says for its number of rows: those of the smallest draw keys.

    The same rows are drawn wherever and however often it runs.  Rows of one key (rows alike in ``columns``) are taken in no
    stated order where not all of them are.
    """
    keyed = rows.withColumn("_k", draw_key(columns, seed))
    own = F.lit(0) if group is None else F.col(group)
    last = values_at(keyed, F.col("_k"), lambda n: [min(wanted(n), n) - 1], own)
    kept = None
    for g, found in last.items():
        for rank, bound in found.items():
            mine = keyed.filter(own.eqNullSafe(F.lit(g)))
            under = mine.filter(F.col("_k") < bound)
            some = under.unionByName(mine.filter(F.col("_k") == bound).limit(rank + 1 - under.count()))
            kept = some if kept is None else kept.unionByName(some)
    return (keyed.limit(0) if kept is None else kept).drop("_k")
