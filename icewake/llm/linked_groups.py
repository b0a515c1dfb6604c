"""Links within groups of rows that may be alike, without emitting all pairs of a group.

Whatever finds candidates (a Hamming table, a bucket of fingerprints) leaves rows ``(key, id)``: ids under
one key may be linked.  In turns, all ids under a key are compared with a few leaders of it, at first one, then another one, then ``GROWTH``
times as many each turn.  Links join ids into classes; a key whose ids are of one class is done, which is most of
them after the first turn, however many ids they hold.  A leader has met all others of its key and leaves it.  Only where few pairs
of different classes are left, or leaders have become very many, all ids under one key that are still in different
classes are compared with each other.  So every pair under a key is either compared or in one class: no link between
classes is lost, and pairs within a class are never expanded.

Defined results: without rows there are no links; an id that is alone under its keys has none; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .components import connected_components

PAIRS_A_ROW = 4  # pairs between classes, for each row of the groups, that are few
GROWTH = 4  # times as many leaders a turn, from the third on
LEADERS = 512  # of a key in one turn, at most


def class_links(met: DataFrame, verified: Callable[[DataFrame], DataFrame], near: Column | bool = True) -> DataFrame:
    """``(a, b)``, a < b: verified links that join all ids of each class.

    ``met`` has key, id and what ``near``, a symmetric condition over two of its rows (aliases one and two)
    that all links meet, reads, which an id has alike under all its keys; ``verified`` keeps the true ones of pairs ``(a, b)``,
    with the columns they come with.  Of the links that a turn finds between two classes one is kept.
    """
    met = met.dropDuplicates(["key", "id"])
    rows = met.count()
    tried: list[DataFrame] = []
    links: list[DataFrame] = []
    placed, leaders, count, written = met.withColumn("root", F.col("id")), None, 1, None
    while True:
        every = leaders is not None and (count > LEADERS or _crossing(placed) <= PAIRS_A_ROW * rows)
        leaders = placed if every else materialise(_leaders(placed, count), "leaders")
        pairs = _pairs(placed, leaders, near, every)
        for before in tried:
            pairs = pairs.join(before.select("a", "b"), ["a", "b"], "left_anti")
        tried.append(materialise(pairs, "tried"))
        links.append(materialise(verified(tried[-1]).dropDuplicates(["low", "high"]).select("a", "b"), "links"))
        if every or rows == 0:
            break
        together = materialise(_union(links), "all_links")
        roots = connected_components(together)
        apart = materialise(_apart(_rooted(placed.drop("root"), leaders, roots)), "apart")
        discard(roots, together, written, leaders)
        placed = written = apart
        count *= GROWTH if len(links) > 1 else 1
        if apart.isEmpty():
            break
    discard(*tried, written)
    return _union(links)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def _rooted(met: DataFrame, leaders: DataFrame, roots: DataFrame) -> DataFrame:
    """``met`` without the leaders of its keys, with the root of each id, itself where it has none; an id is under a bounded number of keys."""
    known = roots.select(F.col("node").alias("id"), "root", F.lit(1).alias("tag"))
    led = leaders.select("key", "id", F.lit(2).alias("tag"))
    both = met.withColumns({"root": F.lit(None).cast("long"), "tag": F.lit(0)}).unionByName(known, allowMissingColumns=True).unionByName(led, allowMissingColumns=True)
    root = F.coalesce(F.max("root").over(Window.partitionBy("id")), "id")
    spread = both.withColumns({"root": root, "led": F.max("tag").over(Window.partitionBy("id", "key"))})
    return spread.filter("tag = 0 and led = 0").select(*met.columns, "root")


def _apart(rooted: DataFrame) -> DataFrame:
    """Rows of the keys whose ids are of several classes; ids of a key that are of one class stay so.

    No join: what is left is part of ``rooted``, which has as many rows an id as that has keys, however large a group is.
    """
    own = Window.partitionBy("key")
    ends = rooted.withColumns({"_low": F.min("root").over(own), "_high": F.max("root").over(own)})
    return ends.filter("_low <> _high").drop("_low", "_high")


def _crossing(apart: DataFrame) -> int:
    """Pairs of different classes under the keys, counted without making them."""
    sizes = apart.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("twice"))
    return (sizes.agg(F.sum("twice")).first()[0] or 0) // 2


def _leaders(placed: DataFrame, count: int) -> DataFrame:
    """The first rows of each key in an order of ids that all keys share; the smallest id alone at first."""
    if count == 1:
        least = F.min_by(F.struct(*(c for c in placed.columns if c != "key")), "id")
        return placed.groupBy("key").agg(least.alias("leader")).select("key", "leader.*")
    order = Window.partitionBy("key").orderBy(F.xxhash64("id"), "id")
    return placed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= count).drop("place")


def _pairs(placed: DataFrame, leaders: DataFrame, near: Column | bool, every: bool) -> DataFrame:
    """``(a, b, low, high)``, a < b: ids and leaders under one key that are in different classes and near, and the two classes.

    Two of them meet under the smallest key only that they share and that one of them leads.
    """
    keys = F.collect_set("key").over(Window.partitionBy("id"))
    placed, leaders = placed.withColumn("keys", keys), leaders.withColumn("keys", keys)
    cross = (F.col("one.key") == F.col("two.key")) & (F.col("one.root") != F.col("two.root"))
    if every:
        cross &= F.col("one.id") < F.col("two.id")
    if near is not True:
        cross &= near
    cross &= F.array_min(F.array_intersect("one.keys", "two.keys")) == F.col("one.key")
    joined = placed.alias("one").join(leaders.alias("two"), cross)
    ends = [f(f"one.{c}", f"two.{c}").alias(n) for c, names in (("id", ("a", "b")), ("root", ("low", "high"))) for f, n in zip((F.least, F.greatest), names, strict=True)]
    return joined.select(*ends).distinct()
