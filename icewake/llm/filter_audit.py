"""What filters remove in any order, alone and together, from one cube over their failure flags.

Rows are first counted by part and pattern of failed filters, at most 2^n rows a part.  A SQL CUBE over the
flags and the part then has a row for every subset of the filters (those grouped by) and every pattern of it;
the row in which all of them are false counts the survivors of that subset.  A filter applied after others
removes the survivors of the subset before it less those of the subset with it: pairs of subsets that differ in
one filter are joined, and every step of every order looks up its pair.

Defined results: a null text is empty, a null part the empty string, a null flag false; a null doc_id has no
smaller one and so repeats nothing, and meets no label; repeated rows count as often as they occur; several
labels of a document count as the largest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

FILTERS = ("A", "B", "C", "D", "E")
MOST = 6  # filters: every order of them is reported
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and flags A to E of every document: short, repetitive, capitals, symbols, repeated text.

    A whole text that occurs under a smaller doc_id fails E.  The smallest id of each text is found by a grouped
    minimum, and rows are matched with it by id, so a text that very many documents share is no hot key.
    """
    text, words = F.coalesce("text", F.lit("")), F.col("words")
    read = docs.select(F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    split = read.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    flags = split.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        (F.size(words) < 200).alias("A"),
        (100 * F.size(F.array_distinct(words)) < 50 * F.size(words)).alias("B"),
        (100 * (F.length("text") - F.length(F.translate("text", CAPITALS, ""))) > 2 * F.length("text")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    )
    flags = materialise(flags, "flags")  # texts are read and split once
    firsts = flags.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    met = flags.join(firsts, ["doc_id", "digest"], "left")
    return met.select("doc_id", "part", "A", "B", "C", "D", (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("E"))


def with_labels(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """``flags`` with ``good`` and ``toxic``, 1 where a label says so, else 0."""
    marks = [F.max((F.col(c) == 1).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*marks)
    return flags.join(marked, "doc_id", "left")


def subset_survivors(flagged: DataFrame, filters: tuple[str, ...] = FILTERS, measures: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """whole, part, subset, n and sums of ``measures``: rows that fail no filter of each subset.

    Bit k of ``subset`` stands for ``filters[k]``.  Rows with ``whole`` cover all parts together.  Subsets without
    survivors have rows of zeros.
    """
    if not 1 <= len(filters) <= MOST:
        raise ValueError(f"between 1 and {MOST} filters, not {len(filters)}")
    given = flagged.select(F.col("part"), *(F.coalesce(F.col(f), F.lit(False)).alias(f) for f in filters), *(F.coalesce(F.col(m), F.lit(0)).cast("long").alias(m) for m in measures))
    patterns = given.groupBy("part", *filters).agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in measures))
    patterns = materialise(patterns, "patterns")  # all that follows is a few rows a part
    sums = [F.sum(m).alias(m) for m in ("n", *measures)]
    subset = sum(((1 - F.grouping(f)).cast("int") * (1 << k) for k, f in enumerate(filters)), F.lit(0))
    cube = patterns.cube(*filters, "part").agg(*sums, subset.alias("subset"), (F.grouping("part") == 1).alias("whole"))
    none_fails = ~F.coalesce(F.greatest(*(F.col(f).cast("int") for f in filters), F.lit(0)), F.lit(0)).cast("boolean")
    survivors = cube.filter(none_fails).select("whole", F.coalesce("part", F.lit("")).alias("part"), "subset", "n", *measures)
    every = F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset")
    parts = patterns.select(F.lit(False).alias("whole"), "part").union(patterns.select(F.lit(True), F.lit("").alias("part"))).distinct()
    dense = parts.select("whole", "part", every).join(survivors, ["whole", "part", "subset"], "left")
    return dense.na.fill(0, ["n", *measures])


def order_steps(survivors: DataFrame, filters: tuple[str, ...] = FILTERS, measures: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """A row for each part, order of ``filters`` and step, from the rows of ``subset_survivors``."""
    n = len(filters)
    every = (1 << n) - 1
    bits = F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), F.lit(1 << k).alias("bit")) for k, f in enumerate(filters)))).alias("f")
    before = survivors.select("*", bits).filter(F.col("subset").bitwiseAND(F.col("f.bit")) == 0)
    before = before.select("whole", "part", "f.filter", F.col("subset").alias("before"), F.col("subset").bitwiseOR(F.col("f.bit")).alias("subset"), *(F.col(m).alias(f"{m}_before") for m in ("n", *measures)))
    pairs = before.join(survivors, ["whole", "part", "subset"]).select("whole", "part", "filter", "before", F.col("n").alias("kept"), *((F.col(f"{m}_before") - F.col(m)).alias(name) for m, name in (("n", "removed"), *((m, f"{m}_lost") for m in measures))))
    size = F.bit_count("before")
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)).cast("long") for k in range(n))), size + 1)
    alone = pairs.groupBy("whole", "part", "filter").agg(
        F.max(F.when(size == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(size == n - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * orders).alias("shapley"),
    )
    place = {f: 1 << k for k, f in enumerate(filters)}
    rows = [("".join(p), k + 1, p[k], sum(place[f] for f in p[:k])) for p in permutations(filters) for k in range(n)]
    assert every == sum(place.values())
    steps = survivors.sparkSession.createDataFrame(rows, "filter_order string, step int, filter string, before int")
    joined = pairs.join(alone, ["whole", "part", "filter"]).join(F.broadcast(steps), ["filter", "before"])  # n! * n rows, n <= MOST
    return joined.select("whole", "part", "filter_order", "step", "filter", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *(f"{m}_lost" for m in measures), "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Steps of all orders of the five filters within each part, and over all parts (rows with ``whole``)."""
    survivors = materialise(subset_survivors(with_labels(failures(docs), labels)), "survivors")
    return order_steps(survivors)


# The oracle follows every pattern of failures through every order, without subsets.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT doc_id, part,
    (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
p AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT x1.c || x2.c || x3.c || x4.c || x5.c AS filter_order, [x1.b, x2.b, x3.b, x4.b, x5.b] AS bits FROM x x1, x x2, x x3, x x4, x x5
    WHERE (x1.b | x2.b | x3.b | x4.b | x5.b) = 31),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS earlier FROM o, range(1, 6) AS r(step)),
r AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN fails & (earlier | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & earlier = 0 AND fails & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & earlier <> 0 AND fails & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & earlier = 0 AND fails & own <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & earlier = 0 AND fails & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM p, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
