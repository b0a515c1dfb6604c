"""Approximate nearest neighbours over several shifted Hilbert orderings.

Every curve projects the vectors to a few dimensions, shifts them, and orders them by their Hilbert
index.  Spark range-partitions the rows by index and numbers them, so that a row's neighbours on the
curve are the rows of nearby rank whatever the skew.  Ranks are cut into blocks of bounded size; each
query visits the blocks its window covers, and the exact distances of all rows met merge over the
curves.  Curves and window are fitted: for a bounded sample of queries the true neighbours are found
against all rows, in blocks, and of all numbers of curves with the least window that meets the wanted share
of the neighbours on some curve, the one that visits the fewest rows is taken.  Vectors in clusters get many
curves and narrow windows; vectors without structure get few curves and wide windows, up to the one curve whose
window is all rows, so no more distances are computed than by brute force, but for rounding to blocks.

Identical vectors are one point with its smallest ids, as many as an answer can need, so no group of
copies is ever large.  Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows without an id, take no part; distances need one length: with one given, vectors
of another take no part, and without, vectors of several lengths are an error; a repeated (id, vector) row counts once, an id with several vectors as several points, of
which an answer names the nearest; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

CURVES = 8  # at most
DIMENSIONS = 6
BITS = 10
BLOCK = 2048
SAMPLE_ROWS = 5000  # rows that fit the ranges of the projections and tell ranks from keys
SAMPLE_QUERIES = 100  # queries that fit the window
COVERAGE = 0.96  # share of the sample's true neighbours that the window has to meet


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells (n, d) with ``bits`` bits a coordinate; needs d * bits <= 63.

    Gray-code form: from the highest bit down, undo the rotation and reflection that each level of
    the curve applies, then interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(d):
            on = (x[i] & level) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[d - 1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Random orthonormal projections with ranges from a sample and a random shift for each curve."""

    def __init__(self, sample: np.ndarray, curves: int, dimensions: int, bits: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bits, d = bits, min(dimensions, sample.shape[1])
        self.axes = [np.linalg.qr(rng.standard_normal((sample.shape[1], d)))[0] for _ in range(curves)]
        self.shift = rng.random((curves, d))
        spread = [sample @ a for a in self.axes]
        self.low = [np.quantile(p, 0.001, axis=0) for p in spread]
        self.high = [np.maximum(np.quantile(p, 0.999, axis=0), lo + 1e-12) for p, lo in zip(spread, self.low)]

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        unit = np.clip((vectors @ self.axes[curve] - self.low[curve]) / (self.high[curve] - self.low[curve]), 0, 1)
        cells = (unit + self.shift[curve]) / 2 * ((1 << self.bits) - 1)
        return hilbert_index(cells.astype(np.int64), self.bits)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))


def points(vectors: DataFrame, k: int, length: int | None = None) -> DataFrame:
    """Distinct usable vectors with their k + 1 smallest ids."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    if length is None:
        sizes = sorted(r["length"] for r in usable.select(F.size("v").alias("length")).distinct().limit(10).collect())
        if len(sizes) > 1:
            raise ValueError(f"vectors of several lengths ({sizes}): state the length of those that take part")
        length = sizes[0] if sizes else 0
    # minus zero and zero are one value; the ranking drops all but k + 1 ids of a vector before the shuffle
    rows = usable.filter(F.size("v") == length).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    least = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    return least.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).withColumn("pid", F.element_at("ids", 1))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the number of each row within it, per curve."""
    part, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        curve = b.column("curve").to_numpy(zero_copy_only=False)
        local = np.empty(len(curve), dtype=np.int64)
        for c in np.unique(curve):
            own = curve == c
            n = int(own.sum())
            local[own] = np.arange(n) + seen.get(c, 0)
            seen[c] = seen.get(c, 0) + n
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(curve), part, dtype=np.int32)), pa.array(local)], names=[*b.schema.names, "part", "local"])


def _top(query: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact distances and positions of at least the k nearest rows of one query, ties included."""
    rough = (rows**2).sum(axis=1) - 2 * rows @ query
    at = np.arange(len(rows))
    if len(rows) > k:
        worst = np.partition(rough, k - 1)[k - 1]
        at = np.flatnonzero(rough <= worst + 1e-9 * (1 + abs(worst) + float(query @ query)))
    exact = np.sqrt(((rows[at] - query) ** 2).sum(axis=1))
    order = np.lexsort((ids[at], exact))[:k]
    return exact[order], at[order]


_FOUND = "query_pid long, pid long, score double"


def _scan(blocks: DataFrame, k: int) -> DataFrame:
    """Nearest points of each query within each block; rows come sorted by block, its points first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, rows = None, [], []
        held: tuple[np.ndarray, np.ndarray] | None = None
        for b in batches:
            key = list(zip(b.column("curve").to_pylist(), b.column("block").to_pylist()))
            visits, pids, v = b.column("visit").to_pylist(), b.column("pid").to_numpy(zero_copy_only=False), _matrix(b.column("v"))
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, (place, visit) in enumerate(zip(key, visits)):
                if place != current:
                    current, ids, rows, held = place, [], [], None
                if not visit:
                    ids.append(pids[i])
                    rows.append(v[i])
                    continue
                if held is None:
                    held = (np.array(ids, dtype=np.int64), np.array(rows).reshape(len(rows), -1))
                if len(held[0]):
                    score, at = _top(v[i], held[1], held[0], k + 1)
                    found.append((np.full(len(at), pids[i]), held[0][at], score))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query_pid", "pid", "score"])

    return blocks.select("curve", "block", "visit", "pid", "v").mapInArrow(run, _FOUND)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, coverage: float = COVERAGE, length: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for ids divisible by ``every``, the k nearest other rows found."""
    spark = vectors.sparkSession
    found = materialise(points(vectors, k, length), "points")
    schema = "query_id long, rank int, vec_id long, score double"
    rows = found.agg(F.sum(F.lit(1))).first()[0] or 0
    if not rows:
        return spark.createDataFrame([], schema)
    by_hash = F.xxhash64("pid")
    sample = np.array([r["v"] for r in found.orderBy(by_hash, "pid").limit(SAMPLE_ROWS).select("v").collect()])
    curves = Curves(sample, CURVES, DIMENSIONS, BITS)
    asked = materialise(_queries(vectors, found, every), "queries")
    query_points = asked.select("pid").distinct()
    chosen, share = cheapest(rank_gaps(curves, sample, *_true_neighbours(found, query_points, k)), coverage)
    window = int(np.ceil(share * rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"))
            for c in range(chosen):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, dtype=np.int32)), pa.array(curves.keys(v, c)), b.column("pid"), b.column("v")], names=["curve", "key", "pid", "v"])

    placed = found.select("pid", "v").mapInArrow(place, "curve int, key long, pid long, v array<double>")
    ordered = placed.repartitionByRange("curve", "key", "pid").sortWithinPartitions("curve", "key", "pid")
    numbered = materialise(ordered.mapInArrow(_number, "curve int, key long, pid long, v array<double>, part int, local long"), "curves")
    counts = numbered.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("curve", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # curves x partitions rows
    ranked = numbered.join(F.broadcast(starts), ["curve", "part"]).select("curve", "pid", "v", (F.col("start") + F.col("local")).alias("at"))
    stored = ranked.select("curve", F.expr(f"at div {BLOCK}").alias("block"), F.lit(False).alias("visit"), "pid", "v")
    own = ranked.join(query_points, "pid")
    last = (rows - 1) // BLOCK
    span = F.sequence(F.greatest(F.lit(0), F.expr(f"(at - {window}) div {BLOCK}")), F.least(F.lit(last), F.expr(f"(at + {window}) div {BLOCK}")))
    visits = own.select("curve", F.explode(span).alias("block"), F.lit(True).alias("visit"), "pid", "v")
    blocks = stored.union(visits).repartition("curve", "block").sortWithinPartitions("curve", "block", "visit")
    near = _scan(blocks, k).groupBy("query_pid", "pid").agg(F.min("score").alias("score"))
    # every point has an id of its own, so k + 1 points are enough for k other ids
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_pid").orderBy("score", "pid"))).filter(F.col("r") <= k + 1)
    members = found.select("pid", "ids")
    listed = near.join(members, "pid").select("query_pid", F.explode("ids").alias("vec_id"), "score")
    answers = asked.join(listed, asked.pid == listed.query_pid).filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _queries(vectors: DataFrame, found: DataFrame, every: int) -> DataFrame:
    """``(query_id, pid)``: every usable row that asks, with the point it lies on."""
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("query_id"), v.alias("v")).filter(F.pmod("query_id", F.lit(every)) == 0).distinct()
    return rows.join(found.select("v", "pid"), "v").select("query_id", "pid")


def _true_neighbours(found: DataFrame, query_points: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a bounded sample of queries, one for each of their k true neighbours, and those neighbours' vectors."""
    sampled = query_points.orderBy(F.xxhash64("pid"), "pid").limit(SAMPLE_QUERIES)
    asked = sampled.join(found.select("pid", "v"), "pid").collect()  # SAMPLE_QUERIES rows
    if not asked:
        return np.empty((0, 0)), np.empty((0, 0))
    q_ids, q = np.array([r["pid"] for r in asked]), np.array([r["v"] for r in asked])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, v = b.column("pid").to_numpy(zero_copy_only=False), _matrix(b.column("v"))
            best = [_top(x, v, ids, k + 1) for x in q]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, [len(s) for s, _ in best])), pa.array(np.concatenate([ids[at] for _, at in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["query_pid", "pid", "score"])

    order = Window.partitionBy("query_pid").orderBy("score", "pid")
    true = found.select("pid", "v").mapInArrow(brute, _FOUND).filter("pid <> query_pid").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    pairs = true.select("query_pid", "pid").join(found.select("pid", "v"), "pid").collect()  # SAMPLE_QUERIES x k rows
    at = {int(i): x for i, x in zip(q_ids, q)}
    return np.array([at[r["query_pid"]] for r in pairs]), np.array([r["v"] for r in pairs])


def rank_gaps(curves: Curves, sample: np.ndarray, queries: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """Share of all rows, told by the sample, that lie between each query and its neighbour on each curve: (CURVES, pairs)."""
    gaps = np.empty((len(curves.axes), len(queries)))
    for c in range(len(gaps) if len(queries) else 0):
        order = np.sort(curves.keys(sample, c))
        rank = lambda v: (np.searchsorted(order, curves.keys(v, c), "left") + np.searchsorted(order, curves.keys(v, c), "right")) / 2
        gaps[c] = (np.abs(rank(queries) - rank(neighbours)) + 1) / len(sample)
    return np.minimum(gaps, 1.0)


def cheapest(gaps: np.ndarray, coverage: float) -> tuple[int, float]:
    """Number of curves and window, as a share of the rows on either side, with the fewest rows visited at this coverage."""
    best = (1, 0.0, np.inf)
    for c in range(1, len(gaps) + 1):
        nearest_curve = np.sort(gaps[:c].min(axis=0))
        if not len(nearest_curve):
            break
        window = float(nearest_curve[min(len(nearest_curve) - 1, int(np.ceil(coverage * len(nearest_curve))))])
        visited = c * min(1.0, 2 * window - window * window)  # windows are cut off at the ends of the curve
        if visited < best[2]:
            best = (c, window, visited)
    return best[:2]
