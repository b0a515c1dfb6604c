"""Centroid clustering with ball trees that Spark builds once and filters in every round.

Vectors become integers, so that sums, means and distances are exact whatever the order of work.  Tasks deal
their rows into blocks of bounded size and build a metric tree over each block; a node keeps the number,
the integer sum and the radius of its vectors, its ball.  Trees are written to the shared folder, once.  A round sends
the centroids, at most a stated number, to all trees.  By the triangle inequality a centroid whose distance from a ball's
centre exceeds that of the nearest centroid by more than twice the radius is nearest to none of its vectors: where
one centroid is left, the ball goes to it whole, as its number and sum; else its halves are looked at, down to
leaves, whose vectors are compared exactly with the centroids left.  Counts and sums of each centroid are added
within a task, then by Spark.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part;
a component whose integer leaves 27 bits raises an error, as squared distances would leave a long; a vector
without an id is clustered but is no starting centroid; repeated rows count as often as they occur; with
fewer vectors than centroids every vector with an id starts one; ties of distance go to the smaller number, ties of the starting
order to the smaller vector; without vectors with ids there are no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

BLOCK = 8192  # vectors of a tree
LEAF = 32
CENTROIDS = 4096  # at most: their components go to every task
REACH = 1 << 27  # of an integer component

_TREE = "ids array<long>, width int, points binary, starts binary, ends binary, lefts binary, counts binary, sums binary, radii binary"


def integer_vectors(embeddings: DataFrame, size: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and v: floor(scale * x) of every component of the vectors that take part."""
    x = F.col("embedding")
    clean = F.coalesce((F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    fits = F.forall(x, lambda c: F.abs(c.cast("double") * scale) < float(REACH))
    v = F.when(fits, F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int"))).otherwise(F.raise_error(F.lit("a component leaves the range of exact distances")))
    return embeddings.filter(clean).select(F.col("vec_id").cast("long"), v.alias("v"))


def _split(x: np.ndarray) -> np.ndarray:
    """Order of the rows by their place between two far ones."""
    one = ((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()
    other = ((x - x[one]) ** 2).sum(axis=1).argmax()
    return np.argsort(x @ (x[other] - x[one]), kind="stable")


class BallTree:
    """Nodes over one block of integer vectors: parents before children, a node's vectors side by side."""

    def __init__(self, points: np.ndarray, starts, ends, lefts, counts, sums, radii):
        self.points, self.starts, self.ends, self.lefts, self.counts, self.sums, self.radii = points, starts, ends, lefts, counts, sums, radii

    @staticmethod
    def build(points: np.ndarray) -> tuple[np.ndarray, BallTree]:
        """The order of the rows in the tree, and the tree."""
        order, x = np.arange(len(points)), points.astype(np.float64)
        spans, lefts, at = [(0, len(points))], [], 0
        while at < len(spans):
            lo, hi = spans[at]
            if hi - lo > LEAF:
                own = order[lo:hi]
                order[lo:hi] = own[_split(x[own])]
                half = (lo + hi) // 2
                lefts.append(len(spans))
                spans += [(lo, half), (half, hi)]
            else:
                lefts.append(-1)
            at += 1
        inside = points[order]
        starts, ends = np.array(spans, dtype=np.int64).T
        running = np.vstack([np.zeros(points.shape[1], dtype=np.int64), inside.astype(np.int64).cumsum(axis=0)])
        sums, counts = running[ends] - running[starts], ends - starts
        radii = np.array([np.sqrt(((inside[a:b] - s / n) ** 2).sum(axis=1).max()) for a, b, s, n in zip(starts, ends, sums, counts, strict=True)])
        return order, BallTree(inside, starts, ends, np.array(lefts, dtype=np.int64), counts, sums, radii)

    def filtered(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whole nodes and their centroid; single rows, their centroid and squared distance."""
        c = centroids.astype(np.float64)
        norms = (c**2).sum(axis=1)
        nodes, left = np.zeros(1, dtype=np.int64), np.ones((1, len(c)), dtype=bool)
        whole, whole_to, leaves, leaf_left = [], [], [], []
        while len(nodes):
            centre = self.sums[nodes] / self.counts[nodes][:, None]
            own = (centre**2).sum(axis=1)
            far = np.sqrt(np.maximum(own[:, None] - 2 * centre @ c.T + norms, 0))
            far[~left] = np.inf
            near = far.min(axis=1)
            slack = 1e-6 * (1 + np.sqrt(own) + np.sqrt(norms.max()))  # above what rounding moves a distance
            left &= far <= (near + 2 * self.radii[nodes] + slack)[:, None]
            lone, leaf = left.sum(axis=1) == 1, self.lefts[nodes] < 0
            whole.append(nodes[lone])
            whole_to.append(left[lone].argmax(axis=1))
            leaves.append(nodes[~lone & leaf])
            leaf_left.append(left[~lone & leaf])
            down = ~lone & ~leaf
            nodes, left = np.concatenate([self.lefts[nodes[down]], self.lefts[nodes[down]] + 1]), np.concatenate([left[down], left[down]])
        ends = np.concatenate(leaves)
        sizes = self.counts[ends]
        rows = np.repeat(self.starts[ends] - np.r_[0, sizes.cumsum()[:-1]], sizes) + np.arange(sizes.sum()) if len(ends) else np.zeros(0, dtype=np.int64)
        squares = squared_distances(self.points[rows], centroids)
        squares[~np.repeat(np.concatenate(leaf_left), sizes, axis=0)] = np.iinfo(np.int64).max
        best = squares.argmin(axis=1) if len(rows) else np.zeros(0, dtype=np.int64)
        return np.concatenate(whole), np.concatenate(whole_to), rows, best, squares[np.arange(len(rows)), best]


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact, as long integers: through floating-point products where all of their sums are exact integers."""
    most = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if 4 * int(most) ** 2 * points.shape[1] < 1 << 53 else np.int64
    x, c = points.astype(kind), centroids.astype(kind)
    return ((x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)).astype(np.int64)


def trees(vectors: DataFrame, size: int = 64) -> DataFrame:
    """A row for each block of the rows of a task, its ids and its tree."""

    def row(ids: list, points: np.ndarray) -> pa.RecordBatch:
        order, t = BallTree.build(points)
        most = int(np.abs(t.points).max(initial=0))
        width = next(w for w in (1, 2, 4) if most < 1 << (8 * w - 1))
        parts = [t.points.astype(f"<i{width}"), *(a.astype("<i4") for a in (t.starts, t.ends, t.lefts, t.counts)), t.sums.astype("<i8"), t.radii.astype("<f8")]
        cells = [pa.array([[ids[k] for k in order]], pa.list_(pa.int64())), pa.array([width], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in parts)]
        return pa.RecordBatch.from_arrays(cells, names=["ids", "width", "points", "starts", "ends", "lefts", "counts", "sums", "radii"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK // 2):
                piece = batch.slice(k, BLOCK // 2)
                ids += piece.column(0).to_pylist()
                held.append(piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size))
                if len(ids) > BLOCK // 2:
                    yield row(ids, np.concatenate(held))
                    ids, held = [], []
        if ids:
            yield row(ids, np.concatenate(held))

    return vectors.mapInArrow(build, _TREE)


def _read(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, BallTree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            cell = {n: batch.column(n)[k] for n in batch.schema.names}
            number = lambda n, kind: np.frombuffer(cell[n].as_py(), dtype=kind)  # noqa: B023, E731
            points = number("points", f"<i{cell['width'].as_py()}").astype(np.int64).reshape(-1, size)
            ints = [number(n, "<i4").astype(np.int64) for n in ("starts", "ends", "lefts", "counts")]
            yield cell["ids"].values, BallTree(points, *ints, number("sums", "<i8").reshape(-1, size), number("radii", "<f8"))


def _next_centroids(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floored means of what each centroid is given; those given nothing stay."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
        for _, t in _read(batches, size):
            whole, to, rows, best, _ = t.filtered(centroids)
            np.add.at(counts, to, t.counts[whole])
            np.add.at(sums, to, t.sums[whole])
            np.add.at(counts, best, 1)
            for z in np.unique(best):
                sums[z] += t.points[rows[best == z]].sum(axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    given = forest.mapInArrow(run, "cluster int, n long, sums array<long>")
    each = given.select("cluster", "n", F.posexplode("sums").alias("place", "total"))
    new = centroids.copy()
    for r in each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # k * size numbers
        new[r["cluster"], r["place"]] = r["total"] // r["n"]
    return new


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector of the trees."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, t in _read(batches, size):
            whole, to, rows, best, square = t.filtered(centroids)
            cluster, distance = np.zeros(len(t.points), dtype=np.int64), np.zeros(len(t.points), dtype=np.int64)
            cluster[rows], distance[rows] = best, square
            for node, z in zip(whole, to, strict=True):
                a, b = t.starts[node], t.ends[node]
                cluster[a:b] = z
                distance[a:b] = squared_distances(t.points[a:b], centroids[z : z + 1])[:, 0]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return forest.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """Vectors of the k smallest hashes of ``salt`` and id, in the order of the hashes."""
    hashed = vectors.filter(F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("hash"), "v")
    return np.array([r["v"] for r in hashed.orderBy("hash", "v").limit(k).collect()], dtype=np.int64)


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2:", size: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    if not 1 <= k <= CENTROIDS:
        raise ValueError(f"between 1 and {CENTROIDS} centroids, not {k}")
    spark, vectors = embeddings.sparkSession, integer_vectors(embeddings, size, scale)
    columns = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(vectors, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id long, cluster int, distance long, {columns.partition(', ')[2]}")
    forest = materialise(trees(vectors, size), "trees")
    for _ in range(rounds):
        centroids = _next_centroids(forest, centroids)
    rows = materialise(assigned(forest, centroids), "assigned")
    discard(forest)
    inertia = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(z, s, sum(inertia.values()), digests[z]) for z, s in sorted(inertia.items())], columns)
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # facts: at most k rows


def _oracle(k: int, rounds: int) -> str:
    """The same rounds over all pairs of vectors and centroids."""
    parts = [
        "kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, v AS c FROM kept QUALIFY k < {k})",
    ]
    for r in range(rounds + 1):
        square = "(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c))::BIGINT"
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({{'d': {square}, 'k': k}}) AS best FROM kept, c{r} GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"m{r} AS (SELECT k, i, floor(sum(x) / count(*)) AS x FROM (SELECT best.k AS k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY k, i)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(l, c) AS c FROM c{r} LEFT JOIN (SELECT k, list(x ORDER BY i) AS l FROM m{r} GROUP BY k) USING (k))")
    last = f"""SELECT vec_id, k::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON best.k = c{rounds}.k"""
    return "WITH " + ",\n".join(parts) + "\n" + last


ORACLE = _oracle(40, 5)
