"""SimHash near-duplicates: exact Hamming linking by the generalised pigeonhole principle.

Fingerprints are 64-bit SimHashes of word shingles.  Two of them within ``tau`` differing bits agree,
for thresholds t_1..t_m whose sum is ``tau - m + 1``, to within t_i bits on at least one of m groups
of bits.  Bits that are correlated over the corpus share a group, and the thresholds, unequal and
possibly -1 (group skipped), come from a dynamic programme over candidate counts, computed for all
distances from the groups' value histograms.  Fingerprints probe the groups' values, and pairs that
meet are verified.  A bucket that grows past ``BUCKET`` is dealt out again by the same principle over
the bits it has not used yet, so no bucket, and no pair within one, has to be dropped.  A bucket
reports a spanning forest of its links, not all its pairs.

For a stated similarity of shingle sets (``similar_classes``) fingerprints are wide: ``LANES`` lanes of 64
bits over rehashed shingles, every lane probed as above, so that a pair has to come close on one of
many lanes only; of those that meet and are near over ``SKETCH`` lanes, the ones whose parities (``parities``) leave the
similarity possible are compared shingle by shingle.

Defined results: null and wordless texts have fingerprint zero, linked like any other; equal
fingerprints are one node, so exact copies never multiply; rows with a repeated doc_id count as one
document; rows without a doc_id link nothing and belong with equal fingerprints, if any; an empty table
gives an empty table; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log2, pi, sqrt
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches
from .components import connected_components
from .linked_groups import class_links

SEED = 42
BUCKET = 4096
GROUPS = 4
WIDTH = 64 // GROUPS
LANES = 12  # lanes of a wide fingerprint, each of them probed
SKETCH = 2  # lanes that go along to drop chance meetings
SURE = 2.33  # standard deviations over all lanes: one pair of a hundred at the similarity itself is outside
ODD = 16  # words of 64 bits that hold the parities of a set of shingles
WHOLE = 512  # shingles up to which the parities are those of all of them
DRAWN = 4.0  # standard deviations that are left to parities of drawn shingles


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; of the whole word sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(joined, SEED)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], dtype="<u8")


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have set."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def text_fingerprint(text: str | None, words: int) -> int:
    """SimHash of one text over XXH64 of its shingles, as an unsigned 64-bit integer."""
    return majority_bits(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """``(doc_id, fp)``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([text_fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype="<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _bits(fp: np.ndarray, which: list[int]) -> np.ndarray:
    """The bits ``which`` of each fingerprint, gathered into a small integer."""
    out = np.zeros(len(fp), dtype=np.int64)
    for k, b in enumerate(which):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def bit_groups(distinct: DataFrame) -> list[list[int]]:
    """Four groups of 16 bits, correlated bits together, from co-occurrence counts over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            m = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += m.T @ m
            n += len(fp)
        if n:
            i, j = np.triu_indices(64)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both[i, j].astype(np.int64)), pa.array(np.full(len(i), n))], names=["i", "j", "n", "total"])

    rows = distinct.select("fp").mapInArrow(run, "i long, j long, n long, total long").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # 2,080 rows
    joint, total = np.zeros((64, 64)), 1
    for r in rows:
        joint[r["i"], r["j"]] = joint[r["j"], r["i"]] = r["n"]
        total = r["total"]
    mean = joint.diagonal() / total
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs(joint / total - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    while left:
        free = sorted(left)
        group = [free[int(corr[np.ix_(free, free)].sum(axis=1).argmax())]]
        left -= set(group)
        while len(group) < WIDTH:
            free = sorted(left)
            group.append(free[int(corr[np.ix_(free, group)].sum(axis=1).argmax())])
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def _pairs_by_distance(counts: np.ndarray) -> np.ndarray:
    """Ordered pairs at each Hamming distance of a value histogram (Walsh-Hadamard self-convolution)."""

    def transform(v: np.ndarray) -> np.ndarray:
        v, h = v.astype(np.float64), 1
        while h < len(v):
            w = v.reshape(-1, 2, h)
            v = np.stack([w[:, 0] + w[:, 1], w[:, 0] - w[:, 1]], axis=1).reshape(-1)
            h *= 2
        return v

    by_xor = transform(transform(counts) ** 2) / len(counts)
    return np.bincount(np.bitwise_count(np.arange(len(counts))), weights=by_xor)


def _flips(t: int) -> tuple[int, int]:
    """How many bits one side and the other change, so that values within t bits of each other meet."""
    return t // 2, (t + 1) // 2


def allocate_thresholds(pairs: list[np.ndarray], rows: int, tau: int) -> list[int]:
    """Thresholds with sum ``tau - m + 1`` and least estimated work: candidates plus probe rows."""
    m, work = len(pairs), []
    for p in pairs:
        cost, total = {-1: 0.0}, 0.0
        for t in range(min(tau, WIDTH - 1) + 1):
            total += p[t]
            cost[t] = total + 20.0 * rows * sum(comb(WIDTH, k) for k in range(_flips(t)[1] + 1))
        work.append(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in work:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, extra in cost.items():
                if s + t not in nxt or c + extra < nxt[s + t][0]:
                    nxt[s + t] = (c + extra, [*chosen, t])
        best = nxt
    return best[tau - m + 1][1]


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit key of several numbers; a clash only adds a candidate that verification removes."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (out ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(29))
    return out


_PROBE = "key long, used long, home boolean, fp long, node long"


def _probe_batch(key: np.ndarray, used: np.ndarray, home: np.ndarray, rest: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(used.view(np.int64)), pa.array(home), *rest], names=["key", "used", "home", "fp", "node"])


def _probed(fp: np.ndarray, groups: list[list[int]], thresholds: list[int]) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Group, value and whether that is the home side, for all values that the thresholds ask for."""
    for g, (which, t) in enumerate(zip(groups, thresholds)):
        if t < 0:
            continue
        value = _bits(fp, which)
        near_side, far_side = _flips(t)
        for k in range(far_side + 1):
            for flip in combinations(range(len(which)), k):
                yield g, value ^ sum(1 << b for b in flip), k <= near_side


def probes(distinct: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """Every fingerprint under its own value of each group and under the values around it that its threshold needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for g, value, home in _probed(fp, groups, thresholds):
                used = np.full(len(fp), sum(1 << b for b in groups[g]), dtype=np.uint64)
                yield _probe_batch(_mix(np.full(len(fp), g), value), used, np.full(len(fp), home), batch.columns)

    return distinct.select("fp", "node").mapInArrow(run, _PROBE)


def _dealt_again(rows: DataFrame, tau: int) -> DataFrame:
    """Rows of oversized buckets under ``tau + 1`` finer keys each, over bits not used so far.

    Two fingerprints within ``tau`` bits agree on one of ``tau + 1`` groups of the unused bits.  Where
    fewer bits than groups are left the bucket stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, used, home, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "used", "home", "fp"))
            key, used, fp = key.view(np.uint64), used.view(np.uint64), fp.view(np.uint64)
            for mask in np.unique(used):
                own = np.flatnonzero(used == mask)
                rest = [batch.column(c).take(pa.array(own)) for c in ("fp", "node")]
                free = [b for b in range(64) if not int(mask) >> b & 1]
                for j, which in enumerate(np.array_split(free, tau + 1)):
                    more = np.full(len(own), int(mask) | sum(1 << int(b) for b in which), dtype=np.uint64)
                    yield _probe_batch(_mix(key[own], np.full(len(more), j), _bits(fp[own], [int(b) for b in which])), more, home[own], rest)

    return rows.select("key", "used", "home", "fp", "node").mapInArrow(run, _PROBE)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits over all lanes (last axis)."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32)


def _link_bucket(wide: np.ndarray, home: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within one bucket, by breadth-first search over unseen members."""
    edges, unseen = [], np.arange(len(wide))
    while len(unseen) > 1:
        queue, unseen = [int(unseen[0])], unseen[1:]
        while queue and len(unseen):
            k = queue.pop()
            near = _apart(wide[unseen], wide[k]) <= limit
            if not home[k]:
                near &= home[unseen]
            if near.any():
                hit = unseen[near]
                unseen = unseen[~near]
                queue.extend(hit.tolist())
                edges.extend((k, h) for h in hit.tolist())
    return edges


def links(rows: DataFrame, limit: int) -> DataFrame:
    """Verified links ``(a, b)`` between the nodes that share a key and differ in at most ``limit`` bits."""

    def linked(key: np.ndarray, home: np.ndarray, fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = fp.view(np.uint64)[:, None]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        a, b = [], []
        pairs = start[size == 2]
        near = _apart(wide[pairs], wide[pairs + 1]) <= limit
        near &= home[pairs] | home[pairs + 1]
        a.append(pairs[near])
        b.append(pairs[near] + 1)
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            f = wide[s : s + n]
            if n <= 128 and np.count_nonzero(_apart(f[:, None], f[None, :]) <= limit) == n:
                continue
            if e := _link_bucket(f, home[s : s + n], limit):
                i, j = np.array(e).T
                a.append(s + i)
                b.append(s + j)
        i, j = np.concatenate(a), np.concatenate(b)
        x, y = node[i], node[j]
        keep = x != y
        edge = np.unique(np.stack([np.minimum(x, y)[keep], np.maximum(x, y)[keep]]), axis=1)
        return edge[0], edge[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_buckets(batches, ("key", "home", "fp", "node")):
            a, b = linked(*columns)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").select("key", "home", "fp", "node").mapInArrow(run, "a long, b long")


def _whole_buckets(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of the rows, which come sorted by the first, cut so that no bucket is in two pieces."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        cut = int(np.searchsorted(own[0], own[0][-1]))  # the last bucket may go on
        if cut or (held and held[-1][0][-1] != own[0][-1]):
            yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in own])]
            held = []
        held.append([c[cut:] for c in own])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def near_duplicates(docs: DataFrame, words: int = 5, tau: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` per document; component_id is the smallest doc_id that links reach.

    Links are fingerprints that differ in at most ``tau`` bits.  A fingerprint stands for its smallest doc_id
    in all that follows, so the smallest id of a component is its answer and nothing is grouped by component.
    """
    docs_fp = materialise(fingerprints(docs, words), "fingerprints")
    distinct = materialise(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    probing = distinct.filter("node is not null")
    groups = bit_groups(probing)
    thresholds = allocate_thresholds(_histograms(probing, groups), probing.count(), tau)
    rows, edges, finer = probes(probing, groups, thresholds), None, True
    while finer:
        rows = materialise(rows, "probes")
        large = rows.filter(F.bit_count("used") + tau + 1 <= 64).groupBy("key").count().filter(F.col("count") > BUCKET).select("key")
        finer = not large.isEmpty()
        found = links(rows.join(large, "key", "left_anti") if finer else rows, tau)
        edges = found if edges is None else edges.union(found)
        if finer:
            rows = _dealt_again(rows.join(large, "key", "left_semi"), tau)
    return _labelled(docs_fp, distinct, "fp", edges).select("doc_id", "fp", "component_id")


def _labelled(docs: DataFrame, distinct: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """``docs`` with component_id, by the node that their ``key`` has in ``distinct``.

    The join is between two written tables, so that adaptive execution splits a key that very many rows have.
    """
    roots = connected_components(edges).withColumnRenamed("node", "of")
    classes = materialise(distinct.join(roots, F.col("node") == F.col("of"), "left").select(key, F.coalesce("root", "node").alias("component_id")), "classes")
    return docs.join(classes, key)


def _histograms(distinct: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """Ordered pairs by distance for each group; at most 65,536 counts a group reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(groups), 1 << WIDTH), dtype=np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for g, which in enumerate(groups):
                counts[g] += np.bincount(_bits(fp, which), minlength=1 << WIDTH)
        g, v = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(v), pa.array(counts[g, v])], names=["g", "v", "n"])

    rows = distinct.select("fp").mapInArrow(run, "g long, v long, n long").groupBy("g", "v").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for g in range(len(groups)):
        own = rows[rows.g == g]
        counts = np.zeros(1 << WIDTH)
        counts[own.v.to_numpy()] = own.n.to_numpy()
        out.append(_pairs_by_distance(counts))
    return out


def differing_share(similarity: float) -> float:
    """Expected share of differing bits between texts whose shingle sets have this Jaccard similarity."""
    return acos(2 * similarity / (1 + similarity)) / pi


def parities(own: np.ndarray, level: int) -> np.ndarray:
    """Whether an odd number of shingles fall on each of ``64 * ODD`` places; of one shingle in ``2 ** level``, the same ones for all sets.

    Two sets differ in at least as many shingles as their parities do, so at level 0 this is a bound without chance.
    """
    own = own[own & np.uint64((1 << level) - 1) == 0]
    odd = np.bincount((own >> np.uint64(48)).astype(np.int64) % (64 * ODD), minlength=64 * ODD) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _possible(similarity: float) -> Column:
    """Rows one and two whose sizes and parities leave it possible that the sets have this similarity.

    Sets of n and m shingles that differ in d have similarity (n + m - d) / (n + m + d).  The smaller set's second words are those of the next level.
    """
    n, m, level = F.col("one.size"), F.col("two.size"), F.greatest("one.level", "two.level")
    most = (n + m) * ((1 - similarity) / (1 + similarity)) / F.pow(F.lit(2.0), level)
    most += F.when(level > 0, DRAWN * F.sqrt(most)).otherwise(0.0) + 1e-6
    words = [F.slice(f"{x}.odd", F.when(F.col(f"{x}.level") < level, ODD + 1).otherwise(1), ODD) for x in ("one", "two")]
    odd = F.aggregate(F.zip_with(*words, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, k: total + k)  # short code, where a sum of terms is beyond what the JVM compiles
    far = F.abs(F.col("one.level") - F.col("two.level")) > 1
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & (far | (odd <= most))


_SKETCHED = "doc_id long, node long, fp long, lanes array<long>, size long, level long, odd array<long>"


def sketches(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """``(doc_id, node, fp, lanes, size, level, odd)``: a number for the set of shingles, SimHashes of that set in several lanes, its size and parities at two levels."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, wide = np.empty(batch.num_rows, dtype="<u8"), np.empty((batch.num_rows, lanes), dtype="<u8")
            size, odd = np.empty((2, batch.num_rows), dtype=np.int64), np.empty((batch.num_rows, 2 * ODD), dtype="<u8")
            for k, t in enumerate(batch.column(1).to_pylist()):
                own = np.unique(shingle_hashes(t, words))
                wide[k] = [majority_bits(own if lane == 0 else _mix(own, lane)) for lane in range(lanes)]
                with np.errstate(over="ignore"):
                    node[k] = _mix(_mix(own, lanes).sum(dtype=np.uint64), len(own))
                size[:, k] = len(own), ceil(log2(max(len(own) / WHOLE, 1)))
                drawn = _mix(own, lanes + 1)
                odd[k] = np.concatenate([parities(drawn, int(size[1, k]) + up) for up in (0, 1)])
            lists = [pa.array(list(x.view(np.int64)), pa.list_(pa.int64())) for x in (wide, odd)]
            made = [pa.array(node.view(np.int64)), pa.array(np.ascontiguousarray(wide[:, 0]).view(np.int64)), lists[0], pa.array(size[0]), pa.array(size[1]), lists[1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[c.split()[0] for c in _SKETCHED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SKETCHED)


_SKETCH_ROWS = f"key long, id long, home boolean, {', '.join(f's{k} long' for k in range(SKETCH))}"


def _sketch_rows(distinct: DataFrame, groups: list[list[int]], thresholds: list[int], lanes: int) -> DataFrame:
    """Every node under the values of its groups in each lane, with the lanes that tell chance meetings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, lanes)
            along = [pa.array(np.ascontiguousarray(wide[:, k]).view(np.int64)) for k in range(SKETCH)]
            for lane in range(lanes):
                for g, value, home in _probed(np.ascontiguousarray(wide[:, lane]), groups, thresholds):
                    key = _mix(np.full(len(wide), lane), np.full(len(wide), g), value)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), pa.array(np.full(len(wide), home)), *along], names=[c.split()[0] for c in _SKETCH_ROWS.split(", ")])

    return distinct.select("node_id", "lanes").mapInArrow(run, _SKETCH_ROWS)


def _loose_groups(wide: np.ndarray, home: np.ndarray, limit: int) -> np.ndarray:
    """Label of each member's group of those near each other, directly or by others; -1 for members without company."""
    label = np.full(len(wide), -1)
    for k, (a, b) in enumerate(_link_bucket(wide, home, limit)):
        if label[a] < 0:
            label[a] = k
        label[b] = label[a]
    return label


def _met(rows: DataFrame, limit: int, most: int | None) -> DataFrame:
    """Rows that have company in their bucket, under the smallest id of their group; ``late`` ones are those of buckets over ``most``.

    Groups of several buckets with one smallest id are one, so copies that meet in all lanes take few rows.
    """
    names = tuple(c.split()[0] for c in _SKETCH_ROWS.split(", "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_buckets(batches, names):
            key, home = columns[0], columns[2]
            wide = np.stack([c.view(np.uint64) for c in columns[3:]], axis=1)
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            ids, lead, grouped, late = columns[1], key.copy(), np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
            pair = start[size == 2]
            near = pair[(_apart(wide[pair], wide[pair + 1]) <= limit) & (home[pair] | home[pair + 1])]
            lead[near] = lead[near + 1] = np.minimum(ids[near], ids[near + 1])
            grouped[near] = grouped[near + 1] = True
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                if most is not None and n > most:
                    late[s : s + n] = True
                elif n > 128 or np.count_nonzero(_apart(wide[s : s + n, None], wide[None, s : s + n]) <= limit) > n:
                    label = _loose_groups(wide[s : s + n], home[s : s + n], limit)
                    for one in np.unique(label[label >= 0]):
                        own = s + np.flatnonzero(label == one)
                        lead[own], grouped[own] = ids[own].min(), True
            out = np.flatnonzero(late | grouped)
            yield pa.RecordBatch.from_arrays([pa.array(lead[out]), *(pa.array(c[out]) for c in columns[1:]), pa.array(late[out])], names=[*names, "late"])

    return rows.repartition("key").sortWithinPartitions("key").select(*names).mapInArrow(run, f"{_SKETCH_ROWS}, late boolean")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of oversized buckets, dealt into blocks of about BUCKET / 2 by id; every two blocks of a bucket meet under a key."""
    sizes = rows.groupBy("key").agg(F.ceil(2 * F.count("*") / BUCKET).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    other = rows.join(sizes, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), *(c for c in rows.columns if c != "key"))


def jaccard(first: np.ndarray, second: np.ndarray) -> float:
    """Similarity of two sets of hashes, each sorted; that of two empty sets is 1."""
    both = len(np.intersect1d(first, second, assume_unique=True))
    return both / (len(first) + len(second) - both) if len(first) or len(second) else 1.0


def _similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs ``(a, b)`` whose shingle sets have at least this Jaccard similarity, with all columns (longs)."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = ([np.frombuffer(x, dtype="<u8") for x in batch.column(c).to_pylist()] for c in ("a_set", "b_set"))
            good = [jaccard(x, y) >= similarity for x, y in zip(p, q)]
            yield batch.filter(pa.array(good, pa.bool_())).select(names)

    of = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"{c}_set"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select(*names, "a_set", "b_set").mapInArrow(run, ", ".join(f"{c} long" for c in names)).distinct()


def _bound(share: float, bits: int, spreads: float) -> int:
    """Differing bits that a pair with this expected share keeps within, but for so many standard deviations."""
    return ceil(bits * share + spreads * sqrt(bits * share * (1 - share)))


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = LANES) -> DataFrame:
    """``(doc_id, component_id)``: classes of documents whose sets of shingles have this Jaccard similarity or more.

    A pair is a candidate if it differs in at most three bits on groups of any lane, as ``probes`` has it, and
    in no more bits, over the sketch and over all lanes, than the similarity lets expect within a few standard
    deviations, and its parities allow the similarity.  Every candidate's shingle sets are compared, so no pair below ``similarity`` is linked; a pair at 0.8
    is missed with chance 0.04 by the binomial model of twelve lanes (measured by a test), one at 0.9 practically never.
    """
    share = differing_share(similarity)
    limit = _bound(share, 64 * SKETCH, 3.0)
    own = materialise(sketches(docs, words, lanes), "sketches")
    along = ("lanes", "size", "level", "odd")
    distinct = materialise(own.groupBy("node").agg(F.min("doc_id").alias("node_id"), *(F.first(c).alias(c) for c in ("fp", *along))), "distinct").filter("node_id is not null")
    groups = bit_groups(distinct)
    thresholds = allocate_thresholds(_histograms(distinct, groups), distinct.count(), GROUPS - 1)
    met = materialise(_met(_sketch_rows(distinct, groups, thresholds, lanes), limit, BUCKET), "met")
    if not met.filter("late").isEmpty():
        blocks = _met(_in_blocks(met.filter("late").drop("late")), limit, None)
        met = materialise(met.filter("not late").union(blocks), "met")
    needed = met.select("id").distinct().withColumnRenamed("id", "needed_id")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    sets = materialise(texts.join(needed, texts.id == needed.needed_id, "left_semi").mapInArrow(shingled, "id long, shingles binary"), "sets")
    # all lanes and the parities are wanted for the rows that met only
    met = materialise(met.select("key", "id").distinct().join(distinct.select(F.col("node_id").alias("id"), *along), "id").select("key", "id", *along), "groups")
    near = sum((F.bit_count(F.col("one.lanes")[k].bitwiseXOR(F.col("two.lanes")[k])) for k in range(lanes)), F.lit(0)) <= _bound(share, 64 * lanes, SURE)
    edges = class_links(met, lambda pairs: _similar_pairs(pairs, sets, similarity), near & _possible(similarity))
    labelled = _labelled(own.select("doc_id", F.col("node").alias("set")), distinct.select(F.col("node").alias("set"), F.col("node_id").alias("node")), "set", edges)
    discard(met, sets)
    return labelled.select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the documents whose near-duplicate class has a smaller doc_id; rows without an id stay."""
    classes = similar_classes(docs.filter("doc_id is not null"), words, similarity)
    name = f"copy_{uuid4().hex}"  # no column of docs
    dropped = classes.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col(name), "left_anti").select(docs.columns)
