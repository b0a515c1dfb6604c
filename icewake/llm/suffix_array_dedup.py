"""Removal of repeated byte strings by threshold-bounded interval expansion on a BWT.

A byte goes if a string of ``min_bytes`` bytes that covers it also starts earlier in the corpus
(smaller doc_id, or the same document further left).  The work is dealt out so that equal strings
meet in one task:

1. Every window of ``min_bytes`` bytes picks the smallest-hashed ``GRAM``-byte gram in it, its anchor,
   so equal windows pick equal grams.  Runs of windows with one anchor form a segment.
2. Anchors are shuffled by hash as packed arrays, after each batch has kept one of its identical
   segments only.  Where a gram occurs once nothing repeats.  Of identical segments the first is
   kept as their representative, and the later ones are repeats as a whole.
3. The bytes of differing representatives with a common gram are cut out of the documents and
   shuffled to the gram's bucket.  There a suffix array, its BWT, and a breadth-first backward
   extension over the BWT give common-prefix values in increasing order; the expansion stops at
   ``min_bytes``, and the boundaries not reached join the suffixes that share that many bytes.
   Each such class is a repeated string with one first occurrence.
4. Removed runs return to their documents by a join on the document's order key.

Defined results: a null text counts as empty; a null doc_id comes before all others; rows that repeat
a doc_id stand at one place (neither is earlier than the other) and share their removed runs; texts
shorter than ``min_bytes`` are kept whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

GRAM = 32
CHUNK = 1 << 16
BLOCK = 1 << 21
SEPARATOR = 0xFF  # no byte of UTF-8 text
NO_ID = -(1 << 63)

_TABLE = np.random.default_rng(0x1CE).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_RUNS = np.dtype([("oid", "<i8"), ("start", "<i4"), ("end", "<i4")])
_ANCHORS = np.dtype([("key", "<u8"), ("digest", "<u8"), ("oid", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte grams, by doubling."""
    h, width = _TABLE[b], 1
    for f in _FACTORS:
        h = h[:-width] * f + (h[width:] ^ (h[width:] >> np.uint64(29)))
        width *= 2
    h ^= h >> np.uint64(32)
    h *= _FACTORS[0]
    return h ^ (h >> np.uint64(29))


def _window_anchors(hashes: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest hash, the leftmost among equals, in each window of ``span`` grams."""
    n = len(hashes)
    low = np.uint64(n.bit_length())
    v = ((hashes >> low) << low) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < span:
        v = np.minimum(v[: n - span + 1], v[span - size : n - size + 1])
    return (v & np.uint64((1 << int(low)) - 1)).astype(np.int64)


def _combine(*parts: np.ndarray) -> np.ndarray:
    out = np.full(len(parts[0]), 0x243F6A8885A308D3, dtype=np.uint64)
    for k, p in enumerate(parts):
        out = (out ^ p.astype(np.uint64)) * _FACTORS[k % 5]
        out ^= out >> np.uint64(31)
    return out


def segments(buffer: np.ndarray, bounds: np.ndarray, oids: np.ndarray, min_bytes: int) -> np.ndarray:
    """Anchored segments of the documents that lie one after another in ``buffer``; starts are per document."""
    span = min_bytes - GRAM + 1
    found = []
    for at in range(0, len(buffer) - min_bytes + 1, CHUNK):
        part = buffer[at : at + CHUNK + min_bytes - 1]
        if len(part) < min_bytes:
            break
        h = _gram_hashes(part)
        anchor = _window_anchors(h, span)
        pos = np.arange(len(anchor)) + at
        # windows that leave their document do not count
        first, last = np.searchsorted(bounds, at, side="right") - 1, np.searchsorted(bounds, at + len(anchor), side="left")
        inside = np.ones(len(anchor), dtype=bool)
        for edge in bounds[first + 1 : last + 2].tolist():
            a, b = max(0, edge - min_bytes + 1 - at), min(len(anchor), edge - at)
            if a < b:
                inside[a:b] = False
        ok = np.flatnonzero(inside)
        if not len(ok):
            continue
        cut = np.r_[True, (anchor[ok][1:] != anchor[ok][:-1]) | (np.diff(ok) != 1)]
        lo = ok[cut]
        hi = np.r_[ok[np.flatnonzero(cut)[1:] - 1], ok[-1]]
        doc = np.searchsorted(bounds, pos[lo], side="right") - 1
        tail = hi + min_bytes - GRAM
        a = np.empty(len(lo), dtype=_ANCHORS)
        a["key"] = h[anchor[lo]]
        a["digest"] = _combine(*(h[np.minimum(lo + k, tail)] for k in range(0, 2 * min_bytes - GRAM, GRAM)), hi - lo, anchor[lo] - lo)
        a["oid"], a["start"], a["end"] = oids[doc], pos[lo] - bounds[doc], pos[hi] - bounds[doc] + min_bytes
        found.append(a)
    return np.concatenate(found) if found else np.empty(0, dtype=_ANCHORS)


def _class_starts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, digest, oid, start); True where a new (key, digest) begins."""
    order = np.lexsort((a["start"], a["oid"], a["digest"], a["key"]))
    k, d = a["key"][order], a["digest"][order]
    return order, np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])][: len(order)]


def _joined_runs(runs: np.ndarray) -> np.ndarray:
    """Overlapping and touching runs of each document joined, in order."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs["start"], runs["oid"]))]
    out, new = runs["oid"], np.ones(len(runs), dtype=bool)
    # a running maximum per document: shift each document's ends above all before it
    rank = np.cumsum(np.r_[0, out[1:] != out[:-1]]).astype(np.int64) << 32
    reach = np.maximum.accumulate(runs["end"] + rank)
    new[1:] = runs["start"][1:] + rank[1:] > reach[:-1]
    at = np.flatnonzero(new)
    joined = runs[at].copy()
    joined["end"] = (reach - rank)[np.r_[at[1:] - 1, len(runs) - 1]]
    return joined


def _per_bucket(a: np.ndarray, bucket: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    if not len(a):
        return
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
    parts = [x.tobytes() for x in np.split(a[order], at[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[order][at].astype(np.int32)), pa.array(np.full(len(at), kind, dtype=np.int32)), pa.array(parts, pa.binary())], names=["bucket", "kind", "packed"])


def _runs_by_document(runs: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """One row per document: oid, kind, packed (start, end) pairs."""
    runs = runs[np.argsort(runs["oid"], kind="stable")]
    for k in range(0, len(runs), 1 << 18):
        part = runs[k : k + (1 << 18)]
        at = np.flatnonzero(np.r_[True, part["oid"][1:] != part["oid"][:-1]])
        pairs = np.stack([part["start"], part["end"]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(part["oid"][at]), pa.array(np.full(len(at), kind, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(pairs, at[1:])], pa.binary())], names=["oid", "kind", "packed"])


def _as_runs(a: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), dtype=_RUNS)
    for c in ("oid", "start", "end"):
        out[c] = a[c]
    return out


REPEAT, CANDIDATE = 0, 1


def _anchor_rows(docs: DataFrame, min_bytes: int, buckets: int) -> DataFrame:
    """Packed anchors by bucket of their gram; bucket -1 carries runs already known to repeat."""

    def one(texts: list[bytes], oids: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(oids, kind="stable")
        texts = [texts[k] for k in order]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        a = segments(np.frombuffer(b"".join(texts), dtype=np.uint8), bounds, oids[order], min_bytes)
        order, first = _class_starts(a)
        # of identical segments in this batch one goes on; places equal to it are no repeats
        lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(order) else order
        later = (a["oid"][order] != a["oid"][lead]) | (a["start"][order] != a["start"][lead])
        known = _joined_runs(_as_runs(a[order[later]]))
        keep = a[order[first]]
        yield from _per_bucket(keep, (keep["key"] % np.uint64(buckets)).astype(np.int64), CANDIDATE)
        yield from _per_bucket(known, (known["oid"].view(np.uint64) % np.uint64(buckets)).astype(np.int64), REPEAT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        oids: list[np.ndarray] = []
        size = 0
        for batch in batches:
            texts += batch.column(1).to_pylist()
            oids.append(batch.column(0).to_numpy(zero_copy_only=False))
            size += batch.column(1).nbytes
            if size > 24 << 20:
                yield from one(texts, np.concatenate(oids))
                texts, oids, size = [], [], 0
        if texts:
            yield from one(texts, np.concatenate(oids))

    return docs.select("oid", "bytes").mapInArrow(run, "bucket int, kind int, packed binary")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """The packed parts of each bucket, by kind; rows come sorted by bucket."""
    current, parts = None, {}
    for batch in batches:
        for bucket, kind, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "packed"))):
            if bucket != current:
                if parts:
                    yield current, parts
                current, parts = bucket, {}
            parts.setdefault(kind, []).append(packed)
    if parts:
        yield current, parts


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: later identical segments are repeats; differing ones with a common gram are candidates."""
    for _, parts in _grouped(batches):
        known = [np.frombuffer(p, dtype=_RUNS) for p in parts.get(REPEAT, [])]
        a = np.concatenate([np.frombuffer(p, dtype=_ANCHORS) for p in parts.get(CANDIDATE, [b""])])
        by_key = np.argsort(a["key"], kind="stable")
        k = a["key"][by_key]
        same = k[1:] == k[:-1]
        a = a[by_key[np.r_[False, same] | np.r_[same, False]]] if len(a) else a
        if len(a):
            order, first = _class_starts(a)
            lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
            later = (a["oid"][order] != a["oid"][lead]) | (a["start"][order] != a["start"][lead])
            known.append(_as_runs(a[order[later]]))
            reps = a[order[first]]
            same = reps["key"][1:] == reps["key"][:-1]
            yield from _runs_by_document(_as_runs(reps[np.r_[False, same] | np.r_[same, False]]), CANDIDATE)
        if known:
            yield from _runs_by_document(_joined_runs(np.concatenate(known)), REPEAT)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in order of their first ``depth`` or more bytes (prefix doubling)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    sa = np.argsort(key, kind="stable")
    new = np.r_[True, key[sa][1:] != key[sa][:-1]]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    width = 8
    while width < depth:
        tied = ~new | ~np.r_[new[1:], True]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        pos = sa[at]
        second = rank[np.minimum(pos + width, n)] + 1
        order = np.argsort((rank[pos].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), kind="stable")
        group, second = rank[pos[order]], second[order]
        sa[at] = pos[order]
        fresh = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        new[at] = fresh
        rank[sa[at]] = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        width *= 2
    return sa


def shared_prefix_classes(text: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``text``, and True where a suffix shares fewer than ``min_bytes`` bytes with the one before.

    ``text`` consists of strings that each end in SEPARATOR; common prefixes across it do not count
    and are not expanded.  Intervals of the suffix array that belong to strings of length l are
    extended backwards by one byte, all at once; an interval whose right boundary is new sets that
    boundary and goes on to length l + 1, so boundaries appear in order of common-prefix value.
    """
    n = len(text)
    sa = suffix_order(text, min_bytes)
    bwt = text[sa - 1]
    order = np.argsort(bwt, kind="stable")  # positions of each byte in turn
    lf = np.empty(n, dtype=np.int64)
    lf[order] = np.arange(n)
    same = bwt[order][1:] == bwt[order][:-1]
    before, after = np.full(n, -1, dtype=np.int64), np.full(n, n, dtype=np.int64)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    bound = np.zeros(n + 1, dtype=bool)
    bound[0] = bound[n] = True
    left, right = np.array([0]), np.array([n])
    for length in range(min_bytes):
        if not len(left):
            break
        size = right - left
        at = np.arange(size.sum()) + np.repeat(left - np.r_[0, np.cumsum(size)[:-1]], size)
        lo, hi = np.repeat(left, size), np.repeat(right, size)
        if length:
            usable = bwt[at] != SEPARATOR
            at, lo, hi = at[usable], lo[usable], hi[usable]
        start = np.sort(lf[at[before[at] < lo]])
        stop = np.sort(lf[at[after[at] >= hi]]) + 1
        new = ~bound[stop] if length else np.ones(len(stop), dtype=bool)
        left, right = start[new], stop[new]
        bound[right] = True
    return sa, bound[:n]


def _block_repeats(oid: np.ndarray, start: np.ndarray, pieces: list[bytes], min_bytes: int) -> np.ndarray:
    """Repeated windows, as runs, among the strings of one block."""
    length = np.array([len(p) for p in pieces], dtype=np.int64)
    text = np.frombuffer(b"".join(p + bytes([SEPARATOR]) for p in pieces), dtype=np.uint8)
    offset = np.r_[0, np.cumsum(length + 1)[:-1]]
    sa, bound = shared_prefix_classes(text, min_bytes)
    string = np.repeat(np.arange(len(pieces)), length + 1)
    within = np.arange(len(text)) - offset[string]
    window = within + min_bytes <= length[string]
    cls = np.cumsum(bound)
    use = window[sa]
    pos, cls = sa[use], cls[use]
    order = np.lexsort((start[string[pos]] + within[pos], oid[string[pos]], cls))
    pos, cls = pos[order], cls[order]
    o, s = oid[string[pos]], start[string[pos]] + within[pos]
    first = np.r_[True, cls[1:] != cls[:-1]][: len(cls)]
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(cls) else np.empty(0, dtype=np.int64)
    later = (o != o[lead]) | (s != s[lead])
    runs = np.empty(int(later.sum()), dtype=_RUNS)
    runs["oid"], runs["start"], runs["end"] = o[later], s[later], s[later] + min_bytes
    return _joined_runs(runs)


def _cut_out(batches: Iterator[pa.RecordBatch], columns: list[int], min_bytes: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The bytes of candidate segments, by bucket of their gram; ``columns``: the places of oid, text and runs."""
    span = min_bytes - GRAM + 1
    for batch in batches:
        oids, keys, starts, parts = [], [], [], []
        oid_of, content, runs = (batch.column(c) for c in columns)
        for oid, data, packed in zip(oid_of.to_pylist(), content.cast(pa.binary()).to_pylist(), runs.to_pylist()):
            pairs = np.concatenate([np.frombuffer(p, dtype="<i4") for p in packed]).reshape(-1, 2)
            pieces = [data[a:b] for a, b in pairs.tolist()]
            joined = np.frombuffer(b"".join(pieces), dtype=np.uint8)
            if not len(joined):
                continue
            h = _gram_hashes(joined)
            at = np.r_[0, np.cumsum(pairs[:, 1] - pairs[:, 0])[:-1]]
            # each window of a segment has the segment's anchor; the first window tells it
            for k in range(0, len(at), 4096):
                near = h[at[k : k + 4096, None] + np.arange(span)]
                keys.append(near.min(axis=1))
            oids += [oid] * len(pieces)
            starts += pairs[:, 0].tolist()
            parts += pieces
        if parts:
            key = np.concatenate(keys)
            yield pa.RecordBatch.from_arrays([pa.array((key % np.uint64(buckets)).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(oids, pa.int64()), pa.array(starts, pa.int32()), pa.array(parts, pa.binary())], names=["bucket", "key", "oid", "start", "piece"])


def _expand(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """Interval expansion over blocks of whole gram groups; rows come sorted by gram."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []
    size = 0

    def flush(cut: int | None) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        key, oid, start = (np.concatenate([h[k] for h in held]) for k in range(3))
        pieces = [p for h in held for p in h[3]]
        cut = len(key) if cut is None else cut
        if cut:
            yield from _runs_by_document(_block_repeats(oid[:cut], start[:cut], pieces[:cut], min_bytes), REPEAT)
        held = [(key[cut:], oid[cut:], start[cut:], pieces[cut:])]
        size = sum(map(len, pieces[cut:]))

    for batch in batches:
        key, oid, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "oid", "start"))
        held.append((key, oid, start.astype(np.int64), batch.column("piece").to_pylist()))
        size += batch.column("piece").nbytes
        if size > BLOCK:
            keys = np.concatenate([h[0] for h in held])
            yield from flush(int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0)
    if held and sum(len(h[0]) for h in held):
        yield from flush(None)


def _found_runs(own: DataFrame, placed: DataFrame, content: str, min_bytes: int) -> DataFrame:
    """Runs by ``oid`` as a list ``packed``, which may overlap.

    ``own`` has oid and bytes, ``placed`` the same documents dealt by oid, with their text as ``content``.  The
    cut takes ``placed`` with all its columns, as its later reader does, so Spark shuffles the documents once
    for both.
    """
    spark = own.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = _anchor_rows(own, min_bytes, buckets).repartition("bucket").sortWithinPartitions("bucket")
    found = materialise(anchors.mapInArrow(_resolve, "oid long, kind int, packed binary"), "segments")
    candidates = found.filter(F.col("kind") == CANDIDATE).groupBy("oid").agg(F.collect_list("packed").alias("packed"))
    at = [placed.columns.index(c) for c in ("oid", content)] + [len(placed.columns)]
    joined = placed.join(candidates.withColumnRenamed("oid", "candidate").hint("shuffle_hash"), placed["oid"] == F.col("candidate"))
    joined = joined.select(*(placed[c] for c in placed.columns), candidates["packed"])
    cut = joined.mapInArrow(lambda b: _cut_out(b, at, min_bytes, buckets), "bucket int, key long, oid long, start int, piece binary")
    expanded = cut.repartition("bucket").sortWithinPartitions("key").mapInArrow(lambda b: _expand(b, min_bytes), "oid long, kind int, packed binary")
    return found.filter(F.col("kind") == REPEAT).union(expanded).groupBy("oid").agg(F.collect_list("packed").alias("packed"))


def _runs_within(packed: Iterable[bytes], size: int) -> np.ndarray:
    """The (start, end) pairs of a document of ``size`` bytes, in order and joined."""
    pairs = np.concatenate([np.frombuffer(p, dtype="<i4") for p in packed]).reshape(-1, 2)
    r = np.zeros(len(pairs), dtype=_RUNS)
    r["start"], r["end"] = pairs[:, 0], np.minimum(pairs[:, 1], size)
    r = _joined_runs(r[r["start"] < r["end"]])
    return np.stack([r["start"], r["end"]], axis=1)


def removed_runs(docs: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Every row of ``docs`` as doc_id, bytes, and ``removed``: packed (start, end) 32-bit pairs in order."""
    small_batches(docs.sparkSession)
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("oid"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"),
    )
    placed = own.repartition("oid")
    joined = placed.join(_found_runs(own, placed, "bytes", min_bytes).hint("shuffle_hash"), "oid", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for data, packed in zip(batch.column("bytes").to_pylist(), batch.column("packed").to_pylist()):
                if not packed:
                    kept.append(data)
                    removed.append(b"")
                    continue
                runs = _runs_within(packed, len(data))
                edges = [0, *runs.reshape(-1).tolist(), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append(runs.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in batch.column("bytes").to_pylist()], pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.binary())], names=["doc_id", "n_bytes", "kept", "removed"])

    return joined.select("doc_id", "bytes", "packed").mapInArrow(finish, "doc_id long, n_bytes long, kept binary, removed binary")


def without_repeats(docs: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``, and ``n_chars``, where there is one, set anew.

    Runs are narrowed to whole characters, so the text stays valid; a null text stays null, and rows
    without an id are kept as they are.
    """
    small_batches(docs.sparkSession)
    named = docs.filter("doc_id is not null").toDF(*(f"_{k}" for k in range(len(docs.columns))))  # names of docs may be any
    doc_id, text = (f"_{docs.columns.index(c)}" for c in ("doc_id", "text"))
    oid = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("oid")
    own = named.select(oid, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    placed = named.select("*", oid).repartition("oid")
    joined = placed.join(_found_runs(own, placed, text, min_bytes).hint("shuffle_hash"), "oid", "left")

    @F.pandas_udf("string")
    def shortened(text: pd.Series, packed: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or p is None else _without(t, p) for t, p in zip(text, packed)], dtype=object)

    whole = F.col("packed").isNull()
    out = joined.withColumn(text, F.when(whole, F.col(text)).otherwise(shortened(text, "packed")))
    if "n_chars" in docs.columns:
        n_chars = f"_{docs.columns.index('n_chars')}"
        out = out.withColumn(n_chars, F.when(whole, F.col(n_chars)).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return out.select(named.columns).toDF(*docs.columns).union(docs.filter("doc_id is null"))


def _without(text: str, packed: Iterable[bytes]) -> str:
    data = text.encode("utf-8")
    at, out = 0, []
    for a, b in _runs_within(packed, len(data)).tolist():
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = max(at, b)
    out.append(data[at:])
    return b"".join(out).decode("utf-8")
