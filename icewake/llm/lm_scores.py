"""Stupid-backoff language-model scores from n-gram tables partitioned by hash: every word and pair of the corpus counts.

The score of a word after its predecessor is c(pair) / c(predecessor), that of the first word of a
document c(word) / N.  No word is merged with another and no pair is dropped, so a document's score
does not change in kind as the corpus grows.  As the documents are scored by their own counts, every
pair has been seen and stupid backoff never backs off.  The sum over a document falls apart into

    sum over its pairs ln c(uw)  -  sum over its words but the first and last ln c(w)  -  ln N

(+ ln c(w) - ln N for a single word), so words and pairs are counted alike, in one pass: each task sends,
per hash bucket, the keys it met, how often, and the documents to add to.  Where a key's rows meet it is
counted and the logarithms return to their batch in packed rows.  No table goes to the driver or to
every task.  A key is a 64-bit hash: among n distinct words and pairs, n * n / 2 ** 65 clashes are expected.

The number of buckets follows the bytes of text, so that what meets in a task stays bounded.

Defined results: words are separated by the bytes 0x20 and 0x09-0x0D; a null or blank text has no words
and score 0; rows that repeat a doc_id, or have none, are one document whose sums add up (no pair spans
two rows); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

BATCH_WORDS = 1_500_000
BUCKET_BYTES = 64 << 20  # text whose keys share a bucket
ROWS = 32  # rows of packed keys that stand in memory at a time, on either side of the shuffle
_EXPLODED = "bucket int, batch long, sign int, keys binary, counts binary, uses binary, places binary, docs binary, words binary"
_SUMS = "batch long, places binary, sums binary, docs binary, words binary"


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _mixed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit key of two, in this order."""
    with np.errstate(over="ignore"):
        out = u * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
        out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return out ^ (out >> np.uint64(31))


def _grouped(numbers: np.ndarray, at: np.ndarray, place_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers, how often each occurs, and the places of the occurrences in that order."""
    keyed = np.sort((numbers << np.uint64(place_bits)) | at.astype(np.uint64))
    number = keyed >> np.uint64(place_bits)
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.empty(0, dtype=np.int64)
    return number[first], np.diff(np.r_[first, len(number)]), (keyed & np.uint64((1 << place_bits) - 1)).astype("<u2")


def _exploded(docs: DataFrame, buckets: int) -> DataFrame:
    """Per batch and bucket the keys with their documents, sign 1 for pairs and -1 for words; buckets below 0 name the documents."""
    small_batches(docs.sparkSession, 2 * ROWS)

    def one(batch: int, ids: list, parts: list[np.ndarray], met: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        named = np.array([(-1, 0) if x is None else (x, 1) for x in ids], dtype="<i8")
        size = np.array([len(p) for p in parts], dtype=np.int64)
        rows: list[tuple] = [(-1 - batch % buckets, batch, 0, b"", b"", b"", b"", named.tobytes(), size.astype("<i8").tobytes())]
        hashes = np.frombuffer(b"".join(blake2b(w, digest_size=8).digest() for w in met), dtype="<u8")
        numbers, at = np.concatenate(parts).astype(np.uint64), np.repeat(np.arange(len(parts), dtype=np.uint16), size)
        # a batch holds BATCH_WORDS words of at most 65,535 documents, or one document: the bits suffice
        place_bits, word_bits = (len(parts) - 1).bit_length(), np.uint64(max(1, len(met)).bit_length())
        inner = at[1:] == at[:-1]
        pair, pair_n, pair_at = _grouped(((numbers[:-1] << word_bits) | numbers[1:])[inner], at[1:][inner], place_bits)
        pair_key = _mixed(hashes[pair >> word_bits], hashes[pair & ((np.uint64(1) << word_bits) - np.uint64(1))]) if len(pair) else pair
        start, end = np.r_[True, ~inner][: len(at)], np.r_[~inner, True][: len(at)]
        used = start == end  # neither first nor last, or the only word of its document
        word, word_uses, word_at = _grouped(numbers[used], at[used], place_bits)
        total, uses = np.bincount(numbers.astype(np.int64), minlength=len(met)), np.zeros(len(met), dtype=np.int64)
        uses[word.astype(np.int64)] = word_uses
        for sign, key, count, use, place in ((1, pair_key, pair_n, pair_n, pair_at), (-1, hashes, total, uses, word_at)):
            bucket = _bucket_of(key, buckets)
            of_place = np.repeat(bucket.astype(np.int32), use)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            by_place = place[np.argsort(of_place, kind="stable")]
            place_edge = np.r_[0, np.cumsum(np.bincount(of_place, minlength=buckets))]
            for b in np.flatnonzero(np.diff(edge)).tolist():
                own = order[edge[b] : edge[b + 1]]
                rows.append((b, batch, sign, key[own].astype("<u8").tobytes(), count[own].astype("<u4").tobytes(), b"" if sign > 0 else use[own].astype("<u4").tobytes(), by_place[place_edge[b] : place_edge[b + 1]].tobytes(), b"", b""))
        for k in range(0, len(rows), ROWS):
            yield _rows(_EXPLODED, rows[k : k + ROWS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_id, held = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        parts: list[np.ndarray] = []
        met: defaultdict[bytes, int] = defaultdict()
        met.default_factory = met.__len__
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words(t)
                if ids and (held + len(words) > BATCH_WORDS or len(ids) == 65_535):
                    yield from one(batch_id, ids, parts, met)
                    ids, parts, held, batch_id = [], [], 0, batch_id + 1
                    met.clear()
                ids.append(k)
                parts.append(np.fromiter(map(met.__getitem__, words), dtype=np.uint32, count=len(words)))
                held += len(words)
        if ids:
            yield from one(batch_id, ids, parts, met)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _EXPLODED)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the keys of each bucket and sums their logarithms per batch and document; rows come sorted by bucket and sign."""
    current, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        keys = [np.frombuffer(h[1], dtype="<u8") for h in held]
        counts = [np.frombuffer(h[2], dtype="<u4") for h in held]
        unique, where = np.unique(np.concatenate(keys), return_inverse=True)
        weight = current[1] * np.log(np.bincount(where, weights=np.concatenate(counts), minlength=len(unique)))[where]
        done = 0
        for h, k, n in zip(held, keys, counts):
            total = np.bincount(np.frombuffer(h[4], dtype="<u2"), weights=np.repeat(weight[done : done + len(k)], np.frombuffer(h[3], dtype="<u4") if h[3] else n))
            done += len(k)
            at = np.flatnonzero(total)
            yield _rows(_SUMS, [(h[0], at.astype("<u2").tobytes(), total[at].astype("<f8").tobytes(), b"", b"")])

    for batch in batches:
        for bucket, number, sign, *packed in zip(*(batch.column(k).to_pylist() for k in range(9))):
            if (bucket, sign) != current:
                yield from flush()
                current, held = (bucket, sign), []
            if bucket < 0:
                yield _rows(_SUMS, [(number, b"", b"", packed[4], packed[5])])
            else:
                held.append((number, *packed[:4]))
    yield from flush()


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the sums of each batch; rows come sorted by batch, the row that names its documents first."""
    docs, words, total = np.empty((0, 2), dtype="<i8"), np.empty(0, dtype="<i8"), np.empty(0)

    def out() -> Iterator[pa.RecordBatch]:
        if len(docs):
            # a single word is the only one to count for its document, not against it
            yield pa.RecordBatch.from_arrays([pa.array(docs[:, 0].copy(), mask=docs[:, 1] == 0), pa.array(words), pa.array(np.where(words == 1, -total, total))], names=["doc_id", "words", "part"])

    for batch in batches:
        for _, places, sums, named, lengths in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if named:
                yield from out()
                docs, words = np.frombuffer(named, dtype="<i8").reshape(-1, 2), np.frombuffer(lengths, dtype="<i8")
                total = np.zeros(len(docs))
            elif places:
                total[np.frombuffer(places, dtype="<u2")] += np.frombuffer(sums, dtype="<f8")
    yield from out()


def score_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, log_score)`` per document: natural logarithm of its score under the counts of all documents."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    sums = _exploded(docs, buckets).repartition("bucket").sortWithinPartitions("bucket", "sign").mapInArrow(_summed, _SUMS)
    named_first = (F.octet_length("docs") == 0).cast("int")
    parts = materialise(sums.repartition("batch").sortWithinPartitions("batch", named_first).mapInArrow(_per_document, "doc_id long, words long, part double"), "parts")
    log_total = float(np.log(max(parts.agg(F.sum("words")).first()[0] or 0, 1)))
    return parts.groupBy("doc_id").agg(F.sum("words").alias("n_words"), (F.sum("part") - F.sum((F.col("words") > 0).cast("int")) * log_total).alias("log_score"))


ORACLE = """
WITH r AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT rid, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM r
), c AS (
  SELECT word, count(*) AS n FROM w GROUP BY word
), g AS (
  SELECT rid, pos, word AS b, lag(word) OVER (PARTITION BY rid ORDER BY pos) AS a FROM w
), p AS (
  SELECT a, b, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b
), s AS (
  SELECT g.rid, CASE WHEN g.a IS NULL THEN ln(cb.n) - ln(t.n) ELSE ln(p.n) - ln(ca.n) END AS x
  FROM g JOIN c cb ON g.b = cb.word LEFT JOIN c ca ON g.a = ca.word
    LEFT JOIN p ON g.a = p.a AND g.b = p.b CROSS JOIN (SELECT count(*) AS n FROM w) t
)
SELECT r.doc_id, count(s.x)::BIGINT AS n_words, round(coalesce(sum(s.x), 0), 4) AS log_score
FROM r LEFT JOIN s ON r.rid = s.rid GROUP BY r.doc_id
"""
