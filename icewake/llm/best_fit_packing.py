"""Best-fit packing of token sequences by exact-complement hashing.

Every document becomes one piece of at most ``capacity`` tokens (longer documents are cut into
full pieces after a possibly shorter first one).  Only the histogram of piece lengths, at most
``capacity`` numbers whatever the size of the corpus, reaches the driver.  There the lengths are
combined into bin patterns: single, pair and triple sums are indexed, combinations that fill a gap
exactly are consumed as often as their counts allow, and what is left is placed best-fit.  The
pieces then find their place by their rank among the pieces of the same length, computed by Spark
from per-task counters and a window over (task, length) counts.

Defined results: a null text counts as the empty text (one piece holding only the end id); an empty
table gives an empty table; repeated rows are packed separately; other input columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches

END_ID = 0
CACHE_WORDS = 600_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class ByteBpe:
    """The ids that the ``tokenizers`` library gives for a byte-level BPE file, word by word.

    A blank starts a new pre-token of this vocabulary unless white space stands before it, so a
    text is cut at its blanks, and the ids of each blank-led word are looked up in a bounded cache.
    Texts with white space before a blank, or with the text of a special token, take the library's
    own path as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = self._word_encoder(path)
        self.cache: dict[str, bytes | None] = {}

    def _word_encoder(self, path: str):
        """Rank-based encoder over the same vocabulary; None when the file is no plain byte BPE."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
        if not plain or model.get("type") != "BPE" or model.get("dropout"):
            return None
        # byte-level files write each byte as a printable character: the printable Latin-1 bytes as
        # themselves, the others as the characters from U+0100 on, in order
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = set(self.specials)
        ranks = {bytes(back[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        return _packed(self.library.encode(text, add_special_tokens=False).ids)

    def _fill(self, words: list[str]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, encode = self.cache, self.fast.encode_ordinary
        for w in words:
            if w not in cache:
                cache[w] = None if not w or w[-1].isspace() else _packed(encode(" " + w))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.fast is None or any(s in text for s in self.specials):
            return self._whole(text)
        first, *words = text.split(" ")
        if not words:
            return _packed(self.fast.encode_ordinary(first))
        if not first or first[-1].isspace():
            return self._whole(text) if first else self._led(words, text)
        return _packed(self.fast.encode_ordinary(first)) + self._led(words, text, len(first))

    def _led(self, words: list[str], text: str, skip: int = 0) -> bytes:
        last = words[-1]
        body = words[:-1]
        try:
            out = b"".join(map(self.cache.__getitem__, body))
        except KeyError:
            self._fill(body)
            try:
                out = b"".join(map(self.cache.__getitem__, body))
            except TypeError:
                return self._tail(text, skip)
        except TypeError:
            return self._tail(text, skip)
        return out + _packed(self.fast.encode_ordinary(" " + last))

    def _tail(self, text: str, skip: int) -> bytes:
        return _packed(self.fast.encode_ordinary(text[skip:]))


_ENCODERS: dict[str, ByteBpe] = {}


def _encoder(path: str) -> ByteBpe:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, task, local_rank.

    ``local_rank`` numbers the pieces of one length within the task that made them.  With
    ``keep_ids`` the ids follow as packed little-endian unsigned 32-bit integers.
    """
    small_batches(docs.sparkSession)
    schema = _PIECES + (", ids binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = _encoder(tokenizer_path), np.zeros(capacity + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        end = np.uint32(END_ID).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = bpe.encode(text or "") + end
                n = len(ids) // 4
                start, length = 0, n - (n - 1) // capacity * capacity
                for piece in range((n + capacity - 1) // capacity):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, piece, start, length, zlib.crc32(part), task, int(seen[length])) + ((part,) if keep_ids else ()))
                    seen[length] += 1
                    start, length = start + length, capacity
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = [c.split()[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns (lengths, how often) that use up ``histogram``.

    Largest length first.  Its gap is closed by one length, a pair or a triple with exactly that sum
    where the counts allow; otherwise by the longest length that fits, after which the smaller gap
    is tried again.  A pattern is repeated as often as its scarcest length allows.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        count[length] += n
    pair_of: dict[int, tuple[int, int] | None] = {}

    def free(used: Counter) -> np.ndarray:
        left = count.copy()
        for x, k in used.items():
            left[x] -= k
        return left

    def pair(total: int, left: np.ndarray) -> tuple[int, int] | None:
        known = pair_of.get(total, ())
        if known is None:
            return None  # counts only fall, so a missing pair stays missing
        if known and all(left[x] >= known.count(x) for x in known):
            return known
        a = np.arange(1, total // 2 + 1)
        stock = np.minimum(left[a], left[total - a])
        if total % 2 == 0:
            stock[-1] = left[total // 2] // 2
        best = int(stock.argmax()) if len(stock) else 0
        found = (int(a[best]), int(total - a[best])) if len(stock) and stock[best] > 0 else None
        if found is not None or left is count:
            pair_of[total] = found
        return found

    def exact(gap: int, left: np.ndarray) -> tuple[int, ...] | None:
        if left[gap] > 0:
            return (gap,)
        if (two := pair(gap, left)) is not None:
            return two
        for a in np.flatnonzero(left[1 : gap - 1] > 0)[::-1] + 1:
            rest = left.copy()
            rest[a] -= 1
            if (two := pair(int(gap - a), rest)) is not None:
                return (int(a), *two)
        return None

    patterns: list[tuple[tuple[int, ...], int]] = []
    for longest in range(capacity, 0, -1):
        while count[longest] > 0:
            used, gap = Counter({longest: 1}), capacity - longest
            while gap > 0:
                left = free(used)
                if (combo := exact(gap, left)) is not None:
                    used.update(combo)
                    break
                fits = np.flatnonzero(left[1 : gap + 1] > 0)
                if not len(fits):
                    break
                best = int(fits[-1]) + 1
                used[best] += 1
                gap -= best
            times = min(int(count[x]) // k for x, k in used.items())
            for x, k in used.items():
                count[x] -= k * times
            patterns.append((tuple(sorted(used.elements(), reverse=True)), times))
    return patterns


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of every slot, by rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    base = 0
    for lengths, times in patterns:
        at = 0
        for length in lengths:
            out.setdefault(length, []).append((taken[length], base, at))
            taken[length] += times
            at += length
        base += times
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Pack all documents; returns a row per piece with its sequence_id and offset."""
    pieces = materialise(token_pieces(docs, tokenizer_path, capacity, keep_ids), "pieces")
    dealt = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = dealt.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    histogram = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan_bins(histogram, capacity))  # one slot list per length; no entry grows with the rows
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            for x in np.unique(length):
                own = length == x
                first, base, at = slots[int(x)]
                k = np.searchsorted(first, rank[own], side="right") - 1
                seq[own], off[own] = base[k] + rank[own] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    ranked = pieces.join(ranks, ["length", "task"]).withColumn("rank", F.col("earlier") + F.col("local_rank"))
    return ranked.select(*keep, "rank").mapInArrow(place, schema)
