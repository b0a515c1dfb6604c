"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad.  The emission of a line is linear in its own features and in those
of the lines before and after it; the chain couples the labels of adjoining lines.  Forward-backward
marginals, weighted by line length, aggregate into the document's share of good text, and a logistic
curve over the log-odds of that share and the mean emission makes it the probability of label 1.

Features are counts over the bytes of a line (letter case, digits, punctuation, symbols, repetition),
never labels, language, source or ids.  The model is trained here: each line of a labelled document
takes the document's label; at most ``SAMPLE_DOCS`` labelled documents, those with the smallest hash
of their id, of at most ``SAMPLE_LINES`` lines each, are used, whatever the size of the table.

Defined results: a null text is empty, and an empty text is one empty line; rows are scored one by
one, so repeated ids and texts repeat their score; documents with contradicting labels do not train;
without labels of both kinds the score is the share of label 1 (0.5 if there are none); an empty table
gives an empty table; columns are passed through whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SAMPLE_DOCS = 6000
SAMPLE_LINES = 2000
STEPS = 150
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _BANG, _PIPE, _SYMBOL, _HIGH = range(9)


def _classes() -> np.ndarray:
    table = np.full(256, _SYMBOL, dtype=np.uint8)
    for code, chars in ((_SPACE, b" \t\n\r\x0b\x0c"), (_STOP, b".,;:'\"()-?"), (_BANG, b"!"), (_PIPE, b"|"), (_DIGIT, b"0123456789")):
        table[list(chars)] = code
    table[65:91], table[97:123], table[128:] = _UPPER, _LOWER, _HIGH
    return table


_CLASS = _classes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    return x ^ (x >> np.uint64(32))


def _distinct_per(group: np.ndarray, key: np.ndarray, groups: int) -> np.ndarray:
    """Number of distinct keys of each group."""
    mixed = _scrambled(key + _scrambled(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(mixed)
    mixed = mixed[order]
    fresh = np.r_[True, mixed[1:] != mixed[:-1]] if len(mixed) else np.empty(0, dtype=bool)
    return np.bincount(group[order][fresh], minlength=groups)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, lines per text, and weight (length) of every line."""
    lines_of = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(8), dtype=np.uint8)
    body = data[:-8]
    ends = np.flatnonzero(body == 10)
    starts = np.r_[0, ends[:-1] + 1]
    size = (ends - starts).astype(np.float64)
    n = len(starts)
    kind = _CLASS[body]
    count = [np.add.reduceat(kind == c, starts, dtype=np.int32).astype(np.float64) for c in (_UPPER, _DIGIT, _STOP, _BANG, _PIPE, _SYMBOL, _HIGH)]
    space = kind == _SPACE
    first = np.flatnonzero(~space & np.r_[True, space[:-1]])
    last = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    word_size = last - first
    line = np.searchsorted(starts, first, side="right") - 1
    words = np.bincount(line, minlength=n).astype(np.float64)
    # a word is told by its first and last eight bytes and its length
    window = np.lib.stride_tricks.sliding_window_view(data, 8)
    head = np.ascontiguousarray(window[first]).view("<u8").reshape(-1)
    cut = np.minimum(word_size, 8).astype(np.uint64) * np.uint64(8)
    head &= np.where(cut == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (cut % np.uint64(64))) - np.uint64(1))
    tail = np.ascontiguousarray(window[np.maximum(last - 8, first)]).view("<u8").reshape(-1)
    key = _scrambled(head) + np.where(word_size > 8, tail * np.uint64(31), np.uint64(0)) + word_size.astype(np.uint64)
    distinct = _distinct_per(line, key, n)
    twice = np.bincount(line[1:][(key[1:] == key[:-1]) & (line[1:] == line[:-1])], minlength=n)
    doc = np.repeat(np.arange(len(texts)), lines_of)
    sums = np.zeros(n, dtype=np.uint64)
    np.add.at(sums, line, _scrambled(key))
    unique = _distinct_per(doc, sums, len(texts))
    repeated = (1 - unique / lines_of)[doc]
    per = np.maximum(size, 1)
    upper, digit, stop, bang, pipe, symbol, high = (c / per for c in count)
    spread = distinct / np.maximum(words, 1)
    again = twice / np.maximum(words, 1)
    columns = [
        np.log1p(size) / 5, np.log1p(words) / 5, words * 5 / per, upper, digit, stop, 5 * bang, 5 * pipe, 5 * symbol, high,
        spread, again, repeated, upper > 0.4, bang > 0.02, pipe > 0.02, symbol > 0.03, (spread < 0.5) & (words > 4), again > 0.2, repeated > 0.3,
    ]
    return np.stack(columns, axis=1).astype(np.float64), lines_of, size + 1


def with_neighbours(x: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after within the document, and a constant."""
    edge = np.zeros(len(x), dtype=bool)
    edge[np.r_[0, np.cumsum(lines_of)[:-1]]] = True
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[edge] = 0
    after[np.r_[edge[1:], True]] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def _lse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(emission: np.ndarray, lines_of: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of label 1 per line, expected links (2, 2) in all, and log-partition per document.

    ``emission`` is the score of label 1 against 0; ``link[a, b]`` that of label a before label b.
    Documents go side by side, longest first, one line a step.
    """
    order = np.argsort(-lines_of, kind="stable")
    start = np.r_[0, np.cumsum(lines_of)[:-1]][order]
    size = lines_of[order]
    alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), side="right")
    f0, f1 = np.zeros(len(emission)), emission.copy()
    for t in range(1, len(alive)):
        at = start[: alive[t]] + t
        a0, a1 = f0[at - 1], f1[at - 1]
        f0[at] = _lse(a0 + link[0, 0], a1 + link[1, 0])
        f1[at] = _lse(a0 + link[0, 1], a1 + link[1, 1]) + emission[at]
    b0, b1 = np.zeros(len(emission)), np.zeros(len(emission))
    for t in range(len(alive) - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        n0, n1 = b0[at + 1], b1[at + 1] + emission[at + 1]
        b0[at] = _lse(n0 + link[0, 0], n1 + link[0, 1])
        b1[at] = _lse(n0 + link[1, 0], n1 + link[1, 1])
    log_z = np.empty(len(lines_of))
    end = start + size - 1
    log_z[order] = _lse(f0[end], f1[end])
    z = np.repeat(log_z, lines_of)
    marginal = np.exp(np.minimum(f1 + b1 - z, 0))
    expected = np.zeros((2, 2))
    inner = np.ones(len(emission), dtype=bool)
    inner[np.r_[0, np.cumsum(lines_of)[:-1]]] = False
    at = np.flatnonzero(inner)
    for a, f in enumerate((f0, f1)):
        for b, back in enumerate((b0[at], b1[at] + emission[at])):
            expected[a, b] = np.exp(np.minimum(f[at - 1] + link[a, b] + back - z[at], 0)).sum()
    return marginal, expected, log_z


@dataclass
class LineModel:
    weight: np.ndarray
    link: np.ndarray
    curve: np.ndarray  # constant, slope on the log-odds of the share, slope on the mean emission
    constant: float | None = None

    def inputs(self, x: np.ndarray, lines_of: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Per document: constant, log-odds of the length-weighted marginal, length-weighted emission."""
        emission = with_neighbours(x, lines_of) @ self.weight
        marginal, _, _ = forward_backward(emission, lines_of, self.link)
        at = np.r_[0, np.cumsum(lines_of)[:-1]]
        total = np.add.reduceat(size, at)
        share = np.clip(np.add.reduceat(size * marginal, at) / total, 1e-6, 1 - 1e-6)
        mean = np.add.reduceat(size * emission, at) / total
        return np.stack([np.ones(len(lines_of)), np.log(share / (1 - share)), np.clip(mean, -20, 20)], axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = 1 / (1 + np.exp(-np.clip(self.inputs(*line_features(texts)) @ self.curve, -30, 30)))
        return np.clip(out, 0, 1)


def fit_lines(x: np.ndarray, lines_of: np.ndarray, size: np.ndarray, label: np.ndarray) -> LineModel:
    """Maximum conditional likelihood by Adam, then the logistic curve by Newton steps."""
    both = with_neighbours(x, lines_of)
    y = np.repeat(label, lines_of).astype(np.float64)
    inner = np.ones(len(y), dtype=bool)
    inner[np.r_[0, np.cumsum(lines_of)[:-1]]] = False
    seen = np.zeros((2, 2))
    for a in (0, 1):
        seen[a, a] = (y[inner] == a).sum()
    # lines of a document are no independent witnesses: each document weighs as one
    theta = np.zeros(both.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = 1.0 / len(y)
    for step in range(1, STEPS + 1):
        marginal, expected, _ = forward_backward(both @ theta[:-4], lines_of, theta[-4:].reshape(2, 2))
        gradient = np.r_[both.T @ (y - marginal), (seen - expected).reshape(-1)] * scale - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = LineModel(theta[:-4], theta[-4:].reshape(2, 2), np.zeros(3))
    z = model.inputs(x, lines_of, size)
    curve = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(3)
        curve += np.linalg.solve(hessian, z.T @ (label - p) - 1e-3 * curve)
    model.curve = curve
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> LineModel:
    """Fit on the bounded sample of labelled documents that are not held out."""
    small_batches(docs.sparkSession)
    agreed = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    sample = agreed.filter("low = high").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).select(F.col("doc_id").alias("labelled"), F.col("low").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).dropDuplicates(["labelled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, lines_of, size = line_features([(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()])
            at = np.cumsum(lines_of)[:-1]
            packed = [[p[:SAMPLE_LINES].tobytes() for p in np.split(a.astype("<f4"), at)] for a in (x, size)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], names=["doc_id", "label", "x", "size"])

    rows = sorted(texts.select("doc_id", "text", F.col("label").cast("int")).mapInArrow(run, "doc_id long, label int, x binary, size binary").collect(), key=lambda r: r["doc_id"])
    label = np.array([r["label"] for r in rows], dtype=np.float64)
    if len(set(label.tolist())) < 2:
        return LineModel(np.zeros(0), np.zeros((2, 2)), np.zeros(3), float(label.mean()) if len(label) else 0.5)
    sizes = [np.frombuffer(r["size"], dtype="<f4").astype(np.float64) for r in rows]
    lines_of = np.array([len(s) for s in sizes], dtype=np.int64)
    x = np.concatenate([np.frombuffer(r["x"], dtype="<f4") for r in rows]).astype(np.float64).reshape(lines_of.sum(), -1)
    return fit_lines(x, lines_of, np.concatenate(sizes), label)


def score_documents(docs: DataFrame, model: LineModel, name: str = "score") -> DataFrame:
    """``docs`` with one more column, the probability of label 1."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            score = model.scores([(t or "").encode("utf-8", "surrogatepass") for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def without_bad(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score below ``threshold``."""
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    return score_documents(docs, train(docs, labels), name).filter(F.col(name) >= threshold).drop(name)
