"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

The encoding of every prefix of a word is unique, so one token per prefix, its last, describes all
of them.  An Aho-Corasick automaton reports which vocabulary pieces end at a position; the last
token there is the one piece that is compatible with the last token of the prefix before it, where
two pieces are compatible if merging their concatenation gives back the two of them.  The ids are
recovered from the end of the word backwards.  No piece of such a vocabulary continues past a word
start, which is checked when the model is loaded, so words are independent and are cached.

Defined results: a null text counts as empty; the empty text gives the begin and end ids only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPACE = "▁"
CACHE_WORDS = 700_000
CACHE_PAIRS = 1_000_000
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceCodec:
    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = lib.vocab_size()
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        self.ids = {lib.id_to_piece(i): i for i in range(n) if not special[i]}
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in range(n) if not special[i]}
        byte = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_ids = [byte[b] for b in range(256)] if len(byte) == 256 else None
        self.bytes_of = [b"" if lib.is_control(i) else lib.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        for b, i in byte.items():
            self.bytes_of[i] = bytes([b])
        self.bytes_of[self.unk] = " ⁇ ".encode()
        self.is_byte = np.array([lib.is_byte(i) for i in range(n)])
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of this vocabulary continues past a word start")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merge(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Bottom-up merging of a short text: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == [left, right]
        return known

    def tokens(self, word: str) -> list[str]:
        """The pieces of one word, through its prefix table."""
        last: list[str] = [""] * (len(word) + 1)
        fits = self.fits
        for end, piece in self.automaton.iter(word):
            if last[end + 1]:
                continue
            at = end + 1 - len(piece)
            # characters that no piece ends with stand alone; fill them in before looking back
            if at and not last[at]:
                self._alone(word, last, at)
            if not at or fits(last[at], piece):
                last[end + 1] = piece
        out, at = [], len(word)
        while at:
            piece = last[at] or word[at - 1]
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    @staticmethod
    def _alone(word: str, last: list[str], at: int) -> None:
        while at and not last[at]:
            last[at] = word[at - 1]
            at -= 1

    def word_ids(self, word: str) -> bytes:
        out: list[int] = []
        for piece in self.tokens(word):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte_ids is not None:
                out.extend(self.byte_ids[b] for b in piece.encode())
            else:
                out.append(self.unk)
        return np.asarray(out, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids with the begin and end ids, as little-endian unsigned 32-bit integers."""
        head, tail = (np.uint32(i).tobytes() for i in (self.bos, self.eos))
        if not text:
            return head + tail
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            words = _RUNS.findall(SPACE + text.replace(" ", SPACE))
        else:
            words = text.split(" ")
            words = [SPACE + w for w in words]
        cache = self.words
        try:
            return head + b"".join(map(cache.__getitem__, words)) + tail
        except KeyError:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for w in words:
                if w not in cache:
                    cache[w] = self.word_ids(w)
            return head + b"".join(map(cache.__getitem__, words)) + tail

    def decode(self, ids: bytes) -> str:
        """Text of packed ids: byte pieces joined, the blank that encoding put first dropped."""
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        out = b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


_CODECS: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    if model_path not in _CODECS:
        _CODECS[model_path] = PieceCodec(model_path)
    return _CODECS[model_path]


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit integers) and the decoded text of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            text = [c.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(text, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")
