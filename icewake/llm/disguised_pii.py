"""Personal data in whole texts, plain or disguised, with the places of both in the source.

A transducer rewrites each text: look-alike letters, digits and signs to ASCII, invisible characters to nothing, spelled
digits to digits, disguises of ``@`` and ``.`` to these.  Every rewriting puts out one character or none and is
noted with the span that it read, so a place of the rewritten text leads back to the source by binary search.  The
detectors run over the source (base spans) and over the rewritten text, of which spans that hold a rewriting count and are
mapped back to source characters.  Base spans always stay.  All patterns take time linear in the text.

Defined results: a null text is empty and has no spans; repeated rows and null ids are kept as they are; other
columns are ignored by ``find`` and kept by ``masked``; an empty table gives no rows.  Spans are in code points, ends
exclusive, ordered by start, then kind as in ``KINDS``, then end.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "｡": ".",
}
# Names of the digits 0 to 9.
DIGITS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
}
# Words for the two signs, and endings of domains that a bare "at" needs.
AT, DOT = ("at", "arroba", "ät", "arobase"), ("dot", "punkt", "punto", "point")
ENDINGS = ("com", "net", "org", "edu", "gov", "info", "biz", "io", "dev", "app", "ai", "co", "uk", "de", "fr", "es", "it", "nl", "eu", "us", "ca", "ch", "at", "be", "example")
INVISIBLE = "\u00ad\u180e\u200b\u200c\u200d\u2060\ufeff"


def _one_for_one() -> dict[str, str]:
    """Characters that stand for one ASCII character: by compatibility, as decimal digits, or by looks."""
    table = {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        digit = unicodedata.decimal(c, None)
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain.isascii() and (plain.isalnum() or plain in " @.+-_%()"):
            table[c] = plain
    return table | LOOKALIKES


def _any(words: tuple[str, ...] | list[str]) -> str:
    return "(?:" + "|".join(sorted(map(re.escape, set(words)), key=len, reverse=True)) + ")"


class Transducer:
    """Rewritings of a text, with the source span of each: characters first, then words of what comes of that.

    Each word has a pattern of its own that starts with the bare word, which is searched fastest, and is used only on
    texts in which the word occurs.
    """

    def __init__(self) -> None:
        self.plain = _one_for_one()
        self.odd = frozenset(self.plain) | set(INVISIBLE)
        value = {w: str(k) for line in DIGITS.values() for k, w in enumerate(line.split()) if w != "un"}  # "un" is an article
        digit, at, dot = _any(list(value)), _any(AT), _any(DOT)
        few, label = "[ \t]{0,3}", "[a-z0-9-]{1,63}"  # the longest label of a domain
        opened, closed = rf"[\[({{<]{few}", rf"{few}[\])}}>]"
        dots = rf"(?:{few}{opened}(?:{dot}|\.){closed}{few}|[ \t]{{1,3}}{dot}[ \t]{{1,3}}|\.)"
        apart = rf"(?:(?:[ \t]{{1,2}}|-|,[ ]?)(?=(?:{digit}|oh[ -]{digit})\b))?"
        blank = lambda w: rf"{w}(?<=[ \t]{w})[ \t]{{1,3}}"
        alone = lambda w: rf"{w}(?<!\w{w})(?!\w)"
        self.rules = {w: (alone(w) + apart, v) for w, v in value.items()}
        self.rules["oh"] = (rf"{alone('oh')}(?=[ -]{digit}\b){apart}", "0")
        self.rules["plus"] = (rf"{alone('plus')}[ \t]{{1,3}}(?=[0-9]|{digit}\b)", "+")
        self.rules |= {w: (rf"{blank(w)}(?={label}(?:{dots}{label}){{0,4}}{dots}{_any(ENDINGS)}\b)", "@") for w in AT}
        self.rules |= {w: (rf"{blank(w)}(?=[a-z0-9])", ".") for w in DOT}
        self.rules = {w: (re.compile(p), new) for w, (p, new) in self.rules.items()}
        self.bracketed = re.compile(rf"{opened}(?:({at}|@)|{dot}|\.){closed}{few}")
        self.word = re.compile(r"[^\W\d_]+")

    def _characters(self, text: str) -> list[tuple[int, int, str]]:
        if text.isascii() or not (odd := self.odd.intersection(text)):
            return []
        found = re.finditer("[" + "".join(map(re.escape, sorted(odd))) + "]", text)
        return [(m.start(), m.end(), self.plain.get(m[0], "")) for m in found]

    def _words(self, text: str) -> list[tuple[int, int, str]]:
        low = text.lower()
        if len(low) != len(text):
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        found = []
        for w in self.rules.keys() & set(self.word.findall(low)):
            rule, new = self.rules[w]
            for m in rule.finditer(low):
                s = m.start()
                if new in "@.":
                    s = self._after(low, s)
                    if s is None:
                        continue
                found.append((s, m.end(), new))
        for m in self.bracketed.finditer(low):
            s = self._after(low, m.start())
            if s is not None and low[m.end() : m.end() + 1].isalnum():
                found.append((s, m.end(), "@" if m[1] else "."))
        found.sort()
        kept, until = [], 0
        for x in found:
            if x[0] >= until:
                kept.append(x)
                until = x[1]
        return kept

    @staticmethod
    def _after(low: str, k: int) -> int | None:
        """Where up to three blanks before k begin, if a letter or digit is before them."""
        s = k
        while s > max(0, k - 3) and low[s - 1] in " \t":
            s -= 1
        return s if s and low[s - 1].isalnum() else None

    def rewritten(self, text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
        """The text, and for each rewriting where it is there (start, end) and what it read (start, end)."""
        once, first = self._pass(text, self._characters(text))
        twice, second = self._pass(once, self._words(once))
        if not first or not second:
            return twice, first or second
        back, forward = Places(first), Places([(s, e, a, b) for a, b, s, e in second])
        both = [(a, b, back.start(s), back.end(e)) for a, b, s, e in second]
        for a, b, s, e in first:
            i = bisect_right(forward.starts, a) - 1
            if i < 0 or a >= forward.noted[i][1] or a == b == forward.starts[i]:  # else a word that was read holds it
                at = forward.start(a)
                both.append((at, at + b - a, s, e))
        return twice, sorted(both)

    @staticmethod
    def _pass(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, int, int]]]:
        out, noted, read, at = [], [], 0, 0
        for s, e, new in edits:
            out += (text[read:s], new)
            at += s - read
            noted.append((at, at + len(new), s, e))
            at += len(new)
            read = e
        return ("".join(out) + text[read:] if noted else text), noted


class Places:
    """Source places of places in a rewritten text."""

    def __init__(self, noted: list[tuple[int, int, int, int]]):
        self.noted, self.starts = noted, [x[0] for x in noted]

    def start(self, k: int) -> int:
        """Source start of the character at k: that of the span read, if it was written for one."""
        i = bisect_right(self.starts, k) - 1
        if i < 0:
            return k
        a, b, s, e = self.noted[i]
        return s if k < b else e + k - b

    def end(self, k: int) -> int:
        """Source end of the character before k."""
        i = bisect_right(self.starts, k - 1) - 1
        if i < 0:
            return k
        a, b, s, e = self.noted[i]
        return e if k - 1 < b else e + k - b

    def within(self, a: int, b: int) -> bool:
        """Whether a rewriting lies in [a, b)."""
        i = bisect_right(self.starts, a - 1)
        return i < len(self.starts) and self.starts[i] < b and self.noted[i][1] <= b


_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    """Whether the check digit of a number fits."""
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ once: what may stand before it, back to the last match, and a domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start, end = at, None
        while start > last and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = last = m.end()
            yield start, end
        at = text.find("@", end or at + 1)


def detect(text: str) -> list[tuple[int, int, int]]:
    """Number of the kind, start and end of every base match."""
    found = [(0, s, e) for s, e in emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


_TRANSDUCER: list[Transducer] = []


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, number of the kind, end, whether it is a base match) of all identifiers, in order."""
    if not _TRANSDUCER:
        _TRANSDUCER.append(Transducer())
    base = detect(text)
    out = {(s, k, e): True for k, s, e in base}
    new, noted = _TRANSDUCER[0].rewritten(text)
    if noted:
        places = Places(noted)
        for k, s, e in detect(new):
            if places.within(s, e):
                out.setdefault((places.start(s), k, places.end(e)), False)
    return [(*key, out[key]) for key in sorted(out)]


_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: kind, start, end of every identifier, and whether it stands there undisguised."""
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {_SPANS}")


def masked(docs: DataFrame, marks: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with every identifier replaced by a mark of its kind; of overlapping ones the earliest, then longest."""
    marks = marks or {k: f"<{k.upper()}>" for k in KINDS}
    small_batches(docs.sparkSession, 500)
    place = docs.columns.index("text")

    def hidden(text: str | None) -> str | None:
        if not text:
            return text
        out, read, until = [], 0, 0
        for s, k, e, _ in sorted(spans(text), key=lambda x: (x[0], -x[2])):
            if s >= until:
                out += (text[read:s], marks[KINDS[k]])
                read = e
            elif e > read:
                read = e  # a later one that reaches beyond an earlier goes with it
            until = max(until, e)
        return "".join(out) + text[read:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([hidden(t.as_py()) for t in batch.column(place)], batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), text)

    return docs.mapInArrow(run, docs.schema)


def of_kind(found: Column, kind: str) -> Column:
    """The spans of one kind."""
    return F.filter(found, lambda s: s["kind"] == kind)


def listed(found: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
