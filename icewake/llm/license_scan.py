"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

A sparse logistic regression over word 1-, 2- and 3-grams gives every paragraph of every document
a probability for each licence family and for ``unknown``.  It is trained here on variants of the notice
templates below (fields filled in, words dropped, context added, halves quoted) against ordinary
paragraphs; one variant in five is held out, and a temperature fitted on those calibrates the
probabilities.  A paragraph whose likeliest class is a family with probability of ``CONFIDENCE`` or more
is a finding; it is confirmed when it shares enough word pairs with a template of that family.

A paragraph is a run of lines that ends at a line without words or where a line ends a sentence, so that a
notice wrapped over lines is scored whole.  One of more than ``WINDOW`` words is scored in overlapping windows,
of which the surest finding counts.  If a paragraph of several lines has no finding, its lines are scored one by
one, as the declaration in a list of settings may be one of them.  Every paragraph with a word of the templates
is scored; words that no template holds have no weight, so one without any is unknown whatever it says.

At most ``SAMPLE_DOCS`` documents, those of smallest id hash, give paragraphs of the unknown class.

Defined results: null and empty texts have no findings; repeated rows repeat their findings; a paragraph is
numbered by its first line, from 0; of equal probabilities the family listed first and the first window count;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

UNKNOWN = "unknown"
CONFIDENCE = 0.5
CONFIRMED = 0.5
SAMPLE_DOCS = 1500
SAMPLE_LINES = 20  # of each
SAMPLE_CHARS = 600  # of each line
VARIANTS = 60
WINDOW = 96  # words that are scored together; windows start at every half of it
AT_ONCE = 100_000  # words that a task scores in one step

# fixed values: wording that public licence notices use
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal, dedicated to the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
}
# fixed values: ordinary sentences that use the same words
NEAR_MISSES = [
    "A driving license is needed to rent a car in this country.",
    "The license was renewed last year by the public office.",
    "The new version was released under heavy rain in the capital.",
    "Version 2.0 of the plan was published by the foundation.",
    "All rights reserved. Copyright 2020 by the author.",
    "The general public may visit the source of the river free of charge.",
    "You may obtain a copy of the report at the office.",
    "Permission to enter the building is granted to any person with a ticket.",
    "The software is sold without restriction in most shops.",
    "This work is the creative effort of a common team.",
    "The Apache people lived in the southwest, a film about them was released.",
    "She studied at MIT and later licensed her patent to a company.",
    "Redistribution of wealth in binary or other forms is debated.",
    "Er geht mit dem Hund in die Stadt.",
    "mit",
    "Sie kam mit einem Zug.",
    "Version 2.0",
    "license",
    "or later",
]

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 or c == 10 else 32 for c in range(256))


# a bare declaration, after the identifier that each family's last template states
for _texts in TEMPLATES.values():
    _texts.append("License: " + _texts[-1].removeprefix("SPDX-License-Identifier: "))


def _words(line: bytes) -> list[bytes]:
    return line.translate(_FOLD).split()


def paragraphs(text: str) -> list[list[tuple[int, list[bytes]]]]:
    """Lines, as number and lower-cased words, of every paragraph."""
    found: list[list[tuple[int, list[bytes]]]] = []
    going = False
    for k, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        words = _words(line)
        if words:
            if not going:
                found.append([])
            found[-1].append((k, words))
        going = bool(words) and not line.rstrip(b" \t\r\"'*/)").endswith((b".", b"!", b"?"))
    return found


def _joined(lines: list[tuple[int, list[bytes]]]) -> list[bytes]:
    return [w for _, words in lines for w in words]


def windows(words: list[bytes]) -> list[list[bytes]]:
    """Overlapping parts of at most WINDOW words; all words together, if they are no more."""
    return [words[s : s + WINDOW] for s in range(0, max(len(words) - WINDOW // 2, 1), WINDOW // 2)]


def _grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


@dataclass
class LicenseModel:
    families: list[str]
    grams: dict[tuple[bytes, ...], int]  # every gram of the templates -> row of weight
    weight: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[set[tuple[bytes, ...]]]]

    def __post_init__(self) -> None:
        """Number the words, and for each length of gram keep its sorted codes and their rows."""
        self.number = {w: k for k, w in enumerate(sorted({w for g in self.grams for w in g}))}
        self.codes = []
        for n in (1, 2, 3):
            coded = sorted((self._code([self.number[w] for w in g]), row) for g, row in self.grams.items() if len(g) == n)
            self.codes.append((np.array([c for c, _ in coded], dtype=np.int64), np.array([r for _, r in coded], dtype=np.int64)))

    def _code(self, numbers):
        code = numbers[0]
        for x in numbers[1:]:
            code = code * len(self.number) + x
        return code

    def probabilities(self, units: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Class probabilities of each list of words, and whether it holds a known word."""
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        words = np.fromiter(map(self.number.get, chain.from_iterable(units), repeat(-1)), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(units)), sizes)
        found = []
        for n, (codes, rows) in enumerate(self.codes, 1):
            starts = max(len(words) - n + 1, 0)
            parts = [words[k : k + starts] for k in range(n)]
            at = np.flatnonzero((np.min(parts, axis=0) >= 0) & (owner[:starts] == owner[n - 1 : n - 1 + starts]))
            code = self._code([p[at] for p in parts])
            place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[place] == code
            found.append(owner[at[hit]] * len(self.weight) + rows[place[hit]])
        owner, row = np.divmod(np.unique(np.concatenate(found)), len(self.weight))  # a gram counts once
        z = np.zeros((len(units), len(self.families)))
        known, first, n = np.unique(owner, return_index=True, return_counts=True)
        if len(known):
            z[known] = np.add.reduceat(self.weight[row], first, axis=0) / np.sqrt(n)[:, None]
        z = (z + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), np.isin(np.arange(len(units)), known)

    def similarity(self, words: list[bytes], family: str) -> float:
        """Largest share of a template's word pairs, or of the paragraph's, that both have."""
        own = {g for g in _grams(words) if len(g) == 2}
        return max((len(own & t) / min(len(t), max(len(own), 4)) for t in self.templates.get(family, [])), default=0.0)

    def findings(self, texts: list[list[bytes]]) -> list[tuple[str, float, float] | None]:
        """Family, probability and similarity of each text's surest window, None where that is unknown."""
        parts = [windows(words) for words in texts]
        p, known = self.probabilities([w for part in parts for w in part])
        best, sure = p.argmax(axis=1), p.max(axis=1)
        sure[~known | (best == 0) | (sure < CONFIDENCE)] = -1
        out, s = [], 0
        for part in parts:
            k = s + int(sure[s : s + len(part)].argmax())
            family = self.families[best[k]]
            out.append((family, float(sure[k]), self.similarity(part[k - s], family)) if sure[k] > 0 else None)
            s += len(part)
        return out


def _variants(rng: random.Random, noise: list[list[bytes]]) -> Iterator[tuple[int, list[bytes]]]:
    """(family number, words) of altered templates and near misses."""
    for number, texts in enumerate([NEAR_MISSES, *TEMPLATES.values()]):
        for text in texts:
            words = _words(text.encode())
            for k in range(VARIANTS if number else VARIANTS // 4):
                w = list(words)
                if k and len(w) > 12 and k % 3 == 0:
                    half = rng.randrange(len(w) // 2)
                    w = w[half : half + max(10, len(w) // 2)]
                if k and k % 4 == 1:
                    w = [x for x in w if rng.random() > 0.08] or w
                if k and k % 2 == 0:
                    around = rng.choice(noise)
                    cut = rng.randrange(len(around) + 1)
                    w = around[max(0, cut - rng.randrange(12)) : cut] + w + around[cut : cut + rng.randrange(12)]
                yield number, w


def fit(noise: list[list[bytes]], seed: int = 11) -> LicenseModel:
    """Multinomial logistic regression by gradient steps on sparse counts; index 0 is ``unknown``."""
    rng = random.Random(seed)
    noise = noise or [[b"and", b"the", b"other", b"words"]]
    families = [UNKNOWN, *TEMPLATES]
    templates = {f: [{g for g in _grams(_words(t.encode())) if len(g) == 2} for t in texts] for f, texts in TEMPLATES.items()}
    like = set().union(*(t for ts in templates.values() for t in ts))
    grams = sorted({g for texts in TEMPLATES.values() for t in texts for g in _grams(_words(t.encode()))})
    number = {g: k for k, g in enumerate(grams)}
    # a sampled paragraph that quotes a template is no example of the unknown class
    plain = [w for w in noise if len({g for g in _grams(w) if len(g) == 2} & like) < 3]
    examples = [*_variants(rng, plain or noise), *((0, w) for w in plain)]
    rng.shuffle(examples)
    rows = [[number[g] for g in _grams(w) if g in number] for _, w in examples]
    y = np.array([k for k, _ in examples])
    flat = np.concatenate([np.array(r, dtype=np.int64) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = (1 / np.sqrt(np.maximum([len(r) for r in rows], 1)))[owner]
    train = np.arange(len(rows)) % 5 != 0
    target = np.eye(len(families))[y]
    # all plain paragraphs together weigh as much as the altered templates
    importance = np.where(y == 0, (y > 0).sum() / max((y == 0).sum(), 1), 1.0)
    weight, bias = np.zeros((len(grams), len(families))), np.zeros(len(families))
    speed_w, speed_b = np.zeros_like(weight), np.zeros_like(bias)

    def logits() -> np.ndarray:
        z = np.zeros((len(rows), len(families)))
        np.add.at(z, owner, weight[flat] * value[:, None])
        return z + bias

    for _ in range(60):
        z = logits()
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (target - p) * (importance * train)[:, None]
        gradient = np.zeros_like(weight)
        np.add.at(gradient, flat, error[owner] * value[:, None])
        gradient = gradient / np.sqrt(1 + np.bincount(flat, minlength=len(grams)))[:, None] - 1e-3 * weight
        speed_w = 0.9 * speed_w + 0.1 * gradient
        speed_b = 0.9 * speed_b + 0.1 * error.sum(axis=0) / np.sqrt(train.sum())
        weight += speed_w
        bias += 0.1 * speed_b
    z = logits()[~train]

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(importance[~train] * (s[np.arange(len(s)), y[~train]] - np.log(np.exp(s).sum(axis=1)))).mean())

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return LicenseModel(families, number, weight, bias, temperature, templates)


def train(docs: DataFrame) -> LicenseModel:
    """Fit with ordinary paragraphs of a bounded sample of documents."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    # ids first, so that no text is sorted; a bounded table
    chosen = F.broadcast(own.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct())
    lines = F.transform(F.slice(F.split("text", "\n"), 1, SAMPLE_LINES), lambda x: F.substring(x, 1, SAMPLE_CHARS))
    rows = sorted(own.join(chosen, "doc_id").select("doc_id", F.array_join(lines, "\n").alias("text")).collect())  # for training only
    return fit([w for r in rows for p in paragraphs(r["text"]) for w in windows(_joined(p)) if len(w) >= 3])


def scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """A row per licence paragraph: doc_id, paragraph, family, probability, similarity, confirmed."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, paragraph int, family string, probability double, similarity double, confirmed boolean"

    def found(own: list[tuple[int, list[tuple[int, list[bytes]]]]]) -> list[tuple]:
        whole = list(zip(own, model.findings([_joined(lines) for _, lines in own])))
        single = [(doc, line) for (doc, lines), f in whole if f is None and len(lines) > 1 for line in lines]
        rows = [(doc, lines[0][0], *f) for (doc, lines), f in whole if f is not None]
        rows += [(doc, k, *f) for (doc, (k, _)), f in zip(single, model.findings([words for _, (_, words) in single])) if f is not None]
        return [(*r, r[4] >= CONFIRMED) for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
        for b in batches:
            rows, own, n = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for lines in paragraphs(text or ""):
                    own.append((doc, lines))
                    n += sum(len(words) for _, words in lines)
                    if n > AT_ONCE:
                        rows += found(own)
                        own, n = [], 0
            rows += found(own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
