"""Licence scans with a trained paragraph classifier.

A text is cut at blank lines into paragraphs, and a paragraph into its lines; a
long line is cut to the words around each licence word. Word n-gram
logistic regression names the licence family of each unit, or "unknown"; a
paragraph none of whose lines is named is judged as a whole, as wrapped notices
are, and one of many lines first in overlapping stretches of lines. Probabilities are calibrated by a temperature fitted on held-out
units, and so is the least probability that counts. A prediction stands
only where the unit also holds enough of a template of that family, by n-grams
weighted by how few families share them, and no less than of any other family's.

Numbers and versions are one token, with or without the word, and hyphens part words, so headings,
headers and SPDX identifiers of any version read alike. The classifier is
trained here on variations of the templates and on a bounded
sample of lines of the documents (``n_unknown``); the scan covers every
paragraph of every document.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.llm.common import hash_sample

UNKNOWN = "unknown"

# fixed values: headings, identifiers, headers and body paragraphs of the public licence texts, by family
_GNU = ["GNU {0} General Public License v3.0", "GNU {0} General Public License, version 3", "Licensed under the GNU {0} General Public License, version 2.",
        "This work is licensed under the GNU {0} General Public License, version 3.", "You may redistribute it under the terms of the GNU {0} General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details.",
        "You should have received a copy of the GNU {0} General Public License along with this program.",
        "Licensed under the GNU {1} version 2 or any later version.", "GNU {1} version 3", "{1} v3", "SPDX-License-Identifier: {1}-3.0", "SPDX-License-Identifier: {1}-2.1-or-later",
        "SPDX-License-Identifier: {1}-3.0-only"]
_CC = ["Licensed under CC {0} 4.0.", "CC {0} 4.0", "SPDX-License-Identifier: CC-{0}-4.0", "Creative Commons {1} 4.0 International License", "Creative Commons {1} 3.0",
       "This work is licensed under a Creative Commons {1} 4.0 International License.", "Creative Commons {1} 4.0 International (CC {0} 4.0)"]
TEMPLATES = {
    "agpl": [t.format("Affero", "AGPL") for t in _GNU],
    "all-rights-reserved": ["All rights reserved.", "Copyright by the author. All rights reserved.",
                            "All rights reserved. No part of this work may be reproduced without permission."],
    "apache": ["Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0.", "Apache 2.0 license",
               "SPDX-License-Identifier: Apache-2.0",
               "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
               "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "BSD-style license",
            "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
            "Redistribution and use in source and binary forms, with or without modification, are permitted.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
            "materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
            "prior written permission."],
    "cc-by": [t.format("BY", "Attribution") for t in _CC],
    "cc-by-nc": [t.format("BY-NC", "Attribution-NonCommercial") for t in _CC],
    "cc-by-sa": [t.format("BY-SA", "Attribution-ShareAlike") for t in _CC],
    "cc0": ["Released under CC0 1.0.", "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal.",
            "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "gpl": [t.format("", "GPL") for t in _GNU],
    "lgpl": [t.format("Lesser", "LGPL") for t in _GNU] + ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "mit": ["MIT License", "The MIT License (MIT)", "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl": ["Mozilla Public License, version 2.0", "Licensed under the Mozilla Public License, version 2.0.", "This file is subject to the terms of the Mozilla Public License.",
            "SPDX-License-Identifier: MPL-2.0", "MPL 2.0",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
            "https://mozilla.org/MPL/2.0/."],
}
# sentences with licence words that name no licence
OTHERS = ["You need a driving license to rent a car.", "The band licensed the song to a film.", "The licence fee was paid in full.",
          "She is a licensed teacher in two states.", "Human rights were discussed at length.", "The warranty ends after two years.",
          "The rights of the child are listed in a public document.", "A copyright dispute was settled out of court.",
          "Our licence to operate was renewed in version 2 of the contract.", "Water rights are held by the public.",
          "The museum is in the public eye and reserved for members.", "The general public may apply for a license."]
# a unit is judged if it holds one of these words
TRIGGER = re.compile(r"licen[cs]e|copyright|\brights\b|redistribut|permission|public domain|\bcc0\b|\bcc[ -]by\b|subject to the terms|\bspdx\b|\bgnu\b|gpl\b|"
                     r"\bmpl\b|creative commons|free software|without any warranty|endorse or promote", re.IGNORECASE)
TOKEN = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*")
NUMBER = re.compile(r"v?[0-9]+(?:\.[0-9]+)*")
NEAR = 24  # words on each side of a licence word that are scored together in a long line
WHOLE = 120  # words of a line that is scored as it is
PARAGRAPH = 40  # lines of a longer paragraph that are judged together, from every half of them on


def _plain(token: str) -> str:
    return "#" if NUMBER.fullmatch(token) else token


def _versions(tokens: list[str]) -> list[str]:
    """Without the word "version" before a number."""
    return [t for t, after in zip(tokens, [*tokens[1:], ""], strict=False) if not (after == "#" and t in ("version", "v"))]


def words(text: str) -> list[str]:
    return _versions([_plain(t) for t in TOKEN.findall(text.lower())])


def ngrams(tokens: list[str], most: int = 3) -> list[str]:
    return [" ".join(tokens[i:i + n]) for n in range(1, most + 1) for i in range(len(tokens) - n + 1)]


def passages(line: str) -> list[list[str]]:
    """A line with a licence word, or of a long one the words around each; overlapping stretches are one passage."""
    spans = [[m.start(), m.end()] for m in TRIGGER.finditer(line)]
    if not spans:
        return []
    places = [(t.start(), _plain(t.group())) for t in TOKEN.finditer(line.lower())] if len(line.lower()) == len(line) else None
    if places is None or len(places) <= WHOLE:
        return [words(line)]
    starts = np.array([s for s, _ in places])
    out: list[list[int]] = []
    for s, e in spans:
        lo, hi = max(0, int(np.searchsorted(starts, s)) - NEAR), min(len(places), int(np.searchsorted(starts, e)) + NEAR)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [_versions([w for _, w in places[lo:hi]]) for lo, hi in out]


def paragraphs(text: str) -> list[tuple[int, list[str]]]:
    """(number of the first line, lines) of every stretch of lines without a blank one."""
    out: list[tuple[int, list[str]]] = []
    open_ = False
    for i, line in enumerate(text.split("\n")):
        if not line.strip():
            open_ = False
        elif open_:
            out[-1][1].append(line)
        else:
            out.append((i, [line]))
            open_ = True
    return out


def template_grams() -> tuple[dict[str, list[dict[str, float]]], dict[str, float]]:
    """Each family's templates as {n-gram: weight}, and the weights: the fewer families share an n-gram, the more it says."""
    held: dict[str, set[str]] = {}
    for family, texts in TEMPLATES.items():
        for t in texts:
            for g in ngrams(words(t)):
                held.setdefault(g, set()).add(family)
    weight = {g: float(np.log((1 + len(TEMPLATES)) / len(f))) for g, f in held.items()}
    return {f: [{g: weight[g] for g in ngrams(words(t))} for t in ts] for f, ts in TEMPLATES.items()}, weight


GRAMS, GRAM_WEIGHT = template_grams()


@dataclass
class Classifier:
    """Weights by n-gram, with the calibration."""

    families: list[str]
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5
    confirm: float = 0.7

    def logits(self, tokens: list[str]) -> np.ndarray:
        found = [self.weights[g] for g in set(ngrams(tokens)) if g in self.weights]
        return self.bias + sum(found) if found else self.bias

    def probabilities(self, tokens: list[str]) -> np.ndarray:
        z = self.logits(tokens) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    @staticmethod
    def likeness(tokens: list[str]) -> dict[str, float]:
        """For every family the largest weighted share of a template's n-grams that the unit holds."""
        own = {g for g in ngrams(tokens) if g in GRAM_WEIGHT}
        return {f: max(sum(w for g, w in t.items() if g in own) / sum(t.values()) for t in ts) for f, ts in GRAMS.items()} if own else {}

    def name(self, tokens: list[str]) -> tuple[str, float, float]:
        """(family, probability, likeness) of one unit; unknown unless probable and confirmed."""
        p = self.probabilities(tokens)
        best = int(np.argmax(p))
        family, alike = self.families[best], 0.0
        if family != UNKNOWN:
            found = self.likeness(tokens)
            alike = found.get(family, 0.0)
            if p[best] < self.least or alike < self.confirm or alike < max(found.values()) - 1e-9:
                family = UNKNOWN
        return family, float(p[best]), alike

    def scan(self, text: str | None) -> list[tuple[int, str, float, float]]:
        """(line number, family, probability, likeness) of every licence passage of a whole text; a wrapped notice has its paragraph's first line."""
        if not text or not TRIGGER.search(text):
            return []
        out = []
        for first, lines in paragraphs(text):
            named = [(first + i, *found) for i, line in enumerate(lines) for tokens in passages(line) if (found := self.name(tokens))[0] != UNKNOWN]
            out += named or self._wrapped(first, lines)
        return out

    def _wrapped(self, first: int, lines: list[str]) -> list[tuple[int, str, float, float]]:
        """The notices of a paragraph none of whose lines is named: they may run over lines, and the paragraph over more
        than a notice. One of many lines is judged in overlapping stretches, and where these name nothing as a whole;
        stretches that follow each other and name one family hold one notice, which has the line of the first."""
        whole = " ".join(lines)
        if len(lines) == 1 and sum(1 for _ in islice(TOKEN.finditer(whole.lower()), WHOLE + 1)) <= WHOLE or not TRIGGER.search(whole):
            return []  # judged already, or without a licence word
        out: list[tuple[int, str, float, float]] = []
        if len(lines) > PARAGRAPH:
            before = UNKNOWN
            for at in range(0, len(lines) - PARAGRAPH // 2, PARAGRAPH // 2):
                part = " ".join(lines[at:at + PARAGRAPH])
                found = self.name(words(part)) if TRIGGER.search(part) else (UNKNOWN, 0.0, 0.0)
                if found[0] not in (UNKNOWN, before):
                    out.append((first + at, *found))
                before = found[0]
        if not out:
            found = self.name(words(whole))
            out = [(first, *found)] if found[0] != UNKNOWN else []
        return out


def variations(n: int, seed: int = 7) -> list[tuple[str, list[str]]]:
    """(family, words): ``n`` altered templates per family, words dropped, doubled or set into other text."""
    rng, filler = random.Random(seed), [w for t in OTHERS for w in words(t)]
    rows = []
    for family, texts in TEMPLATES.items():
        for i in range(n):
            tokens = words(texts[i % len(texts)])
            if len(tokens) > 6:
                tokens = [w for w in tokens if rng.random() > 0.05] or tokens
            pad = [rng.choice(filler) for _ in range(rng.randrange(12))] if rng.random() < 0.5 else []
            cut = rng.randrange(len(pad) + 1)
            rows.append((family, pad[:cut] + tokens + pad[cut:]))
    return rows


def train(docs: DataFrame, text_col: str = "text", n_each: int = 90, n_unknown: int = 1500, held_out: float = 0.25,
          confirm: float = 0.7, false_rate: float = 0.005, seed: int = 7) -> tuple[Classifier, dict]:
    """The classifier and its held-out figures.

    Fitted on ``n_each`` variations per family and at most ``n_unknown`` lines
    of the documents, chosen by hash, that hold no licence word together with a
    known notice. Empty documents leave the sentences of OTHERS as unknown class.
    """
    spark: SparkSession = docs.sparkSession
    lines = docs.select(F.explode(F.split(text_col, "\n", -1)).alias("line")).filter(F.length("line") > 0)
    sample = [r["line"] for r in hash_sample(lines, n_unknown)]
    unknown = [t for s in sample for t in (passages(s) or [words(s)[:2 * NEAR]]) if max(Classifier.likeness(t).values(), default=0.0) < 0.5]
    rng = random.Random(seed)
    rows = variations(n_each, seed) + [(UNKNOWN, t) for t in unknown] + [(UNKNOWN, words(t)) for t in OTHERS for _ in range(n_each // 4)]
    rng.shuffle(rows)
    split = int(len(rows) * held_out)
    test, fit = rows[:split], rows[split:]
    families = [UNKNOWN, *TEMPLATES]
    known = [g for f, ts in TEMPLATES.items() for t in ts for g in ngrams(words(t))] + [g for t in OTHERS for g in ngrams(words(t))]
    vocabulary = {g: i for i, g in enumerate(dict.fromkeys(known))}

    def vector(tokens):
        return Vectors.sparse(len(vocabulary), sorted((vocabulary[g], 1.0) for g in set(ngrams(tokens)) if g in vocabulary))

    data = spark.createDataFrame([(float(families.index(f)), vector(t)) for f, t in fit], ["label", "features"]).coalesce(1).cache()
    model = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60, standardization=False).fit(data)
    data.unpersist()
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    out = Classifier(families, {g: matrix[:, i] for g, i in vocabulary.items() if np.abs(matrix[:, i]).max() > 1e-6}, bias, confirm=confirm)

    # calibration on the held-out rows: a temperature, then the least probability
    truth = np.array([families.index(f) for f, _ in test])
    logits = np.array([out.logits(t) for _, t in test])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]).mean())

    out.temperature = min((loss(t), t) for t in np.geomspace(0.1, 10, 81))[1]
    wrong = sorted((float(out.probabilities(t).max()) for f, t in test if f == UNKNOWN and int(np.argmax(out.logits(t))) != 0), reverse=True)
    allowed = int(false_rate * max(1, sum(f == UNKNOWN for f, _ in test)))
    out.least = max(0.5, wrong[allowed] + 1e-9 if len(wrong) > allowed else 0.5)
    named = [out.name(t)[0] for _, t in test]
    return out, {"held_out": len(test), "accuracy": float(np.mean([a == f for a, (f, _) in zip(named, test, strict=True)])),
                 "nll": loss(out.temperature), "temperature": out.temperature, "least": out.least}


def scan_licenses(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): per document its licence passages (line_no, family, probability, likeness), in order.

    Every row is scanned by itself over its whole text. Null and empty texts
    have no spans, repeated rows and null ids stay, an empty table gives an
    empty result, and other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("line_no", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64())]))
        for b in batches:
            found = [[dict(zip(("line_no", "family", "probability", "likeness"), s, strict=True)) for s in classifier.scan(t.as_py())]
                     for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, f"id {kind}, spans array<struct<line_no:bigint,family:string,probability:double,likeness:double>>")
