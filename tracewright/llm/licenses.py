"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A sparse logistic model over word n-grams (one and two words), with a class for each family and one
for everything else, is trained here on variants of TEMPLATES (cut, with words left out or strange ones
put in) against paragraphs that mention licences without giving one, and a bounded sample of ordinary
ones. Its temperature is set on variants kept from the fit, its least probability on templates and paragraphs that
the fit hasn't met; a third lot of templates measures precision and coverage. Then all templates are fitted. A family
that the model names counts only if the paragraph also shares enough n-grams with one of its templates.

Paragraphs are lines, joined with the next while they end without punctuation (wrapped notices) and are no
longer than LONGEST characters together; nothing of a text is left out. Every
paragraph of every whole text is scored; one whose n-grams can't lift any family over the unknown class
even at best is known to be unknown without its full score.

Defined results: null and empty texts have no paragraphs; repeated rows give repeated rows; ties go to
the family first by name; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import ship

from .common import Rows, descend, over_texts, table

#: Words that public licences are known by: notices, headers, first sentences (fixed values).
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This product is released under the Apache License 2.0; see the LICENSE file for the Apache License terms.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "This file is distributed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Licensed under the GNU GPL v3.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
        "This project is licensed under the terms of the MIT license.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License, version 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "bsl": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "SPDX-License-Identifier: EPL-2.0"],
}
#: Paragraphs that speak of licences, software and terms without granting any.
STRANGERS = [
    "All rights reserved.", "The driving license was renewed by the public office.", "This work is the general version of the software under review.", "Please read the terms of use.",
    "The file is distributed to any person in the public office.", "He released the book under the title in the year 2020.", "The license fee is 4.0 dollars a month.", "A copy of the notice is in the file.",
    "Apache helicopters were released in version 2.0 of the game.", "MIT students may use the source of the library free of charge.", "The software license has expired; contact the vendor for a new one.",
    "The warranty of the car covers any kind of damage but is limited to the first owner.", "You may copy the recipe as often as you like.", "The authors are not liable for late trains.", "Conditions of sale: payment within thirty days, without deduction.",
    "The public library is open to any person with a card, free of charge.", "This general statement of the foundation was published in version 2 of the report.", "See the file for a list of conditions and names of contributors to the museum.",
    "The source of the river is in the mountains; the above notice is about fishing.", "Rights to the film were sold without restriction to a distributor.", "the license", "under the", "version 3", "Permission to enter is hereby denied.", "this is the public domain of the city", "the terms and conditions of sale apply to all copies of the work",
]
UNKNOWN = "unknown"
#: Most ordinary paragraphs taken into the fit, of so many documents, about, and their longest; and the
#: length at which a paragraph ends with its line.
SAMPLED, SAMPLED_DOCUMENTS, LONGEST = 2000, 400, 2000
MENTIONS = re.compile(r"licen[cs]e|copyright|commons|permission|redistribut", re.I)
VARIANTS, SEED = 60, 3
#: Least share of a template's or the paragraph's n-grams that confirms a prediction.
CONFIRM = 0.4
TOKEN = re.compile(r"[a-z]+|\d+")
OPEN = re.compile(r"[\w,(\"'-]$")


def tokens(paragraph: str) -> list[str]:
    return TOKEN.findall(paragraph.lower())


def grams(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


def paragraphs(text: str) -> list[str]:
    out, held = [], ""
    for line in text.split("\n"):
        line = line.strip()
        held = f"{held} {line}" if held else line
        if not line or not OPEN.search(held) or len(held) > LONGEST:
            if held:
                out.append(held)
            held = ""
    return out + [held] if held else out


def variants(words: list[str], strange: list[str], rng: np.random.Generator, n: int) -> list[list[str]]:
    """The words themselves, then cut to a run, thinned, and set among strange words."""
    out = [words]
    for _ in range(n - 1):
        size = int(rng.integers(max(3, len(words) * 6 // 10), len(words) + 1)) if len(words) > 3 else len(words)
        at = int(rng.integers(0, len(words) - size + 1))
        w = [x for x in words[at : at + size] if rng.random() > 0.05]
        around = [strange[i] for i in rng.integers(0, len(strange), int(rng.integers(0, 12)))] if strange else []
        cut = int(rng.integers(0, len(around) + 1))
        out.append(around[:cut] + w + around[cut:])
    return out


def confirmed(words: list[str], templates: list[set[str]]) -> bool:
    """Whether the words share enough n-grams with one of the templates."""
    mine = grams(words)
    return any(len(mine & t) >= CONFIRM * len(t) or len(mine) >= 4 and len(mine & t) >= 0.8 * len(mine) for t in templates)


class Classifier:
    """Softmax over families and unknown; columns only for the n-grams of templates and strangers."""

    def __init__(self, sample: list[str]):
        self.families = [*sorted(TEMPLATES), UNKNOWN]
        self.templates = {f: [grams(tokens(t)) for t in ts] for f, ts in TEMPLATES.items()}
        self.column = {g: i + 1 for i, g in enumerate(sorted({g for ts in self.templates.values() for t in ts for g in t} | {g for t in STRANGERS for g in grams(tokens(t))}))}
        lots = self.lots([tokens(p) for p in sample])
        self.w = self.fitted([r for i, r in enumerate(lots[0]) if i % 5])
        rows = lots[0][::5]
        truth = np.array([c for _, c in rows])
        scores = self.scores([w for w, _ in rows])
        loss = lambda t: -np.log(self.softmax(scores / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        rows = lots[1]
        truth = np.array([c for _, c in rows])
        top = self.named(self.scores([w for w, _ in rows]), truth)[0][truth == len(self.families) - 1]
        #: Least probability at which at most one in a hundred of the strangers not fitted gets a family.
        self.least = next((t for t in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95) if (top >= t).mean() <= 0.01), 0.95)
        #: On kept variants of fitted templates: share of named families that are right.
        rows = lots[0][::5]
        truth = np.array([c for _, c in rows])
        top, wrong = self.named(self.scores([w for w, _ in rows]), truth)
        self.known_precision = float(1 - wrong[top >= self.least].mean()) if (top >= self.least).any() else 1.0
        #: On templates that neither the fit nor the threshold met, with those of the fit to confirm: share of
        #: families named and confirmed that are right, and of licences that get one (most wordings are unlike
        #: the others of their family); and the share that the model alone names rightly.
        rows = lots[2]
        truth = np.array([c for _, c in rows])
        scores = self.scores([w for w, _ in rows])
        top, wrong = self.named(scores, truth)
        fitted = {f: [grams(tokens(t)) for i, t in enumerate(ts) if self.lot(n, i, ts) == 0] for n, (f, ts) in enumerate(TEMPLATES.items())}
        family = [self.families[c] for c in scores[:, :-1].argmax(axis=1)]
        sure = (top >= self.least) & [confirmed(w, fitted[f]) for (w, _), f in zip(rows, family, strict=True)]
        licensed = truth < len(self.families) - 1
        self.heldout_precision = float(1 - wrong[sure].mean()) if sure.any() else 1.0
        self.heldout_coverage = float(sure[licensed].mean()) if licensed.any() else 1.0
        self.heldout_unconfirmed_precision = float(1 - wrong[top >= self.least].mean()) if (top >= self.least).any() else 1.0
        self.w = self.fitted([r for lot in lots for r in lot])
        lift = np.maximum(self.w[:-1] - self.w[-1], 0).max(axis=0)
        self.bias = float((self.w[:-1, 0] - self.w[-1, 0]).max())
        best: dict[str, float] = {}
        for g, i in self.column.items():
            if " " in g:
                best[g.split()[0]] = max(best.get(g.split()[0], 0.0), float(lift[i]))
        self.gain = {g: float(lift[i]) + best.get(g, 0.0) for g, i in self.column.items() if " " not in g}

    @staticmethod
    def lot(family: int, i: int, templates: list[str]) -> int:
        """0: fit, 1: threshold, 2: test. Of two templates, one is for the threshold or the test, by turns."""
        return i % 3 if len(templates) > 2 else i * (1 + family % 2)

    def lots(self, ordinary: list[list[str]]) -> list[list[tuple[list[str], int]]]:
        """Variants of templates, strangers and ordinary paragraphs to fit, calibrate and test on, with their
        families' numbers; all variants of one template are in one lot."""
        rng = np.random.default_rng(SEED)
        strange = sorted({w for p in ordinary for w in p})
        # a cut that another family's template holds as well says nothing of the family
        every = {g for ts in self.templates.values() for t in ts for g in t}
        elsewhere = {f: [t for o, ts in self.templates.items() if o != f for t in ts] for f in TEMPLATES}
        decides = lambda f, w: not any(grams(w) & every <= t for t in elsewhere[f])
        lots: list[list] = [[], [], []]
        for n, (f, ts) in enumerate([*TEMPLATES.items(), (UNKNOWN, STRANGERS)]):
            for i, t in enumerate(ts):
                lots[self.lot(n, i, ts)] += [(w, self.families.index(f)) for w in variants(tokens(t), strange, rng, VARIANTS) if f == UNKNOWN or decides(f, w)]
        for i, w in enumerate(ordinary):
            lots[i % 3].append((w, len(self.families) - 1))
        return lots

    def fitted(self, rows: list[tuple[list[str], int]]) -> np.ndarray:
        k, width = len(self.families), len(self.column) + 1
        x, y = self.matrix([w for w, _ in rows]), np.array([c for _, c in rows])

        def gradient(p):
            w = p.reshape(k, width)
            q = self.softmax(np.stack([x.times(v) for v in w], axis=1))
            q[np.arange(len(y)), y] -= 1
            return (np.stack([x.back(q[:, c]) for c in range(k)]) / len(y) + 1e-4 * w).ravel()

        return descend(gradient, np.zeros(k * width), 120, 0.15).reshape(k, width)

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        x = self.matrix(rows)
        return np.stack([x.times(v) for v in self.w], axis=1)

    def named(self, scores: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of the likeliest family, whether it is wrong)."""
        chance = self.softmax(scores / self.temperature)
        return chance[:, :-1].max(axis=1), (truth == len(self.families) - 1) | (chance[:, :-1].argmax(axis=1) != truth)

    @staticmethod
    def softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def columns(self, words: list[str]) -> np.ndarray:
        return np.array([0, *sorted(self.column[g] for g in grams(words) if g in self.column)])

    def matrix(self, rows: list[list[str]]) -> Rows:
        cols = [self.columns(r) for r in rows]
        return Rows([(c, np.ones(len(c))) for c in cols], len(self.column) + 1)

    def classify(self, paragraph: str) -> tuple[str, float, bool]:
        """(family or unknown, its probability, whether a template confirms it)."""
        words = tokens(paragraph)
        gain = self.gain
        # the largest lead over unknown that its n-grams allow
        if self.bias + sum(gain[w] for w in {*words} & gain.keys()) <= 0:
            return UNKNOWN, 1.0, False
        p = self.softmax(self.w[:, self.columns(words)].sum(axis=1) / self.temperature)
        at = int(p[:-1].argmax())
        if p[at] < self.least:
            return UNKNOWN, float(p[-1]), False
        family = self.families[at]
        return family, float(p[at]), confirmed(words, self.templates[family])


SPEC = "doc_id long, n_paragraphs long, n_licensed long, families string, family string, probability double, unconfirmed long"


def ordinary_paragraphs(docs: DataFrame) -> list[str]:
    """At most SAMPLED paragraphs of up to LONGEST characters without licence words, the first by md5 of
    some SAMPLED_DOCUMENTS documents, themselves chosen by md5 of doc_id: a bounded sample for the fit.
    Texts are cut into paragraphs where they lie."""
    rows = docs.where(F.length("text") > 0).select(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("p"))).alias("__k"), "text")
    n = rows.count()
    if n > SAMPLED_DOCUMENTS:
        rows = rows.where(F.conv(F.substring("__k", 1, 8), 16, 10).cast("long") < F.lit(int((1 << 32) * SAMPLED_DOCUMENTS / n)))
    ship(docs.sparkSession)

    def work(batches):
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = [p for p in paragraphs(text) if len(p) <= LONGEST and not MENTIONS.search(p)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["p"])

    found = rows.select("text").mapInArrow(work, "p string").distinct().orderBy(F.md5("p"), "p").limit(SAMPLED)
    return [r["p"] for r in found.collect()]


def license_scan(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> paragraphs, how many give a licence, the families found (sorted,
    comma-joined), the likeliest with its probability, and predictions that no template confirmed."""
    shared = docs.sparkSession.sparkContext.broadcast(Classifier(ordinary_paragraphs(docs)))

    def make():
        model = shared.value

        def work(batch):
            rows = []
            for text in batch:
                parts = paragraphs(text)
                found = [model.classify(p) for p in parts]
                sure = [(f, p) for f, p, ok in found if f != UNKNOWN and ok]
                top = min(sure, key=lambda x: (-x[1], x[0]), default=(UNKNOWN, 0.0))
                rows.append((len(parts), len(sure), ",".join(sorted({f for f, _ in sure})), top[0], top[1], sum(f != UNKNOWN and not ok for f, _, ok in found)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64())
            names = [x.split()[0] for x in SPEC.split(", ")][1:]
            return {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds, strict=True))}

        return work

    return over_texts(docs.select("doc_id", "text"), make, SPEC)


def query(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))
