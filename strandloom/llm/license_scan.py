"""License scans by a trained paragraph classifier.

Sparse multinomial logistic regression over word bigrams is fitted on the driver, once a process, from the statements in
``TEMPLATES`` (short phrases and the paragraphs of whole notices) and seeded variations of them, against an unknown class
of sentences that share their words.  Its penalty makes most weights zero.  A temperature and a least probability, fitted
on variations kept apart, calibrate it: below that probability a paragraph is unknown.  What remains has to be confirmed:
a statement of the predicted family must be in the paragraph to four fifths, counted in bigrams.  Paragraphs stand
between blank lines, so a wrapped notice is one; each line of one is also judged by itself, since a short phrase may
stand in a long paragraph.  A family that is not the most probable is confirmed where every bigram of one of its
statements is in the paragraph.

Scoring is one pass of DataFrame functions, without a shuffle, over every paragraph of every text: its bigrams are
intersected with the vocabulary, and the weights of what is left are added up inside the row.  Bigrams of two words from
``PLAIN`` are no features.  A paragraph without any known bigram has the score of an empty one, which is unknown, and so
have its lines: they need no sums.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import let

UNKNOWN = "unknown"
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
#: Statements by licence family: short phrases, then the paragraphs of the family's notice that are its own.  Fixed values.
TEMPLATES = {
    "agpl-3.0": (
        "licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "distributed under the terms of the Apache License 2.0",
        "you may not use this file except in compliance with the License",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "bsd": (
        "released under the BSD 3-Clause License",
        "distributed under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "cc-by": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc0": (
        "dedicated to the public domain under CC0 1.0 Universal",
        "released under the Creative Commons Zero license",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ),
    "gpl-2.0": (
        "licensed under the GNU General Public License, version 2",
        "redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "gpl-3.0": (
        "licensed under the GNU General Public License, version 3",
        "either version 3 of the License, or (at your option) any later version",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "isc": (
        "released under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "lgpl": (
        "licensed under the GNU Lesser General Public License",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see <https://www.gnu.org/licenses/>.",
    ),
    "mit": (
        "Released under the MIT License",
        "licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _WARRANTY,
    ),
    "mpl-2.0": (
        "subject to the terms of the Mozilla Public License, v. 2.0",
        "licensed under the Mozilla Public License 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "reserved": ("All rights reserved", "Copyright. All rights reserved", "All rights reserved. No part of this publication may be reproduced without prior written permission"),
    "unlicense": (
        "released under the Unlicense",
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
#: Sentences of the unknown class that speak of licences without granting one.
OTHERWISE = (
    "the driver had no license and paid a fine", "you need a license to fish here", "the license plate was covered with mud", "see the license for details",
    "a software license can be expensive", "he asked for permission to leave", "the copyright office opens at nine", "she published version 3 of the report",
    "the public library is free of charge", "use of the software is described in the following chapter", "the university of california at berkeley", "poetic license was taken",
    "the foundation published general terms", "commons and public domain are old words", "conditions are met and the work is permitted", "all rights and duties of the tenants",
)
#: Statements that notices of other families hold too, and the bigrams of a paragraph that tell such a notice.
SHARED = {"either version 3 of the License, or (at your option) any later version": ("gnu lesser", "gnu affero")}
#: Words of which two together tell nothing.
PLAIN = frozenset("a all an and any are as at be by for from had has he in is it its may no not of on or see she that the this to was were with you".split())
#: What stands between paragraphs.
BLANK = r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"
#: Share of a statement's bigrams that has to be in the paragraph.
CONFIRM = 0.8
#: Share of named examples, of those kept apart, that have to be right, and the probabilities tried for it.
PRECISION, LEVELS = 0.98, (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
SEED, VARIANTS, STEPS, RATE, PENALTY = 5, 14, 200, 4.0, 2e-4


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def pairs(ws: list[str]) -> list[str]:
    """The distinct bigrams, but for those of two plain words."""
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False) if not (a in PLAIN and b in PLAIN)))


def grams(text: str) -> list[str]:
    return pairs(words(text))


@dataclass(frozen=True)
class Model:
    classes: list[str]
    vocabulary: list[str]
    weights: np.ndarray  # vocabulary x classes
    bias: np.ndarray
    temperature: float
    least: float

    def probabilities(self, text: str) -> np.ndarray:
        at = {g: i for i, g in enumerate(self.vocabulary)}
        z = (self.bias + sum((self.weights[at[g]] for g in grams(text) if g in at), np.zeros(len(self.bias)))) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _filler(rng: np.random.Generator, n: int) -> list[str]:
    """Invented words: context that tells nothing."""
    syllables = ["ba", "co", "di", "fu", "ge", "lo", "mi", "na", "pe", "ru", "sa", "to", "the", "of", "and", "in", "is"]
    return ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)]


def _examples(rng: np.random.Generator, n: int) -> list[tuple[str, str]]:
    """Variations: some context on either side, at times a word lost; for the unknown class also parts and mixtures of statements."""
    out = []
    every = [words(t) for ts in TEMPLATES.values() for t in ts]
    for family, statements in [*TEMPLATES.items(), (UNKNOWN, OTHERWISE)]:
        for statement in statements:
            for k in range(n):
                ws = words(statement)
                if k % 4 == 3 and len(ws) > 6:
                    del ws[rng.integers(len(ws))]
                before, after = (0, 0) if k == 0 else rng.integers(0, 30, 2)
                out.append((" ".join([*_filler(rng, before), *ws, *_filler(rng, after)]), family))
    for ws in every:
        for _ in range(n // 2):
            size = int(rng.integers(1, max(2, len(ws) // 3 + 1)))
            at = int(rng.integers(0, len(ws) - size + 1))
            out.append((" ".join([*_filler(rng, 5), *ws[at : at + size], *_filler(rng, 8)]), UNKNOWN))
            out.append((" ".join(rng.permutation(ws)), UNKNOWN))
    return out


def calibrated(probability: np.ndarray, right: np.ndarray) -> float:
    """The least probability at which ``PRECISION`` of the named examples are right; an error where there is none."""
    for t in LEVELS:
        if (probability >= t).any() and right[probability >= t].mean() >= PRECISION:
            return t
    raise ValueError(f"at no level are {PRECISION:.0%} of the named examples right")


@cache
def train(seed: int = SEED) -> Model:
    """Fits weights by proximal gradient descent, then temperature and least probability on variations kept apart.  Once a process."""
    rng = np.random.Generator(np.random.PCG64(seed))
    fit, apart = _examples(rng, VARIANTS), _examples(rng, 6)
    classes = sorted(TEMPLATES) + [UNKNOWN]
    vocabulary = sorted({g for ts in [*TEMPLATES.values(), OTHERWISE] for t in ts for g in grams(t)})
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(examples: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.zeros((len(examples), len(vocabulary))), np.zeros(len(examples), dtype=int)
        for i, (text, family) in enumerate(examples):
            x[i, [at[g] for g in grams(text) if g in at]] = 1
            y[i] = classes.index(family)
        return x, y

    x, y = matrix(fit)
    each = 1 / np.bincount(y, minlength=len(classes))[y] / len(classes)
    w, b, target = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes)), np.eye(len(classes))[y]
    for _ in range(STEPS):
        z = x @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = (e / e.sum(axis=1, keepdims=True) - target) * each[:, None]
        w -= RATE * (x.T @ d)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * PENALTY, 0)  # the penalty on absolute values leaves few weights
        b -= RATE * d.sum(axis=0)
    x, y = matrix(apart)
    z, best = x @ w + b, (np.inf, 1.0)
    for temperature in (0.25, 0.5, 0.7, 1.0, 1.4, 2.0):
        s = z / temperature
        s -= s.max(axis=1, keepdims=True)
        best = min(best, (float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y])), temperature))
    s = np.exp(z / best[1] - (z / best[1]).max(axis=1, keepdims=True))
    p = s / s.sum(axis=1, keepdims=True)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    named = p.argmax(axis=1) != classes.index(UNKNOWN)
    least = calibrated(top[named], right[named])
    return Model(classes, vocabulary, w, b, best[1], least)


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """``_id`` and ``found``: an array of (paragraph, family, probability, confirmed, sure), one for each paragraph with a
    bigram of the vocabulary and for each such line of a paragraph of several lines.

    Paragraphs stand between blank lines and are numbered from zero.  ``family`` is the most probable, of equal ones the
    first by name; ``sure`` holds all confirmed families with their probabilities.  The most probable one is predicted at
    ``least``, and confirmed by ``CONFIRM`` of a statement; any other, since a line may name two licences, is predicted where
    it has that share against the unknown class, and confirmed by a whole statement.  What is not predicted is never confirmed.
    """
    model = model or train()
    live = [i for i in range(len(model.vocabulary)) if model.weights[i].any()]
    weights = F.map_from_arrays(_array([model.vocabulary[i] for i in live]), F.array(*[_array(model.weights[i].tolist()) for i in live]))
    unit = "array<struct<at:int,p:string,two:array<string>,near:array<string>>>"

    def held(units: Column) -> Column:
        """(at, p, near) with the known bigrams ``two``, where there are any; a paragraph is its own ``near``."""
        ws = lambda p: F.split(F.regexp_replace(F.lower(p), "^[^a-z0-9]+", ""), "[^a-z0-9]+")
        two = lambda s: F.array_distinct(F.filter(let(ws(s["p"]), lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))), lambda g: g.isin(*model.vocabulary)))
        known = F.transform(units, lambda s: F.struct(s["at"].alias("at"), s["p"].alias("p"), two(s).alias("two"), s["near"].alias("near")))
        return F.transform(F.filter(known, lambda s: F.size(s["two"]) > 0), lambda s: F.struct(s["at"].alias("at"), s["p"].alias("p"), s["two"].alias("two"), F.coalesce(s["near"], s["two"]).alias("near")))

    rows = docs.select(F.col(id_col).alias("_id"), F.transform(F.split(F.coalesce(F.col(text), F.lit("")), BLANK), lambda p, i: F.struct(i.alias("at"), p.alias("p"), F.lit(None).cast("array<string>").alias("near"))).alias("_parts"))
    rows = rows.select("_id", held(F.col("_parts")).cast(unit).alias("_whole"))
    lines = F.flatten(F.transform(F.filter("_whole", lambda s: s["p"].contains("\n")), lambda s: F.transform(F.split(s["p"], "\n"), lambda p: F.struct(s["at"].alias("at"), p.alias("p"), s["two"].alias("near")))))
    rows = rows.withColumn("_held", F.concat("_whole", F.when(F.size("_whole") > 0, held(lines)).otherwise(F.array()).cast(unit)))
    sums = F.transform("_held", lambda s: F.aggregate(s["two"], _array(model.bias.tolist()), lambda acc, g: F.coalesce(F.zip_with(acc, F.try_element_at(weights, g), lambda a, b: a + b), acc)))
    rows = rows.withColumn("_z", F.transform(sums, lambda z: F.transform(z, lambda x: x / model.temperature)))
    rows = rows.withColumn("_top", F.transform("_z", lambda z: F.array_max(z)))
    rows = rows.withColumn("_e", F.zip_with("_z", "_top", lambda z, top: F.transform(z, lambda x: F.exp(x - top))))
    rows = rows.withColumn("_sum", F.transform("_e", lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)))
    rows = rows.withColumn("_best", F.zip_with("_e", "_sum", lambda e, n: F.struct(F.element_at(_array(model.classes), F.array_position(e, F.lit(1.0)).cast("int")).alias("family"), (1.0 / n).alias("probability"))))
    none = F.array().cast("array<string>")
    statements = F.array(*[F.struct(F.lit(f).alias("family"), _array(grams(t)).alias("two"), (_array(SHARED[t]) if t in SHARED else none).alias("unless")) for f, ts in TEMPLATES.items() for t in ts])

    def verdict(z: Column) -> Column:
        named = (z["_best"]["family"] != UNKNOWN) & (z["_best"]["probability"] >= model.least)
        top = lambda x: named & (x["family"] == z["_best"]["family"])
        odds = lambda f: F.element_at(z["_e"], F.array_position(_array(model.classes), f).cast("int"))
        predicted = lambda x: odds(x["family"]) >= model.least * (odds(x["family"]) + odds(F.lit(UNKNOWN)))
        held = lambda x: F.size(F.array_intersect(x["two"], z["_held"]["two"]))
        holds = lambda x: (top(x) & (held(x) >= CONFIRM * F.size(x["two"]))) | (predicted(x) & (held(x) == F.size(x["two"])))
        mine = F.filter(statements, lambda x: holds(x) & ~F.arrays_overlap(x["unless"], z["_held"]["near"]))
        share = lambda f: F.element_at(z["_e"], F.array_position(_array(model.classes), f).cast("int")) / z["_sum"]
        sure = F.transform(F.array_distinct(F.transform(mine, lambda x: x["family"])), lambda f: F.struct(share(f).alias("p"), f.alias("f")))
        family = F.when(named, z["_best"]["family"]).otherwise(UNKNOWN)
        return let(sure, lambda sure: F.struct(z["_held"]["at"].alias("paragraph"), family.alias("family"), z["_best"]["probability"].alias("probability"), (F.size(sure) > 0).alias("confirmed"), sure.alias("sure")))

    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in ("_held", "_e", "_sum", "_best")])
    return rows.select("_id", F.transform(zipped, verdict).alias("found"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """One row a document: ``id_col, family, families, probability, n_paragraphs, n_confirmed, where``.

    ``families`` are those of confirmed paragraphs, sorted; ``family`` is the most probable of them, of equally probable
    ones the last by name; it is ``unknown`` if no paragraph is confirmed, and ``none`` if no paragraph holds a bigram of
    the vocabulary.  ``n_paragraphs`` counts those that hold one; ``where`` are the confirmed paragraphs' numbers.  Null
    and empty texts have none; a very long text is cut into its paragraphs inside its row.  Repeated rows come out repeated; other columns are not read; an empty table gives an empty
    result.
    """
    found = paragraphs(docs, id_col, text, model)
    rows = found.withColumn("_sure", F.filter("found", lambda x: x["confirmed"]))
    all_ = F.flatten(F.transform("_sure", lambda x: x["sure"]))
    top = F.array_max(all_)
    places = lambda c: F.array_distinct(F.transform(c, lambda x: x["paragraph"]))
    return rows.select(
        F.col("_id").alias(id_col),
        F.when(F.size("_sure") > 0, top["f"]).when(F.size("found") > 0, F.lit(UNKNOWN)).otherwise(F.lit("none")).alias("family"),
        F.array_sort(F.array_distinct(F.transform(all_, lambda x: x["f"]))).alias("families"),
        top["p"].alias("probability"), F.size(places("found")).cast("long").alias("n_paragraphs"), F.size(places("_sure")).cast("long").alias("n_confirmed"),
        places("_sure").alias("where"),
    )
