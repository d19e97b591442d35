"""License scans: a trained paragraph classifier with a calibrated unknown class, confirmed by template comparison.

Training data are made from public notice templates: their sentences, whole and shortened, with words dropped and foreign
words put in (seeded, so every run learns the same), against passages of the corpus itself, from any place of a document,
that share hardly any word with the templates (a bounded sample by hash) and shuffled template words. A sparse multinomial logistic regression on
word 1- and 2-grams learns the families and `none`. Half of the made paragraphs calibrate: the threshold under which a
prediction is `unknown` is where the wrong ones of that half fall under FALSE_RATE. A prediction is confirmed when its
words share enough of their n-grams with a sentence of that family's templates, else it counts as unknown.

A paragraph is a run of lines that are not blank once comment marks are stripped, so notices wrapped at any width are
read whole. Its lines, its sentences, and its windows of a template's length that hold SHARED of that template's n-grams
are all scored; of confirmed ones that overlap, that of the larger template share counts, and the unknown ones that
overlap no confirmed one count once each. Only the n-grams of the model's vocabulary bear weight, so a paragraph without
half of any template costs one dictionary lookup for each of its words and the scores of its lines and sentences.

Cases: null, empty and blank texts have no paragraphs; ties between families go to the alphabetically first. Repeated rows
are scanned alike. A very long text is scanned whole, paragraph by paragraph. Without any corpus paragraphs the shuffled words are the only negatives. Extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_of

NEGATIVES = 4_000
FALSE_RATE = 0.005
SHARED = 0.5
NONE = "none"
#: Sentences of public licence notices.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Released under the BSD 3-Clause License.", "This software is available under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Text is available under the Creative Commons Attribution License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Non-commercial use only under CC BY-NC."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal, public domain dedication.", "This work is dedicated to the public domain."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without permission.", "This material may not be copied or distributed without the written permission of the publisher."],
}
WORD = re.compile(r"[^\W_]+(?:[.][0-9]+)*")
STOP = re.compile(r"[.!?][\"')\]]*(?:\s+|$)")
MARKS = " \t\r\f\v#*/;%>|<-"
MARK_WORD = re.compile(r"(?:rem|dnl)(?:\s+|$)", re.IGNORECASE)


def grams_of(w: list[str]) -> list[str]:
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def grams(text: str) -> list[str]:
    return grams_of(WORD.findall(text.lower()))


def paragraphs(text: str | None) -> Iterator[tuple[int, list[str]]]:
    """(number of the first line, lines without comment marks) of each run of lines that are not blank."""
    start, lines = 0, []
    for k, line in enumerate((text or "").split("\n")):
        bare = line.strip().strip(MARKS)
        if bare[:3].lower() in ("rem", "dnl"):
            bare = MARK_WORD.sub("", bare, count=1)
        if bare:
            if not lines:
                start = k
            lines.append(bare)
        elif lines:
            yield start, lines
            lines = []
    if lines:
        yield start, lines


@dataclass(frozen=True)
class Model:
    families: list[str]
    vocabulary: dict[str, int]
    #: A row of weights for each n-gram of the vocabulary, one column a family; the last row is for other words.
    weights: np.ndarray
    bias: np.ndarray
    threshold: float
    templates: dict[str, list[frozenset[str]]]
    #: Words of every template sentence.
    sentences: list[list[str]]

    @cached_property
    def holders(self) -> dict[str, list[int]]:
        """The sentences that hold an n-gram."""
        out: dict[str, list[int]] = {}
        for i, w in enumerate(self.sentences):
            for g in set(grams_of(w)):
                out.setdefault(g, []).append(i)
        return out

    @cached_property
    def sizes(self) -> list[int]:
        return [len(set(grams_of(w))) for w in self.sentences]

    def windows(self, words: list[str]) -> list[tuple[float, int, int]]:
        """(share, start, end) of the windows of a sentence's length, cut to its n-grams, that hold SHARED of them."""
        holders = self.holders
        at = [(i, i + 1, w) for i, w in enumerate(words) if w in holders]
        at += [(i, i + 2, g) for (i, _, a), (j, _, b) in zip(at, at[1:]) if j == i + 1 and (g := f"{a} {b}") in holders]
        present = Counter(t for g in {g for _, _, g in at} for t in holders[g])
        good = {t for t, n in present.items() if n >= SHARED * self.sizes[t]}
        if not good:
            return []
        at.sort(key=lambda x: (x[1], x[0]))
        hits: dict[int, list[tuple[int, int, str]]] = {t: [] for t in sorted(good)}
        for x in at:
            for t in holders[x[2]]:
                if t in good:
                    hits[t].append(x)
        out = set()
        for t, own in hits.items():
            length, size = len(self.sentences[t]), self.sizes[t]
            held: Counter[str] = Counter()
            distinct = left = 0
            for _, end, g in own:
                held[g] += 1
                distinct += held[g] == 1
                while own[left][0] < end - length:
                    held[own[left][2]] -= 1
                    distinct -= held[own[left][2]] == 0
                    left += 1
                if distinct >= SHARED * size:
                    out.add((distinct / size, own[left][0], end))
        return sorted(out, key=lambda x: (-x[0], x[1] - x[2], x[1]))

    def passages(self, lines: list[str]) -> list[tuple[int, str, float, float]]:
        """(line, family or unknown, probability, share of a template) of what a paragraph's lines hold, in order."""
        words: list[str] = []
        line_of: list[int] = []
        units: dict[tuple[int, int], None] = {}
        stops = [0]
        for k, line in enumerate(lines):
            begin = len(words)
            for i, piece in enumerate(STOP.split(line.lower())):
                if i and stops[-1] < len(words):
                    stops.append(len(words))
                words += WORD.findall(piece)
            units[begin, len(words)] = None
            line_of += [k] * (len(words) - begin)
        if self.holders.keys().isdisjoint(words):
            return []
        stops.append(len(words))
        units |= dict.fromkeys(zip(stops, stops[1:]))
        sure, doubtful = [], []
        for a, b in units:
            got = self.judge(words[a:b])
            if got:
                (doubtful if got[0] == "unknown" else sure).append((a, b, *got))
        # Ends of what is taken, by words: of two that overlap the larger share is first in the queue.
        taken = bytearray(len(words))
        out = []
        queue = [(-x[4], x[0] - x[1], x[0], x[1], x) for x in sure] + [(-share, a - b, a, b, None) for share, a, b in self.windows(words)]
        for _, _, a, b, x in sorted(queue, key=lambda q: q[:4]):
            if any(taken[a:b]):
                continue
            if x is None:
                got = self.judge(words[a:b])
                if not got:
                    continue
                x = (a, b, *got)
                if got[0] == "unknown":
                    doubtful.append(x)
                    continue
            taken[a:b] = b"\1" * (b - a)
            out.append(x)
        for x in sorted(doubtful, key=lambda x: (-x[4], x[0], x[1])):
            if not any(taken[x[0] : x[1]]):
                taken[x[0] : x[1]] = b"\1" * (x[1] - x[0])
                out.append(x)
        return [(line_of[a], *got) for a, _, *got in sorted(out, key=lambda x: x[:2])]

    def classify(self, text: str) -> tuple[str, float, float] | None:
        """(family or unknown, probability, share of a template), None where it looks like no licence."""
        return self.judge(WORD.findall(text.lower()))

    def judge(self, words: list[str]) -> tuple[str, float, float] | None:
        g = grams_of(words)
        at = [self.vocabulary[x] for x in g if x in self.vocabulary]
        if not at:
            return None
        value = self.bias + row(at, len(g), len(self.vocabulary)) @ self.weights
        p = np.exp(value - value.max())
        p /= p.sum()
        k = int(p.argmax())
        if self.families[k] == NONE:
            return None
        own = frozenset(g)
        shared = max((len(own & t) / len(own | t) for t in self.templates[self.families[k]]), default=0.0)
        inside = max((len(own & t) / len(t) for t in self.templates[self.families[k]]), default=0.0)
        sure = p[k] >= self.threshold and max(shared, inside) >= SHARED
        return (self.families[k] if sure else "unknown", float(p[k]), max(shared, inside))


def row(at: list[int], n: int, size: int) -> np.ndarray:
    out = np.zeros(size + 1)
    out[list(set(at))] = 1.0
    out[size] = 1 - len(at) / max(1, n)
    return out


def made(templates: dict[str, list[str]], foreign: list[str], seed: int) -> list[tuple[str, str]]:
    """(family, paragraph): templates with noise, and their shuffled words as none."""
    r = random.Random(seed)
    out = []
    pool = [w for t in foreign for w in t.split()] or ["lorem", "ipsum"]
    for family, sentences in sorted(templates.items()):
        for s in sentences:
            words = s.split()
            for i in range(30):
                kept = [w for w in words if i == 0 or r.random() > 0.06 * (i % 4)]
                kept = kept or words
                extra = [r.choice(pool) for _ in range(r.randrange(0, 1 + len(words) // 3) if i % 3 == 2 else 0)]
                cut = r.randrange(len(kept) + 1) if extra else 0
                out.append((family, " ".join(kept[:cut] + extra + kept[cut:]) if r.random() < 0.5 else " ".join(extra + kept)))
            for _ in range(6):
                out.append((NONE, " ".join(r.sample(words, max(1, len(words) // 3)) + [r.choice(pool) for _ in range(2 * len(words))])))
    return out


def train(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, negatives: int = NEGATIVES) -> Model:
    spark = docs.sparkSession
    vocabulary = {g: i for i, g in enumerate(sorted({g for s in templates.values() for t in s for g in grams(t)}))}
    count = docs.count()
    share = min(1.0, negatives / max(1, count))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    lines = F.filter(F.split(text_of(), "\n", -1), lambda x: F.trim(x) != "")
    # Up to three lines from any place of a document.
    place = (F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.size("lines"), F.lit(1))) + 1).cast("int")
    passage = F.array_join(F.slice("lines", place, 3), "\n")
    some = [r["passage"] for r in picked.select("doc_id", "text", lines.alias("lines")).where(F.size("lines") > 0).select(passage.alias("passage"), F.xxhash64("doc_id", "text").alias("h")).orderBy("h", "passage").limit(2 * negatives).collect()]
    known = {w for t in vocabulary for w in t.split()}
    words = lambda t: [w for x in t.lower().split("\n") for y in [x, *STOP.split(x)] if (w := WORD.findall(y))]
    foreign = [t for t in some if (every := words(t)) and all(sum(x in known for x in w) < 0.5 * len(w) for w in every)]
    families = [*sorted(templates), NONE]
    size = len(vocabulary)

    def rows(seed: int, negative: list[str]) -> list[tuple[str, str]]:
        return made(templates, foreign, seed) + [(NONE, t) for t in negative]

    learn, check = rows(1, foreign[::2]), rows(2, foreign[1::2])

    def vector(text: str):
        g = grams(text)
        x = row([vocabulary[t] for t in g if t in vocabulary], len(g), size)
        at = np.flatnonzero(x)
        return Vectors.sparse(size + 1, at.tolist(), x[at].tolist())

    data = spark.createDataFrame([(float(families.index(f)), vector(t)) for f, t in learn], ["label", "features"])
    fitted = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=0.0, maxIter=60).fit(data)
    weights = np.asarray(fitted.coefficientMatrix.toArray()).T
    sets = {f: [frozenset(grams(t)) for t in s] for f, s in templates.items()}
    model = Model(families, vocabulary, weights, np.asarray(fitted.interceptVector.toArray()), 0.0, sets, [WORD.findall(t.lower()) for _, s in sorted(templates.items()) for t in s])
    wrong = []
    for f, t in check:
        found = [p for _, family, p, _ in model.passages(t.split("\n")) if family not in (f, "unknown")]
        if found:
            wrong.append(max(found))
    wrong.sort(reverse=True)
    allowed = int(FALSE_RATE * len(check))
    threshold = max(0.5, wrong[allowed] if len(wrong) > allowed else 0.5)
    return Model(families, vocabulary, weights, model.bias, min(threshold, 0.99), sets, model.sentences)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, found array<struct<paragraph, family, probability, template_share>> for each row of docs.

    The paragraph of a finding is the number of the line on which it begins.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found_type = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("template_share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                counts, rows = [], []
                for text in part.column("text").to_pylist():
                    n, out = 0, []
                    for first, lines in paragraphs(text):
                        n += 1
                        out += [{"paragraph": first + k, "family": f, "probability": p, "template_share": x} for k, f, p, x in m.passages(lines)]
                    counts.append(n)
                    rows.append(out)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(rows, found_type)], ["doc_id", "n_paragraphs", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_paragraphs long, found array<struct<paragraph:int,family:string,probability:double,template_share:double>>")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    families = F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda x: x["family"]), lambda f: f != "unknown")))
    return found.select("doc_id", "n_paragraphs", F.array_join(families, ",").alias("licenses"), F.size(F.filter("found", lambda x: x["family"] == "unknown")).cast("long").alias("n_unknown"), "found")
