"""Licence scan: a trained paragraph classifier, confirmed by templates.

A paragraph is a line of the text, or a window of a template's length in a block of lines that no line without
a word interrupts (hard-wrapped notices, several notices in a line). It has a bag of word 1- to 3-grams. Multinomial logistic regression, trained
here on variants of the templates against background paragraphs, gives each licence family's probability,
with a class for everything else; its temperature is calibrated on variants kept from training. The
features are the n-grams of the templates, all others have no weight, so the model is sparse and most
paragraphs need no score. A prediction counts if it is likely enough and a template of that family agrees.
"""

from __future__ import annotations

import bisect
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare
from .text_kernel import ALNUM, LOWER, chunks, joined, word_hashes, words

#: Notices by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This work is licensed under the GNU Affero General Public License, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC0": ("Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Proprietary": ("All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."),
}
OTHER = "other"
#: Longest n-gram, variants of each template, background paragraphs (the bound of the sample), steps of training.
GRAMS, VARIANTS, BACKGROUND, STEPS = 3, 24, 1_500, 200
#: Paragraphs of a document, and characters that they are looked for in, that background takes. The scan reads all.
PARAGRAPHS, EXTRACT = 5, 4_000
#: Least probability, and share of a template's shingles, that confirm a prediction.
LIKELY, AGREES = 0.5, 0.7


def grams(text_words: np.ndarray) -> list[np.ndarray]:
    return [joined(text_words, k) for k in range(1, GRAMS + 1)]


def hashed(text: str) -> np.ndarray:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)] if text else np.empty(0, np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    return word_hashes(data, starts, ends)


@dataclass
class Model:
    families: list[str]  # the last is OTHER
    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # features x families
    bias: np.ndarray
    templates: list[tuple[int, frozenset]]  # family, hashes of word pairs

    def probabilities(self, bags: np.ndarray) -> np.ndarray:
        z = bags @ self.weights + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _pairs(h: np.ndarray) -> frozenset:
    return frozenset(joined(h, 2).tolist() if len(h) > 1 else h.tolist())


def agreement(model: Model, family: int, h: np.ndarray) -> float:
    """The largest share of a template's word pairs that the paragraph has."""
    own = _pairs(h)
    return max((len(t & own) / len(t) for f, t in model.templates if f == family and t), default=0.0)


def _bag(features: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(features))
    for g in grams(h):
        if len(g):
            at = np.minimum(np.searchsorted(features, g), len(features) - 1)
            out[at[features[at] == g]] = 1.0
    return out


def train(background: list[str], seed: int = 7) -> Model:
    """From variants of the templates (words dropped, cut, within other words) and background paragraphs."""
    rng = random.Random(seed)
    families = [*sorted(TEMPLATES), OTHER]
    texts = [(families.index(f), t) for f in sorted(TEMPLATES) for t in TEMPLATES[f]]
    features = np.unique(np.concatenate([g for _, t in texts for g in grams(hashed(t))]))
    templates = [(f, _pairs(hashed(t))) for f, t in texts]
    model = Model(families, features, np.zeros((len(features), len(families))), np.zeros(len(families)), templates)
    clean = [p for p in background if p.strip() and max(agreement(model, f, hashed(p)) for f in range(len(families) - 1)) < 0.3] or ["a", "the"]
    filler = [w for p in clean for w in p.split()] or ["a"]
    rows: list[tuple[int, str]] = []
    for f, t in texts:
        own = t.split()
        for v in range(VARIANTS):
            w = [x for x in own if rng.random() > 0.1 * (v % 3)] or own
            around = [rng.choice(filler) for _ in range(rng.choice([0, 0, 5, 20]))]
            cut = rng.randrange(len(around) + 1)
            rows.append((f, " ".join(around[:cut] + w + around[cut:])))
        for _ in range(VARIANTS // 4):  # words of a template that say nothing
            rows.append((len(families) - 1, " ".join(rng.sample(own, max(1, len(own) // 3)) + [rng.choice(filler) for _ in range(6)])))
    rows += [(len(families) - 1, p) for p in clean]
    rng.shuffle(rows)
    x = np.array([_bag(features, hashed(t)) for _, t in rows], np.float32)
    y = np.array([f for f, _ in rows])
    kept = np.arange(len(rows)) % 4 == 0  # for the calibration
    a, b = x[~kept], np.eye(len(families), dtype=np.float32)[y[~kept]]
    w, c = np.zeros((x.shape[1], len(families)), np.float32), np.zeros(len(families), np.float32)
    speed_w, speed_c, rate = np.zeros_like(w), np.zeros_like(c), 2.0
    for _ in range(STEPS):
        z = a @ w + c
        z = np.exp(z - z.max(axis=1, keepdims=True))
        g = (z / z.sum(axis=1, keepdims=True) - b) / len(a)
        speed_w = 0.9 * speed_w - rate * (a.T @ g + 1e-4 * w)
        speed_c = 0.9 * speed_c - rate * g.sum(axis=0)
        w, c = w + speed_w, c + speed_c
    best = (np.inf, 1.0)
    z = x[kept] @ w + c
    for t in np.geomspace(0.25, 4, 33):
        s = z / t - (z / t).max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), y[kept]]).mean())
        best = min(best, (loss, float(t)))
    model.weights, model.bias = w.astype(float) / best[1], c.astype(float) / best[1]
    return model


_MASK = np.uint64((1 << 20) - 1)
_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[10] = False
#: Comment markers that are words, where a line begins with one; others have no letter or digit.
_MARKERS = np.sort(np.concatenate([hashed(w) for w in ("rem", "dnl", "c")]))

#: "not licensed", "is never distributed": what denies a notice, with at most one word between.
_DENIALS = np.sort(np.concatenate([hashed(w) for w in ("not", "never", "isn", "aren", "cannot", "neither")]))
_GRANTS = np.sort(np.concatenate([hashed(w) for w in ("licensed", "released", "distributed", "available", "covered", "governed", "published", "subject", "under")]))


def _denied(h: np.ndarray, a: int, b: int, least: int) -> bool:
    """Whether words a to b, or one of the two before them from word least on, say that no licence is given."""
    a = max(least, a - 2)
    deny = np.flatnonzero(np.isin(h[a:b], _DENIALS)) + a
    return bool(len(deny)) and bool(np.isin(h[np.minimum(np.concatenate([deny + 1, deny + 2]), b - 1)], _GRANTS).any())


class _Windows:
    """Finds the windows of a text's words that agree with templates, by template word pairs."""

    def __init__(self, model: Model):
        self.pairs = np.array(sorted(set().union(*(t for _, t in model.templates))), np.uint64)
        self.member = np.array([[x in t for _, t in model.templates] for x in self.pairs.tolist()], np.int64)
        self.sizes = self.member.sum(axis=0)
        self.families = [f for f, _ in model.templates]
        self.on = np.zeros(1 << 20, bool)
        self.on[(self.pairs & _MASK).astype(np.int64)] = True

    def of(self, h: np.ndarray, block: np.ndarray) -> Iterator[list[tuple[float, int, int, int]]]:
        """(agreement, family, first word, last word + 1) of the windows of each block that has some."""
        run = joined(h, 2)
        at = np.flatnonzero(self.on[(run & _MASK).astype(np.int64)])
        at = at[block[at] == block[at + 1]]
        ids = np.minimum(np.searchsorted(self.pairs, run[at]), len(self.pairs) - 1)
        same = self.pairs[ids] == run[at]
        at, ids = at[same], ids[same]
        cuts = np.flatnonzero(np.diff(block[at], prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=False):
            if b - a < AGREES * self.sizes.min():
                continue
            agree = self.member[np.unique(ids[a:b])].sum(axis=0) >= AGREES * self.sizes
            out = []
            for t in np.flatnonzero(agree).tolist():
                own = np.flatnonzero(self.member[ids[a:b], t]) + a
                size = int(self.sizes[t])
                out += [(n / size, self.families[t], x, y) for n, x, y in _best(ids[own].tolist(), at[own].tolist(), AGREES * size, size + size // 2 + 3)]
            if out:
                yield out


def _best(ids: list[int], at: list[int], need: float, size: int) -> list[tuple[int, int, int]]:
    """(distinct pairs, first word, last word + 1) of windows of at most size words, from left to right, each with the most pairs."""
    out, seen, best = [], {}, None
    left = right = 0
    while right < len(ids) or best:
        if best and (right == len(ids) or at[right] - best[1] > size):
            out.append(best[:3])
            left = right = best[3] + 1
            seen, best = {}, None
            continue
        seen[ids[right]] = seen.get(ids[right], 0) + 1
        while at[right] - at[left] > size or seen[ids[left]] > 1:
            seen[ids[left]] -= 1
            if not seen[ids[left]]:
                del seen[ids[left]]
            left += 1
        if len(seen) >= need and (best is None or len(seen) > best[0]):
            best = (len(seen), at[left], at[right] + 2, right)
        right += 1
    return out


def _chosen(model: Model, windows: list[tuple[float, int, int, int]], h: np.ndarray, block: np.ndarray) -> Iterator[tuple[float, int, int, int, float]]:
    """Windows that the classifier confirms and that share no word with one that agrees better, with the probability."""
    firsts: list[int] = []
    ends: list[int] = []
    for s, family, a, b in sorted(windows, key=lambda w: (-w[0], w[2] - w[3], w[2], w[1])):
        i = bisect.bisect_left(firsts, b)  # those before begin before the window's end
        if i and ends[i - 1] > a:
            continue
        p = model.probabilities(_bag(model.features, h[a:b])[None, :])[0]
        if int(p.argmax()) == family and p[family] >= LIKELY and not _denied(h, a, b, int(np.searchsorted(block, block[a]))):
            firsts.insert(i, a)
            ends.insert(i, b)
            yield s, family, a, b, float(p[family])


def findings(model: Model, column: pa.Array) -> Iterator[list[dict]]:
    """The confirmed paragraphs of each text: family, start and end (code points) of their lines, probability, agreement."""
    on = np.zeros(1 << 20, bool)
    on[(model.features & _MASK).astype(np.int64)] = True
    other = len(model.families) - 1
    templates = _Windows(model)
    for a, b, data, offsets in chunks(column):
        low = LOWER[data]
        starts, ends, first = words(low, offsets, ALNUM)
        h = word_hashes(low, starts, ends)
        lines, line_ends, _ = words(low, offsets, _NOT_BREAK)
        # three-word features only occur in notices, so paragraphs without one are left
        run = joined(h, GRAMS)
        at = np.flatnonzero(on[(run & _MASK).astype(np.int64)])
        if len(at):
            at = at[model.features[np.minimum(np.searchsorted(model.features, run[at]), len(model.features) - 1)] == run[at]]
        single = np.flatnonzero(on[(joined(h, 2) & _MASK).astype(np.int64)]) if len(h) > 1 else np.empty(0, np.int64)
        if len(single):
            two = joined(h, 2)[single]
            single = single[model.features[np.minimum(np.searchsorted(model.features, two), len(model.features) - 1)] == two]
        line = np.unique(np.searchsorted(lines, starts[np.concatenate([at, single])], side="right") - 1)
        alone: dict[tuple[int, int], tuple[float, float]] = {}  # (line, family)
        for i in line.tolist():
            x, y = int(lines[i]), int(line_ends[i])
            w0, w1 = np.searchsorted(starts, [x, y])
            own = h[w0:w1]
            p = model.probabilities(_bag(model.features, own)[None, :])[0]
            family = int(p.argmax())
            if family == other or p[family] < LIKELY or _denied(h, w0, w1, int(first[np.searchsorted(first, w0, side="right") - 1])) or (s := agreement(model, family, own)) < AGREES:
                continue
            alone[i, family] = (s, float(p[family]))
        found: dict[tuple[int, int, int], tuple[float, float]] = {}  # (first line, last line, family)
        if len(h) > 1:
            of = np.searchsorted(lines, starts, side="right") - 1
            kept = (np.diff(of, prepend=-1) == 0) | (_MARKERS[np.minimum(np.searchsorted(_MARKERS, h), len(_MARKERS) - 1)] != h)
            doc = np.searchsorted(offsets, lines, side="right") - 1
            apart = np.append(True, (lines[1:] != line_ends[:-1] + 1) | (doc[1:] != doc[:-1]))  # from the line before
            wordless = np.ones(len(lines), bool)
            wordless[of] = False
            apart[1:] |= wordless[:-1]
            block = np.cumsum(apart)[of]
            if not kept.all():
                h, of, block = h[kept], of[kept], block[kept]
            for windows in templates.of(h, block):
                for s, family, w0, w1, p in _chosen(model, windows, h, block):
                    i, j = int(of[w0]), int(of[w1 - 1])
                    key = (i, j, family)
                    found[key] = max(found.get(key, (0.0, 0.0)), (s, p))
        own = {(k, f) for i, j, f in found for k in range(i, j + 1)}
        for i, j, family in list(found):
            for k in range(i, j + 1):
                if (k, family) in alone:
                    found.pop((i, j, family), None)  # the line says it
                if i < j:  # a line by itself can be taken for another family than its block
                    for f in range(other):
                        if f != family and (k, f) not in own and (k, f) in alone and alone[k, f][0] < found.get((i, j, family), (0.0,))[0]:
                            del alone[k, f]
        found |= {(i, i, family): v for (i, family), v in alone.items()}
        out: list[list[dict]] = [[] for _ in range(b - a)]
        for (i, j, family), (s, p) in sorted(found.items()):
            x, y = int(lines[i]), int(line_ends[j])
            d = int(np.searchsorted(offsets, x, side="right")) - 1
            text = bytes(data[offsets[d] : y])
            begin = len(text[: x - int(offsets[d])].decode())
            out[d].append({"family": model.families[family], "start": begin, "end": begin + len(text[x - int(offsets[d]) :].decode()), "probability": p, "agreement": s})
        yield from out


def background(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """At most BACKGROUND paragraphs, the bounded sample to train on: the first PARAGRAPHS, from the first EXTRACT characters, of the documents whose ids hash lowest."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.substring(text_col, 1, EXTRACT).alias("t")).dropna()
    ids = [r.i for r in rows.select("i").distinct().orderBy(F.xxhash64("i"), "i").limit(BACKGROUND // PARAGRAPHS).collect()]  # ids only leave the tasks
    picked = rows.where(F.col("i").isin(ids)).groupBy("i").agg(F.min("t").alias("t")).orderBy(F.xxhash64("i"), "i").collect() if ids else []
    return [p for r in picked for p in r.t.split("\n")[:PARAGRAPHS]]


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, licences array<struct<family, start, end, probability, agreement>>.

    In text order, over the whole text, each with the lines that it lies on; lines with notices of several
    families give one for each. A notice that a text denies ("not licensed under ...") is none. Null and empty texts have none; repeated
    rows give as many rows; an empty table none; of families with one probability the first by name is
    taken. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast(model or train(background(docs, id_col, text_col)))  # as large as the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64()), ("agreement", pa.float64())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(findings(own.value, batch.column(1))), kind)], ["doc_id", "licences"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, licences array<struct<family:string,start:long,end:long,probability:double,agreement:double>>")
