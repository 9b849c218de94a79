"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are lines of a text.  A multinomial logistic regression on word one- and two-grams
tells licence families from each other and from ordinary prose.  It is trained on the
templates below, varied by dropping and framing words, and on a bounded sample of the corpus'
own paragraphs.  Its temperature and the probability from which a family is named are set on
held-out variations, so that what is unlike every family stays unknown.  A named family counts
once enough of one of its templates' word pairs stand in the paragraph.

Scoring looks at each paragraph alone, so nothing is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices and telling sentences of licence families.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "Copyright, all rights reserved, confidential and proprietary."],
}
FAMILIES = ["unknown", *TEMPLATES]
#: Ordinary lines taken from the corpus for the fit at most, those with the smallest hash.
MAX_PROSE = 4000
#: Lengths of the lines among which those are taken: a bound on what the driver gets.
LEARNT_CHARS = (20, 4000)
VARIATIONS, SEED = 40, 5
#: Share of a template's word pairs that confirms a prediction.
CONFIRM_SHARE = 0.6
_WORD = re.compile(r"\w+")


def grams(text: str) -> list[str]:
    """Lower-case words and pairs of neighbouring words."""
    w = _WORD.findall(text.lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def pairs(text: str) -> set[str]:
    return {g for g in grams(text) if " " in g}


#: Grams of templates; a paragraph without two of their pairs is unknown whatever else it holds.
VOCABULARY = {g: i for i, g in enumerate(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(t)}))}
PAIRS = {f: [pairs(t) for t in ts] for f, ts in TEMPLATES.items()}
WORDS = {w for w in VOCABULARY if " " not in w}


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    row, col = [], []
    for i, t in enumerate(texts):
        own = {VOCABULARY[g] for g in grams(t) if g in VOCABULARY}
        row += [i] * len(own)
        col += own
    return np.array(row, np.int64), np.array(col, np.int64)


def _logits(weights: np.ndarray, bias: np.ndarray, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
    out = np.tile(bias, (n, 1))
    np.add.at(out, row, weights[col])
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _variations(rng: np.random.Generator, prose: list[list[str]]) -> tuple[list[str], list[int]]:
    """Templates with words dropped, cut and framed by prose, with their family numbers."""
    texts, labels = [], []
    for k, f in enumerate(FAMILIES[1:], 1):
        for t in TEMPLATES[f]:
            w = t.split()
            for v in range(VARIATIONS):
                own = [x for x in w if v == 0 or len(w) < 8 or rng.random() > 0.06]
                if prose and v % 2:
                    p = prose[int(rng.integers(0, len(prose)))]
                    cut = int(rng.integers(0, len(p) + 1))
                    own = [*p[max(0, cut - 8) : cut], *own, *p[cut : cut + 8]]
                texts.append(" ".join(own))
                labels.append(k)
    return texts, labels


class Classifier:
    """Weights, temperature and the probability from which a family is named."""

    def __init__(self, prose: list[str], rounds: int = 300):
        rng = np.random.default_rng(SEED)
        split = [p.split() for p in prose]
        # prose that holds most of a template's pairs is no example of prose
        plain = [" ".join(p) for p in split if not any(len(t & pairs(" ".join(p))) >= CONFIRM_SHARE * len(t) for ts in PAIRS.values() for t in ts)]
        mixed = [" ".join(rng.permutation(list(WORDS))[: int(rng.integers(1, 6))]) for _ in range(400)]
        texts, labels = _variations(rng, split)
        texts, y = texts + plain + mixed, np.array(labels + [0] * (len(plain) + len(mixed)))
        held = rng.random(len(y)) < 0.25
        row, col = _features(texts)
        n, k, m = len(y), len(FAMILIES), len(VOCABULARY)
        weight = 1 / np.maximum(1, np.bincount(y, minlength=k))[y] * ~held
        weight /= weight.sum()
        self.w, self.b = np.zeros((m, k)), np.zeros(k)
        goal, sw, sb = np.eye(k)[y], np.full((m, k), 1e-8), np.full(k, 1e-8)
        for _ in range(rounds):
            g = (_softmax(_logits(self.w, self.b, row, col, n)) - goal) * weight[:, None]
            gw = np.zeros((m, k))
            np.add.at(gw, col, g[row])
            gw += 1e-4 * self.w / m
            gb = g.sum(axis=0)
            sw, sb = sw + gw * gw, sb + gb * gb
            self.w -= 0.3 * gw / np.sqrt(sw)
            self.b -= 0.3 * gb / np.sqrt(sb)
        z = _logits(self.w, self.b, row, col, n)[held]
        own = y[held]
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(own)), own], 1e-12)).mean()
        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss) if len(own) else 1.0
        p = _softmax(z / self.temperature)
        wrong = (p.argmax(axis=1) != own) & (p.argmax(axis=1) > 0)
        self.least = float(min(0.9, max(0.5, p.max(axis=1)[wrong].max(initial=0))))

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(family or unknown, probability, share of the best template found) of each paragraph."""
        if not texts:
            return []
        row, col = _features(texts)
        p = _softmax(_logits(self.w, self.b, row, col, len(texts)) / self.temperature)
        out = []
        for t, q in zip(texts, p, strict=True):
            k = int(q.argmax())
            if k == 0 or q[k] < self.least:
                out.append(("unknown", float(q[0] if k == 0 else q[k]), 0.0))
                continue
            have = pairs(t)
            out.append((FAMILIES[k], float(q[k]), max(len(x & have) / len(x) for x in PAIRS[FAMILIES[k]])))
        return out


def train(docs: DataFrame, text: str = "text", max_prose: int = MAX_PROSE) -> Classifier:
    """Fit on the templates and at most ``max_prose`` of the corpus' lines, those with the smallest hashes.

    A first pass counts the lines; the second keeps distinct ones whose hash lies below the
    share that is wanted, so the driver gets little more than it uses whatever the table's size.
    """
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("line")).where(F.length("line").between(*LEARNT_CHARS))
    n = lines.count()
    steps = 1 << 40
    share = min(steps, 2 * max_prose * steps // max(1, n))
    some = lines.where(F.pmod(F.xxhash64("line"), F.lit(steps)) < share).distinct()
    rows = some.orderBy(F.xxhash64("line"), "line").limit(max_prose).collect()
    return Classifier(sorted({r.line for r in rows}))


def _units(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, int, str]]]:
    """Lines (number, line, template pairs) with at least two template pairs, and runs (first, last line, text) of lines that hold some."""
    lines, runs, run, total = [], [], [], 0

    def close() -> None:
        nonlocal run, total
        if len(run) > 1 and total >= 2:
            runs.append((run[0][0], run[-1][0], " ".join(x for _, x in run)))
        run, total = [], 0

    for i, line in enumerate(text.split("\n")):
        words = _WORD.findall(line.lower())
        n = sum(f"{a} {b}" in VOCABULARY for a, b in zip(words, words[1:], strict=False)) if not WORDS.isdisjoint(words) else 0
        if n >= 2:
            lines.append((i, line, n))
        # a wrapped notice may end in a line of one word
        if n or (run and words and len(words) < 3 and WORDS.issuperset(words)):
            run.append((i, line))
            total += n
        else:
            close()
    close()
    return lines, runs


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Classifier | None = None) -> DataFrame:
    """``(doc_id, paragraph, family, probability, template_share, confirmed)`` of paragraphs classed as a licence.

    A paragraph is a line, or a run of neighbouring lines that a wrapped notice fills; ``paragraph``
    is the number of its first line in the whole text, from 0.  A line without two of the templates'
    word pairs is unknown by definition.  A run counts where the template confirms it and none of
    its lines alone is confirmed as the same family.  Paragraphs of unknown class give no row.
    Null and empty texts give none; repeated rows and null ids each give their own; an empty
    table gives no rows; other columns are ignored.  The id is cast to bigint.
    """
    model = model or train(docs, text)

    def find(frames):
        for f in frames:
            keys, lines, spans, runs = [], [], [], []
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                own, joined = _units(t or "")
                spans += [(d, len(keys), len(keys) + len(own), a, b) for a, b, _ in joined]
                runs += [x for _, _, x in joined]
                keys += [(d, i) for i, _, _ in own]
                lines += [x for _, x, _ in own]
            found = model.predict(lines)
            rows = [(d, i, *r) for (d, i), r in zip(keys, found, strict=True) if r[0] != "unknown"]
            for (d, lo, hi, a, b), r in zip(spans, model.predict(runs), strict=True):
                alone = any(a <= keys[k][1] <= b and found[k][0] == r[0] and found[k][2] >= CONFIRM_SHARE for k in range(lo, hi))
                if r[0] != "unknown" and r[2] >= CONFIRM_SHARE and not alone:
                    rows.append((d, a, *r))
            out = pd.DataFrame(rows, columns=["doc_id", "paragraph", "family", "probability", "template_share"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = base.mapInPandas(find, "doc_id bigint, paragraph int, family string, probability double, template_share double")
    return out.withColumn("confirmed", F.col("template_share") >= CONFIRM_SHARE)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence notices in all documents: family, probability and the share of the best template, one row a paragraph."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
