"""Licence notices in documents, by a trained paragraph classifier.

Paragraphs (lines) are classified by a multinomial logistic regression over their words and word pairs:
one class for each licence family and one for everything else. It is trained here, on variations of
the notices in ``TEMPLATES`` and, for the unknown class, on lines of a bounded sample of the documents
(``UNKNOWN_DOCUMENTS``, drawn by a hash, ``UNKNOWN_LINES`` lines of each) that look like no template. A part kept
out of the training sets the temperature, so probabilities are calibrated and a paragraph with few known
words falls to the unknown class. A prediction is confirmed when the paragraph resembles a template of its
family: the share of the template's word pairs it holds, and of its own that the template holds,
taken by their harmonic mean, is ``CONFIRM`` or more, or it holds nearly all of a template
(``CONTAINS``).

Every paragraph of every document is classified, whole. Null text has none. Null and repeated ids keep their
rows; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import byte_texts, portions
from pagewright.llm.sampling import drawn

UNKNOWN_DOCUMENTS, UNKNOWN_LINES, UNKNOWN_CHARS = 400, 8, 20_000
VARIATIONS = 40
CONFIRM, CONTAINS = 0.6, 0.9
UNKNOWN = "unknown"

# Customary notices of each family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "Creative Commons": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 3.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License, version 2.0.",
    ],
    "Public domain": [
        "This work is dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0).",
    ],
    "All rights reserved": ["All rights reserved.", "Copyright 2024 Example Inc. All rights reserved."],
}
# Words that a notice may stand among.
AROUND = "note see copyright by the this file document text content all c 2019 2021 2023 2024 author authors and contributors inc page".split()

_OTHER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256))


def paragraphs(text: bytes) -> list[list[bytes]]:
    """The words of each line: letters and digits, A to Z in lower case."""
    return [line.split() for line in text.translate(_OTHER).split(b"\n")]


def _words(text: str) -> list[bytes]:
    return [w for line in paragraphs(text.encode()) for w in line]


class LicenceModel:
    """Word and word-pair weights for each class; classes are the families, then the unknown one."""

    def __init__(self, families: dict[str, list[str]] = TEMPLATES):
        self.classes = [*families, UNKNOWN]
        self.templates = [(k, t, Counter(pairwise([b"", *_words(t), b""]))) for k, f in enumerate(families) for t in families[f]]
        known = sorted({w for t in families.values() for x in t for w in _words(x)})
        self.word = {w: i + 1 for i, w in enumerate(known)}  # 0: a word of no notice
        pairs = sorted({(self.word[a], self.word[b]) for t in families.values() for x in t for a, b in pairwise(_words(x))})
        self.codes = np.array([a * (len(known) + 1) + b for a, b in pairs], np.int64)
        self.first_pair = len(known) + 1
        self.weights = np.zeros((self.first_pair + len(pairs) + 1, len(self.classes)))  # the last row: bias
        self.temperature = 1.0

    def rows(self, lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, feature, value) of all features; values are scaled by the root of the line's length."""
        lengths = np.array([len(x) for x in lines], np.int64)
        get = self.word.get
        ids = np.fromiter((get(w, 0) for x in lines for w in x), np.int64, int(lengths.sum()))
        line = np.repeat(np.arange(len(lines)), lengths)
        value = 1 / np.sqrt(np.maximum(lengths, 1))
        some = np.flatnonzero(ids)
        both = some[:-1][(np.diff(some) == 1) & (line[some[1:]] == line[some[:-1]])] if len(some) > 1 else some[:0]
        code = ids[both] * self.first_pair + ids[both + 1] if len(both) else both
        at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        hit = self.codes[at] == code if len(code) else np.zeros(0, bool)
        lines_of = np.concatenate([line[some], line[both[hit]]])
        return lines_of, np.concatenate([ids[some], self.first_pair + at[hit]]), value[lines_of]

    def probabilities(self, lines: list[list[bytes]]) -> np.ndarray:
        line, feature, value = self.rows(lines)
        logits = np.tile(self.weights[-1], (len(lines), 1))
        for k in range(len(self.classes)):
            logits[:, k] += np.bincount(line, self.weights[feature, k] * value, len(lines))
        return _softmax(logits / self.temperature)

    def fit(self, lines: list[list[bytes]], y: np.ndarray, steps: int = 300) -> None:
        """Full-batch gradient steps with momentum; every fifth row sets the temperature."""
        out = np.arange(len(lines)) % 5 == 4
        x = np.zeros((len(lines), len(self.weights)), np.float32)
        line, feature, value = self.rows(lines)
        np.add.at(x, (line, feature), value)
        x[:, -1] = 1
        goal = np.eye(len(self.classes), dtype=np.float32)[y]
        share = np.bincount(y, minlength=len(self.classes)) / len(y)
        weight = (1 / np.maximum(share[y], 1e-9))[:, None].astype(np.float32) ** 0.5
        train, w = ~out, np.zeros_like(self.weights, np.float32)
        speed = np.zeros_like(w)
        for _ in range(steps):
            p = _softmax(x[train] @ w)
            slope = x[train].T @ (weight[train] * (p - goal[train])) / train.sum() + 1e-4 * w
            speed = 0.9 * speed - 1.0 * slope
            w += speed
        self.weights = w.astype(float)
        logits = x[out] @ w
        choices = np.geomspace(0.25, 4, 33)
        loss = [-np.log(np.maximum(_softmax(logits / t)[goal[out] > 0], 1e-9)).mean() for t in choices]
        if out.any():
            self.temperature = float(choices[int(np.argmin(loss))])

    def resemblance(self, words: list[bytes], k: int) -> tuple[float, str, bool]:
        """The most similar template of a class, and whether it confirms."""
        own = Counter(pairwise([b"", *words, b""]))
        best = (-1.0, "", False)
        for c, template, pairs in self.templates:
            if c == k:
                common = sum((own & pairs).values())
                alike = 2 * common / (sum(own.values()) + sum(pairs.values()))
                inner = sum(n for p, n in pairs.items() if b"" not in p)
                held = sum((own & Counter({p: n for p, n in pairs.items() if b"" not in p})).values()) / max(inner, 1)
                best = max(best, (alike, template, alike >= CONFIRM or (held >= CONTAINS and inner > 1)))
        return best


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def variations(template: str, n: int, rng: random.Random) -> list[list[bytes]]:
    """The template's words as they are, and with words lost, doubled or put around."""
    words = _words(template)
    found = [words]
    for _ in range(n - 1):
        some = [w for w in words if rng.random() > 0.08] or words
        before = [rng.choice(AROUND).encode() for _ in range(rng.choice([0, 0, 0, 1, 2, 4]))]
        after = [rng.choice(AROUND).encode() for _ in range(rng.choice([0, 0, 0, 1, 2, 4]))]
        if len(words) > 14 and rng.random() < 0.3:  # a notice broken over lines
            cut = rng.randrange(6, len(words) - 5)
            some = some[:cut] if rng.random() < 0.5 else some[cut - 3 :]
        found.append(before + some + after)
    return found


def train(documents: DataFrame, families: dict[str, list[str]] = TEMPLATES, seed: int = 1) -> LicenceModel:
    """A model from the templates and a bounded sample of the documents' lines."""
    model = LicenceModel(families)
    rng = random.Random(seed)
    lines: list[list[bytes]] = []
    y: list[int] = []
    for k, family in enumerate(families):
        for template in families[family]:
            made = variations(template, VARIATIONS, rng)
            lines += made
            y += [k] * len(made)
    other = len(families)
    texts = documents.select("doc_id", "text").where(f"length(text) BETWEEN 1 AND {UNKNOWN_CHARS}")
    for row in drawn(texts, UNKNOWN_DOCUMENTS, "licence", of=documents.count()).collect():
        found = [x for x in paragraphs(row.text.encode()) if x]
        for words in rng.sample(found, min(UNKNOWN_LINES, len(found))):
            if all(model.resemblance(words, k)[0] < 0.5 and not model.resemblance(words, k)[2] for k in range(other)):
                lines.append(words)
                y.append(other)
    # Lines of notice words in no order are no notice; they keep single words from deciding.
    everything = sorted(model.word)
    for _ in range(VARIATIONS * 10):
        lines.append([rng.choice(everything) for _ in range(rng.randrange(0, 25))])
        y.append(other)
    order = list(range(len(lines)))
    rng.shuffle(order)
    model.fit([lines[i] for i in order], np.array([y[i] for i in order]))
    return model


def scan(documents: DataFrame, model: LicenceModel | None = None, text: str = "text") -> DataFrame:
    """The paragraphs of ``documents`` (doc_id, text) that are predicted to be of a family: doc_id, paragraph (its
    line number from 0), family, probability, template, similarity and confirmed."""
    model = model or train(documents)
    other = len(model.classes) - 1

    def run(batches):
        for b in portions(batches, 500):
            lines, owner, number = [], [], []
            for doc, raw in enumerate(byte_texts(b.column(1))):
                for i, words in enumerate(paragraphs(raw)):
                    if words:
                        lines.append(words)
                        owner.append(doc)
                        number.append(i)
            chosen: list[tuple] = []
            if lines:
                p = model.probabilities(lines)
                best = p.argmax(1)
                for i in np.flatnonzero(best != other).tolist():
                    k = int(best[i])
                    alike, template, sure = model.resemblance(lines[i], k)
                    chosen.append((owner[i], number[i], model.classes[k], float(p[i, k]), template, alike, sure))
            cols = list(zip(*chosen)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds))],
                ["doc_id", "paragraph", "family", "probability", "template", "similarity", "confirmed"],
            )

    return documents.select(F.col("doc_id").cast("long"), text).mapInArrow(
        run, "doc_id long, paragraph long, family string, probability double, template string, similarity double, confirmed boolean"
    )
