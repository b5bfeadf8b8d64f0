"""Licence scans by a trained paragraph classifier with template confirmation.

A paragraph is what lies between blank lines.  Its units are runs of at most ``UNIT`` words, half overlapping, of the whole paragraph, so that a wrapped
notice is judged as one, and of each of its lines, so that a notice of one line stands out among others.  A unit's features are hashed word one-, two-
and three-grams (letters folded, ASCII punctuation as white space), its sum scaled by the square root of their number; a softmax regression trained here
gives the probability of each licence family and of ``unknown``.  Training units are drawn from the templates below (spans, dropped and strange
words) and, as unknown, from a bounded sample of corpus text without template runs.  The probabilities are calibrated by a temperature on units that training
has not seen, of templates and of corpus text.  A unit
whose family has ``least`` probability is confirmed if a run of its words is in that family's templates: at least ``RUN`` words, and
at least ``COVER`` of the words from the first matched to the last.  Where runs of several families overlap, the templates decide:
the family stays that has the most words of that place.

Defined results: null or empty texts give no rows; repeated rows are each answered; an empty input gives an empty output (the classifier is then trained
on templates alone); extra columns are ignored.  All words of all texts are scored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .storage import frugal
from .words import Chunk, gram_hashes, word_hashes, word_chunks

UNIT, RUN, COVER, BITS = 24, 4, 0.6, 16
UNKNOWN = "unknown"

# Notices and characteristic sentences of public licences.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0", "Distributed under the Apache License, Version 2.0.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
    ],
    "gpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License version 3.0", "Released under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", "Released under the ISC License.", "SPDX-License-Identifier: ISC",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "Released under the zlib License.", "SPDX-License-Identifier: Zlib",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0",
    ],
    "artistic-2.0": ["You may redistribute and modify this software under the terms of the Artistic License 2.0.", "Licensed under the Artistic License, version 2.0.", "SPDX-License-Identifier: Artistic-2.0"],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License", "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal, public domain dedication.", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.", "Copyright, all rights reserved.", "This document is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited."],
}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalnum() and b != 10]] = 32


def folded(column: pa.Array) -> pa.Array:
    """The texts with letters folded and ASCII punctuation as blanks; byte positions stay."""
    from .words import text_bytes

    offsets, data = text_bytes(column)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(_FOLD[data].tobytes()))


def grams(hashes: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of the one-, two- and three-grams that start at each word."""
    return [(gram_hashes(hashes, n) >> np.uint64(64 - BITS)).astype(np.int64) for n in (1, 2, 3)]


def hashes_of(text: str) -> np.ndarray:
    """Word hashes of one text."""
    found = [word_hashes(c) for c in word_chunks(folded(pa.array([text])))]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LicenceModel:
    """Weights by feature and class, bias, temperature, and the sorted template three-grams of each family."""

    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    runs: list[np.ndarray]


def template_runs() -> list[np.ndarray]:
    return [np.unique(np.concatenate([gram_hashes(hashes_of(t), 3) for t in texts])) for texts in TEMPLATES.values()]


def matched_words(hashes: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which words lie in a three-gram that the templates have."""
    found = np.isin(gram_hashes(hashes, 3), runs)
    words = np.zeros(len(hashes), dtype=bool)
    for k in range(3):
        words[k : k + len(found)] |= found
    return words


def training_units(negatives: list[str], seed: int) -> tuple[list[np.ndarray], list[int]]:
    """Feature arrays and classes drawn from templates and corpus text."""
    rng = random.Random(seed)
    runs = template_runs()
    clean = [h for h in map(hashes_of, negatives) if len(h) and not any(matched_words(h, r).sum() >= RUN for r in runs)]
    strange = [t for t in (h for h in clean) if len(t)]
    units, classes = [], []
    for family, texts in enumerate(TEMPLATES.values()):
        for text in texts:
            words = hashes_of(text)
            for _ in range(max(30, 3 * len(words))):
                size = rng.randint(min(4, len(words)), min(UNIT, len(words)))
                lo = rng.randint(0, len(words) - size)
                span = [w for w in words[lo : lo + size] if rng.random() > 0.05]
                if strange and rng.random() < 0.5:
                    other = rng.choice(strange)
                    extra = list(other[: rng.randint(1, max(1, min(len(other), UNIT - len(span))))])
                    span = span + extra if rng.random() < 0.5 else extra + span
                units.append(np.array(span[:UNIT], dtype=np.uint64))
                classes.append(family)
    for h in clean:
        for lo in range(0, len(h), UNIT):
            units.append(h[lo : lo + UNIT])
            classes.append(len(TEMPLATES))
    pool = np.concatenate([h for t in TEMPLATES.values() for h in map(hashes_of, t)])
    for _ in range(len(units) // 6):  # single licence words among others are unknown
        words = [rng.choice(pool) if rng.random() < 0.3 or not strange else rng.choice(rng.choice(strange)) for _ in range(rng.randint(1, UNIT))]
        units.append(np.array(words, dtype=np.uint64))
        classes.append(len(TEMPLATES))
    features = [np.concatenate(grams(u)) for u in units]
    kept = [k for k, f in enumerate(features) if len(f)]
    return [features[k] for k in kept], [classes[k] for k in kept]


def train(negatives: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 3) -> LicenceModel:
    """Softmax regression by Adagrad on hashed n-grams, then a temperature on every tenth unit, which it has not seen."""
    features, classes = training_units(negatives, seed)
    rng, k = np.random.default_rng(seed), len(TEMPLATES) + 1
    weights, bias = np.zeros((1 << BITS, k)), np.zeros(k)
    seen, seen_bias = np.full((1 << BITS, 1), 1e-3), np.full(k, 1e-3)
    order = rng.permutation(len(features))
    held, used = order[::10], np.delete(order, np.s_[::10])
    for _ in range(epochs):
        for at in rng.permutation(used):
            f, scale = features[at], 1 / np.sqrt(len(features[at]))
            wrong = _softmax(weights[f].sum(axis=0) * scale + bias)
            wrong[classes[at]] -= 1
            seen[f] += (wrong * wrong).sum() * scale * scale
            weights[f] -= rate * scale * wrong / np.sqrt(seen[f])
            seen_bias += wrong * wrong
            bias -= rate * wrong / np.sqrt(seen_bias)
    logits = np.array([weights[features[i]].sum(axis=0) / np.sqrt(len(features[i])) + bias for i in held])
    truth = np.array([classes[i] for i in held])
    losses = {t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    return LicenceModel([*TEMPLATES, UNKNOWN], weights.astype(np.float32), bias, min(losses, key=losses.get), template_runs())


def negative_texts(docs: DataFrame, rows: int = 1200, chars: int = 400, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """A bounded hash-chosen sample of corpus text: at most ``rows`` rows, of each ``chars`` characters at a hash-chosen place."""
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("length(text) > 0")
    n = some.count()
    if not n:
        return []
    place = F.lit(1) + F.pmod(F.xxhash64("id", F.lit(5)), F.greatest(F.length("text") - chars + 1, F.lit(1)))
    drawn = some.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, 1.2 * rows / n) * (1 << 30)))
    return [r["part"] for r in drawn.select(F.xxhash64("id").alias("h"), "id", F.substring("text", place.cast("int"), F.lit(chars)).alias("part")).orderBy("h", "id", "part").limit(rows).collect()]


def fit(docs: DataFrame, **options) -> LicenceModel:
    return train(negative_texts(docs, **options))


def _cut(edge: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, last word + 1) of the units of each stretch of words between edges."""
    lows, highs = np.concatenate([[0], edge]), np.concatenate([edge, [n]])
    steps = np.maximum(1, -(-(highs - lows - UNIT) // (UNIT // 2)) + 1)
    low = np.repeat(lows, steps) + (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)) * (UNIT // 2)
    return low, np.minimum(low + UNIT, np.repeat(highs, steps))


def _units(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word + 1, text) of each unit, of paragraphs and of lines, in order."""
    breaks = np.flatnonzero(chunk.data == 10)
    line = np.searchsorted(breaks, chunk.starts)
    owner = np.searchsorted(chunk.first[1:], np.arange(len(line)), side="right")
    other, n = np.diff(owner) != 0, len(line)
    cuts = [_cut(np.flatnonzero((np.diff(line) >= least) | other) + 1, n) for least in (1, 2)]
    low, high = np.unique(np.concatenate([np.column_stack(c) for c in cuts]), axis=0).T
    return low, high, owner[low]


def _settled(spans: dict[tuple[int, int], list], hashes: np.ndarray, runs: list[np.ndarray]) -> dict[tuple[int, int], list]:
    """Of runs of several families that overlap in a text, the family whose templates have the most of all their words, over all that it matches there.
    A run of another family stays if more than half of it lies outside."""
    by_text: dict[int, list] = {}
    for (text, family), found in spans.items():
        by_text.setdefault(text, []).extend((run[0], run[1], family, run) for run in found)
    kept: dict[tuple[int, int], list] = {}
    for text, todo in by_text.items():
        todo.sort(key=lambda r: r[:3])
        while todo:
            begin, end, n = todo[0][0], todo[0][1], 1
            while n < len(todo) and todo[n][0] < end:
                end, n = max(end, todo[n][1]), n + 1
            group, todo = todo[:n], todo[n:]
            if len({r[2] for r in group}) > 1:
                matched = {f: np.flatnonzero(matched_words(hashes[begin:end], runs[f])) for f in {r[2] for r in group}}
                best = max(matched, key=lambda f: (len(matched[f]), max(r[3][2] for r in group if r[2] == f), -f))
                words = matched[best]
                lo, hi = begin + int(words[0]), begin + int(words[-1]) + 1
                won = [lo, hi, max(r[3][2] for r in group if r[2] == best), len(words) / (hi - lo)]
                kept.setdefault((text, best), []).append(won)
                rest = [r for r in group if r[2] != best and 2 * (min(r[1], hi) - max(r[0], lo)) < r[1] - r[0]]
                todo = sorted([*rest, *todo], key=lambda r: r[:3])
            else:
                for r in group:
                    kept.setdefault((text, r[2]), []).append(r[3])
    return kept


def scan_column(model: LicenceModel, column: pa.Array, least: float) -> list[tuple]:
    """(row, family, probability, similarity, start, end) of each licence run found; code points."""
    out, unknown = [], len(model.families) - 1
    for chunk in word_chunks(folded(column), limit=1 << 17):
        if not len(chunk.starts):
            continue
        hashes = word_hashes(chunk)
        parts = grams(hashes)
        low, high, owner = _units(chunk)
        logits = np.zeros((len(low), len(model.families)))
        size = np.zeros(len(low))
        for n, idx in enumerate(parts, 1):
            total = np.zeros((len(idx) + 1, len(model.families)))
            np.cumsum(model.weights[idx], axis=0, out=total[1:])
            hi = np.maximum(high - n + 1, low)
            hi = np.minimum(hi, len(idx))
            lo = np.minimum(low, hi)
            logits += total[hi] - total[lo]
            size += hi - lo
        sure = _softmax((logits / np.sqrt(np.maximum(size, 1))[:, None] + model.bias) / model.temperature)
        best = sure[:, :unknown].argmax(axis=1)
        spans: dict[tuple[int, int], list] = {}
        for u in np.flatnonzero(sure[np.arange(len(best)), best] >= least):
            words = np.flatnonzero(matched_words(hashes[low[u] : high[u]], model.runs[best[u]]))
            if len(words) < RUN or len(words) < COVER * (words[-1] - words[0] + 1):
                continue
            begin, end = low[u] + words[0], low[u] + words[-1] + 1
            found = spans.setdefault((int(owner[u]), int(best[u])), [])
            value = [int(begin), int(end), float(sure[u, best[u]]), len(words) / (words[-1] - words[0] + 1)]
            if found and begin <= found[-1][1] + RUN:
                found[-1][0] = min(found[-1][0], value[0])
                found[-1][1] = max(found[-1][1], value[1])
                found[-1][2:] = [max(found[-1][2], value[2]), max(found[-1][3], value[3])]
            else:
                found.append(value)
        if spans:
            points = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])
            for (text, family), found in sorted(_settled(spans, hashes, model.runs).items()):
                base = points[chunk.starts[chunk.first[text]]] if chunk.first[text] < len(chunk.starts) else 0
                lead = _lead(column, chunk.lo + text)
                for begin, end, probability, similarity in found:
                    out.append((chunk.lo + text, model.families[family], probability, similarity, int(points[chunk.starts[begin]] - base + lead), int(points[chunk.ends[end - 1]] - base + lead)))
    return out


def _lead(column: pa.Array, row: int) -> int:
    """Code points of a text before its first word."""
    text = column[row].as_py() or ""
    return next((k for k, c in enumerate(text) if ord(c) >= 128 or c.isalnum()), 0)


def scan(docs: DataFrame, model: LicenceModel, least: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, family, probability, similarity, start, end) of each confirmed licence run."""
    shown = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([shown.schema.fields[0], *T._parse_datatype_string("family string, probability double, similarity double, start long, end long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                rows, *columns = list(zip(*scan_column(model, part.column(1), least))) or [()] * 6
                kinds = [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=schema.names)

    return shown.mapInArrow(frugal(run), schema)
