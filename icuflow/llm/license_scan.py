"""Licence texts in documents: winnowed fingerprints find candidates, banded alignment measures them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.llm.text import ALNUM, add_columns, shingles, words

# Licence notices as they are commonly printed, by name.
TEMPLATES = {
    "agpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "bsd-warranty": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
        "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "lgpl-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "mit-line": "Released under the MIT License.",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "mit-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}

#: A template of up to so many words keeps all its pairs of words as fingerprints.
SHORT = 15


@dataclass
class Index:
    """Templates as word hashes, and inverted indexes of their fingerprints: one for long templates, one for short ones."""

    names: list[str]
    words: list[np.ndarray]
    parts: list[Part]


@dataclass
class Part:
    """Fingerprints of some templates by one gram and window: hash, template, place, in hash order."""

    gram: int
    window: int
    hashes: np.ndarray
    template: np.ndarray
    place: np.ndarray


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: the least hash of each window of grams, the last of equal ones; of fewer grams, the least."""
    n = len(grams)
    if n <= window:
        return np.array([n - 1 - int(grams[::-1].argmin())]) if n else np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(axis=1))


def build_index(templates: dict[str, str], gram: int = 3, window: int = 2) -> Index:
    """Long templates are winnowed by ``gram`` and ``window``; short ones keep all their pairs of words.

    Of a template of L words with e of them replaced or left out, or e words put between, the rest lies in at most e + 1
    runs. With e at most L / 5 one run has 4 words if L is above ``SHORT``, which the default winnowing is sure
    to meet, and 2 words (or all) if not. So every such copy has a seed.
    """
    names = sorted(templates)
    found = [p.hashes[a:b] for p in words(pa.array([templates[n] for n in names], pa.string()), ALNUM) for a, b in zip(p.offsets[:-1], p.offsets[1:], strict=True)]

    def part(gram: int, window: int, belongs: Callable[[int], bool]) -> Part:
        rows = []
        for t, h in enumerate(found):
            grams = shingles(h, gram) if belongs(len(h)) else h[:0]
            rows += [(grams[i], t, i) for i in winnow(grams, window)]
        rows.sort()
        return Part(gram, window, *(np.array([r[k] for r in rows], kind) for k, kind in enumerate((np.uint64, np.int64, np.int64))))

    return Index(names, found, [part(gram, window, lambda n: n > SHORT), part(1, 1, lambda n: n == 1), part(2, 1, lambda n: 1 < n <= SHORT)])


def align(text: np.ndarray, template: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, last + 1 matched word of the text) of the best local alignment in a band around a diagonal.

    Place i of the template may meet places i + diagonal - band to i + diagonal + band of the text. A match
    scores 2, a mismatch or gap -1. Row by row over the template; gaps within a row by a running maximum.
    """
    width = 2 * band + 1
    score, matched, begin = np.zeros(width, np.int64), np.zeros(width, np.int64), np.full(width, -1)
    best = (0, 0, 0, 0)
    columns = np.arange(width)
    for i in range(len(template)):
        at = i + diagonal - band + columns
        inside = (at >= 0) & (at < len(text))
        same = inside & (text[np.clip(at, 0, len(text) - 1)] == template[i])
        up_score = np.append(score[1:], 0) - 1
        stay = score + np.where(same, 2, -1)
        new = np.where(inside, np.maximum(stay, up_score), 0)
        from_up = up_score > stay
        hits = np.where(from_up, np.append(matched[1:], 0), matched + same)
        start = np.where(from_up, np.append(begin[1:], -1), np.where((begin < 0) & same, at, begin))
        reach = np.maximum.accumulate(new + columns)
        source = np.maximum.accumulate(np.where(new + columns == reach, columns, 0))
        across = reach - columns
        use = inside & (across > new)
        new, hits, start = np.where(use, across, new), np.where(use, hits[source], hits), np.where(use, start[source], start)
        dead = new <= 0
        score, matched, begin = np.where(dead, 0, new), np.where(dead, 0, hits), np.where(dead, -1, start)
        top = int(score.argmax())
        if score[top] > best[0]:
            best = int(score[top]), int(matched[top]), int(begin[top]), int(at[top]) + 1
    return best[1:]


def _common(text: np.ndarray, pattern: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many words, as often as the pattern has each at most, it shares with each range of the text."""
    total = np.zeros(len(first), np.int64)
    known, times = np.unique(pattern, return_counts=True)
    number = np.minimum(np.searchsorted(known, text), len(known) - 1)
    at = np.flatnonzero(known[number] == text)
    at = at[np.argsort(number[at], kind="stable")]
    edges = np.searchsorted(number[at], np.arange(len(known) + 1))
    for a, b, n in zip(edges[:-1].tolist(), edges[1:].tolist(), times.tolist(), strict=True):
        total += np.minimum(np.searchsorted(at[a:b], last) - np.searchsorted(at[a:b], first), n)
    return total


def seeds(hashes: np.ndarray, index: Index, band: int, least: float) -> list[tuple[int, int]]:
    """(template, diagonal) where a fingerprint meets and enough words of the template stand within the band around it."""
    out: set[tuple[int, int]] = set()
    for part in index.parts:
        if not len(part.hashes) or len(hashes) < min(part.gram, 2):
            continue
        grams = shingles(hashes, part.gram)
        picked = winnow(grams, part.window)
        low, high = np.searchsorted(part.hashes, grams[picked], "left"), np.searchsorted(part.hashes, grams[picked], "right")
        each = high - low
        at = np.repeat(low - np.cumsum(each) + each, each) + np.arange(each.sum())
        template, diagonal = part.template[at], np.repeat(picked, each) - part.place[at]
        for t in np.unique(template).tolist():
            pattern = index.words[t]
            d = np.unique(diagonal[template == t])
            out.update((t, x) for x in d[_common(hashes, pattern, d - band, d + len(pattern) + band) >= least * len(pattern)].tolist())
    return sorted(out)


def scan(hashes: np.ndarray, index: Index, band: int, least: float) -> list[tuple[str, float, int, int]]:
    """(licence, coverage, first word, last word + 1) for each passage of a text's words that covers a template enough."""
    out: list[tuple[str, float, int, int]] = []
    done: dict[int, int] = {}  # by template, the word behind its last passage
    for template, diagonal in seeds(hashes, index, band, least):
        pattern, behind = index.words[template], done.get(template, 0)
        if behind and diagonal + len(pattern) <= behind or behind >= len(hashes):
            continue
        matched, first, last = align(hashes[behind:], pattern, diagonal - behind, band)
        first, last = first + behind, last + behind
        if matched >= least * len(pattern):
            done[template] = last
            out.append((index.names[template], round(matched / len(pattern), 6), first, last))
    return sorted(set(out), key=lambda x: (x[2], x[3], x[0]))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, gram: int = 3, window: int = 2, band: int = 8, least: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: doc_id and found, an array of struct license, coverage, start, end.

    coverage is the share of the template's words that the alignment matches, at least ``least``; start and end
    are bytes of the UTF-8 text, end exclusive. Words are runs of ASCII letters, digits and characters beyond
    ASCII, A-Z lowered. Which copies are sure to be found: see ``build_index``. Null texts, empty ones and those
    without words have no spans. Every place of a template in a text is reported. Repeated rows give repeated
    rows, an empty table none. Other columns are not read. Only the index of the templates is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_index(TEMPLATES if templates is None else templates, gram, window))

    def run(texts: pa.Array) -> list:
        out: list[list] = []
        for part in words(texts, ALNUM):
            for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True):
                found = scan(part.hashes[a:b], shared.value, band, least) if b > a else []
                begin = part.text_starts[len(out) - part.first]
                out.append([{"license": n, "coverage": c, "start": int(part.starts[a + x] - begin), "end": int(part.ends[a + y - 1] - begin)} for n, c, x, y in found])
        return [out]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return add_columns(rows, "text", run, "found array<struct<license:string,coverage:double,start:bigint,end:bigint>>").drop("text")
