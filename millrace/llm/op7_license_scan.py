"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Texts are runs of ASCII letters and digits, lowered. Of each template's runs of GRAM words, winnowing keeps the least hash of
every WINDOW neighbours (all, of a short template); an inverted index leads from a kept hash to its templates and places. All
runs of a document are looked up, so that any shared passage of GRAM + WINDOW - 1 words is found. Places where a template stands word
for word are matches; the other hits of one template on nearby diagonals make candidates, which are aligned with the template within a band
around them (match +2, else -1, best local score), piece by piece of a text and again on what is left beside a match, so that copies side by side
are all found. A match counts from COVERAGE of the template's words, and if the words that tell relatives apart (names, versions, conditions)
are those of the template. Of matches of one template that overlap the best stays; one that lies within a better one is dropped.

The index has the size of the template set, not of the corpus; documents are read once, where they lie.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .encoders import slices

GRAM, WINDOW, BAND, COVERAGE = 3, 4, 8, 0.75
_WORD = re.compile(rb"[a-z0-9]+")
OUT = "doc_id long, license string, n_matched int, coverage double, start long, end long"

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
#: The wording of public licenses and of their usual notices.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
    "MIT notice": "Released under the MIT License.",
    "MIT notice, licensed": "Licensed under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


#: Names that public licenses go by, and how a notice begins.
_NAMED = {
    "BSD": "BSD License", "Apache-2.0": "Apache License, Version 2.0", "ISC": "ISC License", "MPL-2.0": "Mozilla Public License, version 2.0",
    "GPL-2.0": "GNU General Public License, version 2", "GPL-3.0": "GNU General Public License, version 3",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1", "LGPL-3.0": "GNU Lesser General Public License, version 3", "AGPL-3.0": "GNU Affero General Public License, version 3",
    **{f"CC-{x}-4.0": f"CC {x} 4.0" for x in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")},
}
_BEGINS = {"licensed": "Licensed under", "released": "Released under", "work": "This work is licensed under"}


def _gnu(what: str, kind: str, version: str) -> str:
    """The usual notice of a GNU license."""
    return (
        TEMPLATES["GPL-3.0-or-later"].replace("This program is free", f"This {what} is free").replace("This program is distributed", f"This {what} is distributed")
        .replace("GNU General", f"GNU {kind}General").replace("version 3 of", f"version {version} of")
    )


TEMPLATES |= {
    "GPL-2.0-or-later": _gnu("program", "", "2"), "LGPL-2.1-or-later": _gnu("library", "Lesser ", "2.1"), "LGPL-3.0-or-later": _gnu("program", "Lesser ", "3"), "AGPL-3.0-or-later": _gnu("program", "Affero ", "3"),
}
_SAID = set(TEMPLATES.values())
TEMPLATES |= {f"{n} notice, {k}": t for n, name in _NAMED.items() for k, begin in _BEGINS.items() if (t := f"{begin} {'' if name[:2] == 'CC' else 'the '}{name}.") not in _SAID}

#: Words that tell licenses of one wording apart: names, conditions, and version numbers after such a word or `version`.
_MARKS = frozenset(b"mit bsd isc apache mozilla mpl lesser affero gpl lgpl agpl by nc nd sa attribution noncommercial noderivatives sharealike".split())
_BEFORE = _MARKS | {b"version", b"v", b"license", b"licenses", b"international"}
_NUMBERS = frozenset((b"1", b"2", b"3", b"4", b"5"))


def marks(words: list[bytes]) -> Counter:
    """The marks among words."""
    found: Counter = Counter()
    numbered = False  # the word before is a number that counts
    for before, w in zip([b"", *words], words, strict=False):
        numbered = w in _NUMBERS and (before in _BEFORE or numbered)
        if numbered or w in _MARKS and w != b"by" or w == b"by" and before == b"cc":
            found[w] += 1
    return found


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Places of the least hash in every `window` neighbours (the rightmost of equal ones); all, if there are few."""
    if len(hashes) < 2 * window:
        return list(range(len(hashes)))
    return sorted({max(range(k, k + window), key=lambda i: (-hashes[i], i)) for k in range(len(hashes) - window + 1)})


class _Codes(dict):
    def __missing__(self, key):
        return -1


@dataclass
class Index:
    """names, coded words of the templates, word codes, sorted gram keys, and for each key its (template, place) list."""

    names: list[str]
    texts: list[list[int]]
    codes: _Codes
    keys: np.ndarray
    places: list[list[tuple[int, int]]]
    marks: list[Counter]

    @classmethod
    def of(cls, templates: dict[str, str]) -> Index:
        codes, names, texts, where = _Codes(), sorted(templates), [], {}
        for n in names:
            texts.append([codes.setdefault(w, len(codes)) for w in words_of(templates[n])])
        size = len(codes) + 1
        for t, words in enumerate(texts):
            grams = [(words[i] * size + words[i + 1]) * size + words[i + 2] for i in range(len(words) - GRAM + 1)]
            for i in winnow([g * 0x9E3779B97F4A7C15 % 2**64 for g in grams]):
                where.setdefault(grams[i], []).append((t, i))
        keys = sorted(where)
        return cls(names, texts, codes, np.array(keys, dtype=np.int64), [where[k] for k in keys], [marks(words_of(templates[n])) for n in names])

    def hits(self, coded: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, place in it, place in the document) of each run of words that the index has."""
        if len(coded) < GRAM or not len(self.keys):
            return []
        size = len(self.codes) + 1
        a, b, c = coded[:-2], coded[1:-1], coded[2:]
        at = np.flatnonzero((a >= 0) & (b >= 0) & (c >= 0))
        if not len(at):
            return []
        g = (a[at] * size + b[at]) * size + c[at]
        k = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
        ok = self.keys[k] == g
        return [(t, i, d) for k, d in zip(k[ok].tolist(), at[ok].tolist(), strict=True) for t, i in self.places[k]]

    def scan(self, text: str) -> list[tuple[str, int, float, int, int]]:
        """(license, words matched, share of the template, first and end character) of each match, by place."""
        raw = text.encode("utf-8", "surrogatepass").lower()
        words = _WORD.findall(raw)
        coded = np.array(list(map(self.codes.__getitem__, words)), dtype=np.int64)
        hits = self.hits(coded)
        if not hits:
            return []
        by: dict[int, list[tuple[int, int]]] = {}
        for t, i, d in hits:
            by.setdefault(t, []).append((d, d - i))
        found, wholes, held = [], {}, np.zeros(len(coded), dtype=np.int64)
        for t, own in by.items():
            m = len(self.texts[t])
            wholes[t] = self.whole(t, own, coded)
            for a in wholes[t]:
                held[a : a + m - GRAM + 1] = np.maximum(held[a : a + m - GRAM + 1], m)
        for t, own in sorted(by.items()):
            m, whole = len(self.texts[t]), wholes[t]
            found += [(m, t, a, a + m) for a in whole]
            rest = [h for h in own if not _within(whole, h[0], m)] if whole else own
            found += [(n, t, a, e) for n, a, e in self.aligned(t, rest, coded, held, words) if not any(x < e and a < x + m for x in _around(whole, a, e, m))]
        best = [x for x in set(found) if self.marked(x, words)]
        kept = _best(sorted(best, key=lambda m: (-m[0], -m[0] / len(self.texts[m[1]]), m[1], m[2])))
        spans = [x.span() for x in _WORD.finditer(raw)]
        first = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)  # characters up to each byte
        return sorted(((self.names[t], n, n / len(self.texts[t]), int(first[spans[a][0]]) - 1, int(first[spans[b - 1][1] - 1])) for n, t, a, b in kept), key=lambda m: (m[3], m[0]))

    def whole(self, t: int, hits: list[tuple[int, int]], coded: np.ndarray) -> list[int]:
        """Where the template stands word for word, from left to right without overlap."""
        template = np.array(self.texts[t], dtype=np.int64)
        m, out = len(template), []
        starts = np.unique([s for _, s in hits])
        starts = starts[(starts >= 0) & (starts + m <= len(coded))]
        for s in starts[(coded[starts] == template[0]) & (coded[starts + m - 1] == template[-1])].tolist():
            if (not out or s >= out[-1] + m) and np.array_equal(coded[s : s + m], template):
                out.append(s)
        return out

    def aligned(self, t: int, hits: list[tuple[int, int]], coded: np.ndarray, held: np.ndarray, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(words matched, first, end) of matches that alignments find around hits (document word, diagonal).

        Hits go by diagonal into strips of BAND, and two neighbouring strips are looked at together, by pieces of as many words as two
        templates have, each of which begins a template later. A piece is aligned with all that a template around its hits can
        reach, and what lies before and after a match again. held: at each word the length of a template that stands there word for word; a piece all of
        whose hits such templates hold, none shorter than this one, has only matches that lie within theirs. Nor is a piece without the template's marks aligned.
        """
        strips: dict[int, list[tuple[int, int]]] = {}
        for h in hits:
            k = h[1] // BAND
            strips.setdefault(k, []).append(h)
            strips.setdefault(k - 1, []).append(h)
        m = len(self.texts[t])
        for _, own in sorted(strips.items()):
            own.sort()
            at = [d for d, _ in own]
            k = 0
            while k < len(own):
                part = own[k : bisect_left(at, at[k] + 2 * m)]
                begin, end = max(0, part[0][0] - m - 2 * BAND), min(len(coded), part[-1][0] + m + 2 * BAND)
                if any(held[d] < m for d, _ in part) and self.marks[t] <= marks(words[begin:end]):
                    yield from self._within(t, part, coded, begin, end)
                k = max(k + 1, bisect_left(at, at[k] + m))

    def _within(self, t: int, hits: list[tuple[int, int]], coded: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        todo = [(hits, begin, end)]
        while todo:
            part, begin, end = todo.pop()
            # A hit stands for at most GRAM + WINDOW - 1 words before the next one.
            reach = sum(min(b[0] - a[0], GRAM + WINDOW - 1 + BAND) for a, b in zip(part, part[1:], strict=False)) + GRAM + 2 * (WINDOW - 1) + BAND
            if not part or end - begin < COVERAGE * len(self.texts[t]) or reach < COVERAGE * len(self.texts[t]):
                continue
            n, a, e = align(self.texts[t], coded, min(g for _, g in part), max(g for _, g in part), begin, end)
            if n >= COVERAGE * len(self.texts[t]):
                yield n, a, e
                todo.append(([h for h in part if h[0] + GRAM <= a], begin, a))
                todo.append(([h for h in part if h[0] >= e], e, end))

    def marked(self, match: tuple[int, int, int, int], words: list[bytes]) -> bool:
        """Whether a match has the template's marks, near it if its ends are missing, and no others."""
        n, t, a, e = match
        room = len(self.texts[t]) - n + 1
        own, inside, near = self.marks[t], marks(words[max(0, a - 1) : e]) if a else marks(words[a:e]), marks(words[max(0, a - room) : e + room])
        return inside <= own <= near


def _around(starts: list[int], a: int, e: int, m: int) -> list[int]:
    """Of ascending starts of spans of m words, those that may meet a..e."""
    return starts[bisect_left(starts, a - m) : bisect_left(starts, e)]


def _within(starts: list[int], at: int, m: int) -> bool:
    return any(x <= at and at + GRAM <= x + m for x in _around(starts, at, at + 1, m))


def _best(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of matches (words, template, first, end), best first, those that no better one of their template meets, and none holds."""
    kept: list[tuple[int, int, int, int]] = []
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    size = 64
    for m in matches:
        _, t, a, e = m
        cells = range(a // size, (e - 1) // size + 1)
        if any(k[2] <= a and e <= k[3] or k[1] == t and k[2] < e and a < k[3] for c in cells for k in places.get(c, ())):
            continue
        kept.append(m)
        for c in cells:
            places.setdefault(c, []).append(m)
    return kept


def align(template: list[int], coded: np.ndarray, low: int, high: int, begin: int, end: int, band: int = BAND) -> tuple[int, int, int]:
    """(words matched, first, end) of the best local alignment whose diagonals (document place less template place) lie
    within `band` of low..high, among the document words begin..end. Ties go to more matches, then to the earlier end.

    By document word, all diagonals of the band at once: a cell's number holds its score, its matches and, reversed, its start, so that
    the greatest number is the best cell. Gaps along one word's diagonals are taken by a running maximum.
    """
    low, high, m = low - band, high + band, len(template)
    width = high - low + 1
    words = np.full(m + 2 * width + 2, -2, dtype=np.int64)
    words[width : width + m] = template
    # Score above bit 44, matches from bit 22, the start below: a piece has a few times the words of a template.
    unit, start_bits = 1 << 44, 1 << 22
    if max(m, end - begin) >= start_bits:
        raise ValueError("a template of a million words")
    down = np.arange(width, dtype=np.int64) * unit
    row, best = np.zeros(width, dtype=np.int64), (0, 0, 0)
    for j in range(begin, end):
        # Diagonal low + x has template place j - low - x.
        at = j - low
        if at - width + 1 >= m or at < 0:
            row[:] = 0
            continue
        place = np.clip(at - np.arange(width), -width, m + width)
        inside = (place >= 0) & (place < m)
        same = inside & (words[place + width] == coded[j])
        fresh = 2 * unit + start_bits + (start_bits - 1 - (j - begin))
        cell = np.where(same, np.where(row > 0, row + 2 * unit + start_bits, fresh), row - unit)
        # A document word without a partner comes from the diagonal below; a template word, from the one above in this row.
        cell[1:] = np.maximum(cell[1:], row[:-1] - unit)
        cell = np.where(inside & (cell >= unit), cell, 0)
        run = np.maximum.accumulate((cell - down)[::-1])[::-1] + down
        row = np.where(inside & (run >= unit), run, 0)
        top = int(row.max())
        if top // start_bits > best[0]:
            best = (top // start_bits, start_bits - 1 - top % start_bits + begin, j + 1)
    return best[0] % start_bits, best[1], best[2]


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in slices(batches):
            out = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                out += [(d, *m) for m in index.scan(t or "")]
            if out:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return run


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, n_matched, coverage, start, end) of each match; start and end count characters.

    docs needs doc_id and text; other columns are not looked at. Null and empty texts have no matches; whole texts are
    scanned. Repeated rows each give their matches; of templates that match one span equally well, the first by name
    is reported. A template of fewer than GRAM words is never found. Memory: a text, its hits, and one row of a band.
    """
    index = Index.of(TEMPLATES if templates is None else templates)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(index)), OUT)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts and notices in all documents."""
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_license_scan": op7_license_scan}
SQL: dict[str, str] = {}
