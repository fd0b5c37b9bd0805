"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

A template's words (A-Z lower-cased, marks taken off) give `GRAM`-word hashes; of every `WINDOW` neighbouring hashes the least one is kept.
Those sit in an inverted index of hash to (template, place). A text is fingerprinted alike; a shared run of
GRAM + WINDOW - 1 words is sure to share one. Hits of a text and template whose diagonals differ by at most
the band are one candidate; a local alignment in that band (match 1, else -1) gives the matched words,
their share of the template, and the span in the text.

The templates are a parameter, few and small, and travel with the function. Null text: empty, no row. A template may be found several
times in a text, each time as a row; finds of one template that overlap are one, the best of them. Null ids, ties and repeated rows are
scanned like others; an empty table gives an empty result. Texts of any length are read whole. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix

GRAM, WINDOW, BAND = 3, 2, 4
_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")

# fixed values: public notices and licence texts, as texts state them
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "Apache-2.0-header": "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "BSD-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def _words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(m.group().lower(), m.span()) for m in _WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def _hashes(ids: np.ndarray) -> np.ndarray:
    n = len(ids) - GRAM + 1
    return mix(sum(ids[k : k + n] * U64(2 * k + 3) ** U64(k + 5) for k in range(GRAM))) if n > 0 else np.zeros(0, U64)


def winnow(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their places: the least of each window, the last of equals."""
    h = _hashes(ids)
    if not len(h):
        return h, np.zeros(0, np.int64)
    w = min(WINDOW, len(h))
    view = np.lib.stride_tricks.sliding_window_view(h, w)
    at = np.unique(np.arange(len(view)) + (w - 1) - view[:, ::-1].argmin(1))
    return h[at], at


def align(a: list[str], b: list[str], shift: int, band: int) -> tuple[int, int, int]:
    """Matched words of the best local alignment of a in b along i + shift, and the first and last word of b in it."""
    rows: list[dict[int, tuple[int, int, int]]] = [{}]
    best, out = 0, (0, 0, -1)
    for i, w in enumerate(a):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + shift - band), min(len(b), i + shift + band + 1)):
            up = rows[-1].get(j - 1, (0, 0, j))  # score, matches, first word
            if w == b[j]:
                start = up[2] if up[0] else j
                cell = (up[0] + 1, up[1] + 1, start)
            else:
                side, above = row.get(j - 1, (0, 0, j)), rows[-1].get(j, (0, 0, j))
                s = max(up, side, above, key=lambda x: x[0])
                cell = (s[0] - 1, s[1], s[2]) if s[0] > 1 else (0, 0, j)
            row[j] = cell
            if cell[0] > best:
                best, out = cell[0], (cell[1], cell[2], j)
        rows = [row]
    return out


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [_words(t)[0] for t in templates.values()]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for t in self.words for w in t}))}
        rows = [(h, t, p) for t, w in enumerate(self.words) for h, p in zip(*winnow(np.array([self.ids[x] for x in w], U64)), strict=True)]
        rows.sort()
        self.hash, self.of, self.place = np.array([r[0] for r in rows], U64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)

    def scan(self, text: str, band: int, least: float) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, start, end in characters) of each place where a template is."""
        words, spans = _words(text)
        ids = np.array([self.ids.get(w, 0) for w in words], U64)
        at = np.flatnonzero(ids)
        if len(at) < GRAM:
            return []
        h = _hashes(ids)
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        hits = sorted((int(self.of[k]), p - int(self.place[k])) for p in np.flatnonzero(hi > lo) for k in range(lo[p], hi[p]))
        out, k = [], 0
        while k < len(hits):
            t, shift = hits[k]
            end = k
            while end + 1 < len(hits) and hits[end + 1][0] == t and hits[end + 1][1] - hits[end][1] <= band:
                end += 1
            middle = (shift + hits[end][1]) // 2
            n, a, b = align(self.words[t], words, middle, band + (hits[end][1] - shift + 1) // 2)
            cover = n / len(self.words[t])
            if cover >= least:
                out.append((self.names[t], cover, n, spans[a][0], spans[b][1]))
            k = end + 1
        kept: list[tuple[str, float, int, int, int]] = []
        for r in sorted(set(out), key=lambda r: (-r[1], r[3])):  # of overlapping finds of a template the best
            if all(r[0] != o[0] or r[4] <= o[3] or r[3] >= o[4] for o in kept):
                kept.append(r)
        return sorted(kept, key=lambda r: (r[3], r[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, band: int = BAND, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, matched_words, start_char, end_char of every find in every whole text."""
    templates = dict(TEMPLATES if templates is None else templates)

    def each(batches):
        index = Index(templates)
        for b in batches:
            rows = [(doc.as_py(), *r) for doc, text in zip(b.column(0), b.column(1), strict=True) if text.is_valid for r in index.scan(text.as_py(), band, least)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (b.schema.field(0).type, pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "license", "coverage", "matched_words", "start_char", "end_char"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, f"doc_id {kind}, license string, coverage double, matched_words long, start_char long, end_char long")
