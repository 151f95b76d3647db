"""License scans (operator 10): winnowed fingerprints, then local alignment.

Templates are winnowed once: of every ``WINNOW`` neighbouring hashes of three
words, the least is kept, in an index of hash to (template, position).  Texts are
winnowed the same way, so a run of ``SHINGLE + WINNOW - 1`` equal words is always
seen.  Around the diagonals of the hits, text and template are then aligned in a band, which is
widened until no alignment outside of it can be better: local alignments count matched words,
tolerate words that are missing, added or changed, and give the spans.

Words are runs of ASCII letters and digits and of non-ASCII characters, in lower
case, so punctuation and line breaks don't matter.

Defined results: a text may hold several licenses, or one several times: a row for
each; a text that holds a license's notice and its whole text has a row for either;
null, empty and unlicensed texts have no row; repeated rows and null ids are reported
like any other; an empty table, or template list, gives an empty table; other columns
aren't looked at; of a very long text only the parts around hits are aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm.tables import two_columns
from quarrystone.llm.textblocks import Words, scan_words, window_hashes

SHINGLE = 3
WINNOW = 2
COVERAGE = 0.8
BAND = 16  # diagonals on either side of a hit's that are tried first; a quarter of the template if that is more
MOST_TEMPLATE_WORDS = 1_000_000  # bound of what every task is given

# The disclaimers of two families of licenses, and widely used license notices and texts.
_MIT_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT line": "Released under the MIT License.",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "MIT text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _MIT_AS_IS
    ),
    "BSD-2-Clause text": _BSD_TWO + _BSD_AS_IS,
    "BSD-3-Clause text": (
        _BSD_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. " + _BSD_AS_IS
    ),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
        "and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _MIT_AS_IS
    ),
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _winnow(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Indices of the least hash of every WINNOW neighbours of one row; rows with fewer keep their least too."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    keep = np.zeros(len(hashes), bool)
    opens = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    sizes = np.diff(np.append(opens, len(hashes)))
    keep[opens[sizes < WINNOW]] = True
    if len(hashes) >= WINNOW:
        views = np.lib.stride_tricks.sliding_window_view(hashes, WINNOW)
        at = np.arange(len(views)) + views.argmin(axis=1)
        whole = row[: len(views)] == row[WINNOW - 1 :]
        keep[at[whole]] = True
    return np.flatnonzero(keep)


class Index:
    """Inverted index of winnowed template fingerprints."""

    def __init__(self, templates: Mapping[str, str]) -> None:
        self.names = list(templates)
        self.words: list[np.ndarray] = []
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        total = 0
        for t, name in enumerate(self.names):
            for words in scan_words(pa.array([templates[name]]), lower=True, delimiter=_NOT_WORD):
                self.words.append(words.hash)
                total += len(words.hash)
                hashes, first = window_hashes(words, SHINGLE)
                kept = _winnow(hashes, np.zeros(len(hashes), np.int64))
                for h, p in zip(hashes[kept].tolist(), first[kept].tolist(), strict=True):
                    found[h].append((t, p))
        if total > MOST_TEMPLATE_WORDS:
            raise ValueError(f"the templates have {total} words; at most {MOST_TEMPLATE_WORDS} are sent to every task")
        self.keys = np.array(sorted(found), np.uint64)
        self.places = [found[int(k)] for k in self.keys]


def _bands(diagonals: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Ranges of diagonals, first and last, that lie within the width of a given one; they don't overlap."""
    own = np.unique(diagonals)
    cuts = np.flatnonzero(np.diff(own) > 2 * width) + 1
    return [(int(part[0]) - width, int(part[-1]) + width) for part in np.split(own, cuts)]


def _best_alignments(text: np.ndarray, template: np.ndarray, bands: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """The best local alignment within a band from each word of the text: score, matched words, first and last+1 word.

    A cell is a diagonal of a band, which is the place in the text less that in the template; the bands are rolled
    down the template side by side.  A word is added on the next diagonal, and missing on the one before.
    """
    n = len(text)
    diagonal = np.concatenate([np.arange(a, b + 1) for a, b in bands])
    at = np.arange(len(diagonal))
    opens = np.zeros(len(at), bool)
    opens[np.cumsum([0, *(b - a + 1 for a, b in bands[:-1])])] = True
    closes = np.append(opens[1:], True)
    apart = at + (np.cumsum(opens) - 1) * (2 * len(template) + 3)  # no path goes from one band into the next
    score, matched, first = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), diagonal.copy()
    best, best_matched, best_end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j, want in enumerate(template):
        place = diagonal + j
        inside = (place >= 0) & (place < n)
        equal = inside & (text[np.where(inside, place, 0)] == want)
        # From the word before: matched or changed; a path of score 0 begins anew.
        d_score, d_matched, d_first = score + np.where(equal, 2, -1), matched + equal, np.where(score > 0, first, place)
        m_score = np.where(closes, 0, np.roll(score, -1)) - 1
        missing = m_score > d_score
        score, matched, first = np.where(missing, m_score, d_score), np.where(missing, np.roll(matched, -1), d_matched), np.where(missing, np.roll(first, -1), d_first)
        # Added words: each cell is reached from the nearest that is best with the words between taken off.
        level = score + apart
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == top, at, 0))
        score, matched, first = score[source] - (at - source), matched[source], first[source]
        gone = score <= 0
        score[gone], matched[gone], first[gone] = 0, 0, place[gone]
        ends = np.flatnonzero(equal & (source == at) & (score > 0))
        ends = ends[score[ends] > best[first[ends]]]
        ends = ends[np.argsort(score[ends], kind="stable")]  # of several ends from one word the last, so the best, stays
        best[first[ends]], best_matched[first[ends]], best_end[first[ends]] = score[ends], matched[ends], place[ends] + 1
    begins = np.flatnonzero(best)
    return list(zip(best[begins].tolist(), best_matched[begins].tolist(), begins.tolist(), best_end[begins].tolist(), strict=True))


def _common(text: np.ndarray, words: np.ndarray, counts: np.ndarray) -> int:
    """How many of the template's words, as often as it has them, occur in the text: no alignment matches more."""
    at = np.minimum(np.searchsorted(words, text), len(words) - 1)
    found = np.bincount(at[words[at] == text], minlength=len(words))
    return int(np.minimum(found, counts).sum())


def align(text: np.ndarray, template: np.ndarray, hits: list[tuple[int, int]], coverage: float = COVERAGE, band: int = BAND) -> list[tuple[int, int, int]]:
    """Alignments that cover enough of the template, none over another: matched words, first and last+1 word of the text, in order.

    A match scores 2, a changed, missing or added word costs 1, so pieces are joined
    where both score more than what lies between them costs.  ``hits`` are (word, diagonal), in
    order; what is left beside an alignment is aligned again as long as a hit in it isn't covered.

    The alignment is banded: only diagonals within a width of a hit's are tried.  One that leaves the band
    has more added and missing words than the width, so it scores less than twice the template's words less the
    width.  What scores as much in the band is therefore the best of all and is taken; else the band is widened, until
    it takes in every diagonal that an alignment through a hit can reach.
    """
    least = coverage * len(template)
    widest = 2 * len(template)
    words, counts = np.unique(template, return_counts=True)
    found: list[tuple[int, int, int]] = []
    open_ = [(0, len(text), min(max(band, len(template) // 4), widest))]
    while open_:
        a, b, width = open_.pop()
        inside = hits[bisect_left(hits, (a,)) : bisect_left(hits, (b,))]
        if not inside or b - a < least or _common(text[a:b], words, counts) < least:
            continue
        bands = _bands(np.array([d - a for _, d in inside]), width)
        taken: list[tuple[int, int]] = []
        for score, matched, begin, end in sorted(_best_alignments(text[a:b], template, bands), key=lambda x: (-x[0], x[2])):
            if score < widest - width:
                break
            if matched < least:
                continue
            k = bisect_left(taken, (begin, end))
            if (k and taken[k - 1][1] > begin) or (k < len(taken) and taken[k][0] < end):
                continue
            taken.insert(k, (begin, end))
            found.append((matched, a + begin, a + end))
        edges = [0, *(x for span in taken for x in span), b - a]
        if taken:
            open_ += [(a + x, a + y, width) for x, y in zip(edges[::2], edges[1::2], strict=True)]
        elif width < widest:
            open_.append((a, b, min(4 * width, widest)))
    return sorted(found, key=lambda x: x[1])


def _regions(places: list[tuple[int, int]], n: int, template: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Parts of a text of n words that hold every alignment through a hit (word, diagonal), with the hits in them.

    An alignment's added words are fewer than twice the template's, or its score would not be above 0.
    """
    spans = sorted((max(0, d - 2 * template), min(n, d + 3 * template), w, d) for w, d in places)
    lo, hi, inside = spans[0][0], spans[0][1], [spans[0][2:]]
    for a, b, *hit in spans[1:]:
        if a > hi:
            yield lo, hi, sorted(inside)
            lo, inside = a, []
        hi = max(hi, b)
        inside.append(tuple(hit))
    yield lo, hi, sorted(inside)


def _matches(words: Words, index: Index) -> Iterator[tuple[int, str, int, int, float, int, int]]:
    hashes, first = window_hashes(words, SHINGLE)
    rows = np.searchsorted(words.row_end, first, side="right")
    picked = _winnow(hashes, rows)
    at = np.searchsorted(index.keys, hashes[picked])
    hit = np.zeros(len(picked), bool)
    inside = at < len(index.keys)
    hit[inside] = index.keys[at[inside]] == hashes[picked][inside]
    starts = words.row_start
    hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for i, k in zip(picked[hit].tolist(), at[hit].tolist(), strict=True):
        row = int(rows[i])
        word = int(first[i]) - int(starts[row])
        for template, position in index.places[k]:
            hits[row, template].append((word, word - position))
    for (row, template), places in sorted(hits.items()):
        text, want = words.hash[starts[row] : words.row_end[row]], index.words[template]
        for lo, hi, inside in _regions(places, len(text), len(want)):
            for matched, begin, end in align(text[lo:hi], want, [(w - lo, d - lo) for w, d in inside]):
                b, e = int(words.start[starts[row] + lo + begin]), int(words.end[starts[row] + lo + end - 1])
                yield row, index.names[template], matched, len(want), matched / len(want), b, e


def scan_licenses(df: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each license found: id, license, n_matched, n_template, coverage, start and end (code points)."""
    src = two_columns(df, id_col, text_col)
    given = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(given)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "license", "n_matched", "n_template", "coverage", "start", "end")}
            for words in scan_words(batch.column(1), lower=True, delimiter=_NOT_WORD):
                if not len(index.keys):
                    break
                for row, *rest, b, e in _matches(words, index):
                    head = words.data[words.offsets[row] : e]
                    lead = (head & 0xC0) != 0x80  # first bytes of characters
                    chars = np.cumsum(lead)
                    s = int(chars[b - words.offsets[row] - 1]) if b > words.offsets[row] else 0
                    for k, v in zip(out, (words.first_row + row, *rest, s, int(chars[-1])), strict=True):
                        out[k].append(v)
            ids = batch.column(0).take(pa.array(out.pop("row"), pa.int64()))
            types = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], [id_col, *out])

    return src.mapInArrow(run, f"{id_col} {src.dtypes[0][1]}, license string, n_matched long, n_template long, coverage double, start long, end long")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All license notices in all of ``documents``."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
