"""License scans by patience alignment of whole texts with templates.

At least a share `coverage` of a template's words must match, so of any words of it that are more than the rest, one must.
The places in the text of its words that are rarest there, as many as that, are pinned one after another, over the whole
text: the words before and after a pin, as far as the widest allowed span reaches, are aligned with the template's words
before and after it, from the pin outwards. So a copy is aligned with its own words first, whatever repeats near it. Equal
ends are matched, words unique to both sides become anchors, the longest increasing run of anchors is kept, and the gaps
between them are aligned the same way; a gap whose words all repeat gives its longest common subsequence. Of the matches
the longest run is kept that fills half of its span. Coverage is the matched share of the template's words. Words that tell
licenses apart (TELLING, and a template's version numbers) must all match, and no further one may stand in the span.

Defined results: null and wordless texts match nothing and keep their row; a document gives all its matches, those of one
template apart from each other, and of them the best by coverage, then length, then name, at its first place; repeated rows give a row each; equal texts give equal results; an empty list of
templates matches nothing; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import small_batches

_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_OPENING_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_CLAUSES_BSD = """: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. """
_OPENING_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
_HEADER_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."

#: Notices of public licenses, whole texts of the short ones, and openings of longer ones.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "AGPL-3.0-header": _HEADER_GNU.format("Affero "),
    "BSD-2-Clause": _OPENING_BSD + _CLAUSES_BSD + _WARRANTY_BSD,
    "BSD-3-Clause": _OPENING_BSD + _CLAUSES_BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _WARRANTY_BSD,
    "BSD-opening": _OPENING_BSD,
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": _HEADER_GNU.format(""),
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-3.0-header": _HEADER_GNU.format("Lesser "),
    "MIT": "Released under the MIT License.",
    "MIT-text": _OPENING_MIT,
    "MIT-whole": _OPENING_MIT + """, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
COVERAGE = 0.8
#: Words that tell licenses apart; so do numbers after the words of VERSION.
TELLING = frozenset("mit bsd isc apache mozilla gnu lesser affero cc cc0 nc nd sa noncommercial noderivatives sharealike endorse".split())
VERSION = frozenset("version v by nc sa attribution noncommercial sharealike".split())

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by rising first places, whose second places rise too (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        tops[k : k + 1], at[k : k + 1] = [b], [i]
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _common(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, at the earliest places."""
    longest = [[0] * (len(template) + 1) for _ in range(len(text) + 1)]
    for i in range(len(text) - 1, -1, -1):
        for j in range(len(template) - 1, -1, -1):
            longest[i][j] = longest[i + 1][j + 1] + 1 if text[i] == template[j] else max(longest[i + 1][j], longest[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(text) and j < len(template) and longest[i][j]:
        if text[i] == template[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif longest[i][j + 1] == longest[i][j]:
            j += 1
        else:
            i += 1
    return out


def _dense(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of matches that are at least half of the words from its first to its last; the first of such."""
    for n in range(len(found), 0, -1):
        for i in range(len(found) - n + 1):
            if 2 * n >= found[i + n - 1][0] - found[i][0] + 1:
                return found[i : i + n]
    return []


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched places (text, template), rising in both."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, a_end, b, b_end = gaps.pop()
        while a < a_end and b < b_end and text[a] == template[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and text[a_end - 1] == template[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            out.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        in_text, in_template = Counter(text[a:a_end]), Counter(template[b:b_end])
        place = {w: j for j, w in enumerate(template[b:b_end], b)}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(text[a:a_end], a) if in_text[w] == 1 and in_template[w] == 1])
        if anchors:
            out += anchors
            ends = [(a - 1, b - 1), *anchors, (a_end, b_end)]
            gaps += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends[:-1], ends[1:], strict=True)]
        else:
            out += [(a + x, b + y) for x, y in _common(text[a:a_end], template[b:b_end])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = [(name, words) for name, text in sorted(templates.items()) if (words := words_of(text))]
        self.sizes = {name: len(words) for name, words in self.templates}
        self.known = {w for _, words in self.templates for w in words}

    def _told(self, words: list[str], template: list[str], run: list[tuple[int, int]]) -> bool:
        """Whether all telling words of the template match, and the span holds no other."""
        at, of = {i for i, _ in run}, {j for _, j in run}
        numbers = (j for j in range(1, len(template)) if template[j][0].isdigit() and template[j - 1] in VERSION)
        needed = {*(j for j, w in enumerate(template) if w in TELLING), *numbers}
        return needed <= of and not any(words[i] in TELLING and i not in at for i in range(run[0][0], run[-1][0] + 1))

    def _matches(self, words: list[str], places: dict[str, list[int]], template: list[str]) -> list[tuple[float, int, int]]:
        """(coverage, first word, end word) of a template's matches, apart from each other, by place."""
        least = math.ceil(self.coverage * len(template) - 1e-9)
        wanted, reach = Counter(template), 2 * len(template)
        # Each matched word is a word of both, so fewer shared words cannot reach the coverage.
        if sum(min(n, len(places.get(w, ()))) for w, n in wanted.items()) < least:
            return []
        found = []
        whole: set[tuple[int, int]] = set()  # pairs of copies that match wholly: no other pin of them can give more
        rarest = sorted(range(len(template)), key=lambda j: (len(places.get(template[j], ())), j))[: len(template) - least + 1]
        for j in rarest:
            for i in places.get(template[j], ()):
                if (i, j) in whole:
                    continue
                before, after = words[max(0, i - reach) : i], words[i + 1 : i + reach]
                near = Counter(before) + Counter(after)
                near[template[j]] += 1
                if sum(min(n, near[w]) for w, n in wanted.items()) < least:
                    continue
                left = [(i - 1 - x, j - 1 - y) for x, y in align(before[::-1], template[:j][::-1])]
                right = [(i + 1 + x, j + 1 + y) for x, y in align(after, template[j + 1 :])]
                run = _dense([*left[::-1], (i, j), *right])
                if len(run) >= least and self._told(words, template, run):
                    if len(run) == len(template) == run[-1][0] - run[0][0] + 1:
                        whole.update(run)
                    found.append((len(run) / len(template), run[0][0], run[-1][0] + 1))
        taken: list[tuple[float, int, int]] = []
        for share, first, end in sorted(set(found), key=lambda f: (-f[0], f[2] - f[1], f[1])):
            at = bisect_left(taken, first, key=lambda t: t[1])
            if (at == 0 or taken[at - 1][2] <= first) and (at == len(taken) or end <= taken[at][1]):
                taken.insert(at, (share, first, end))
        return taken

    def matches(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, end word) of every match, by place, then end and name."""
        words = words_of(text)
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.known:
                places.setdefault(w, []).append(i)
        found = [(name, *m) for name, template in self.templates for m in self._matches(words, places, template)]
        return sorted(found, key=lambda m: (m[2], m[3], m[0]))

    def best_of(self, found: list[tuple[str, float, int, int]]) -> tuple[str | None, float, int | None, int | None]:
        """Of all matches of a text the best."""
        return min(found, key=lambda m: (-m[1], -self.sizes[m[0]], m[0], m[2]), default=(None, 0.0, None, None))

    def best(self, text: str) -> tuple[str | None, float, int | None, int | None]:
        """(license, coverage, first word, end word) of the best match."""
        return self.best_of(self.matches(text))


_MATCH = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])


def scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, end_word, matches) of every row; null where no template reaches the coverage.

    `matches` holds every match (license, coverage, first_word, end_word) by place.
    """

    small_batches(documents.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            every = [scanner.matches(t.as_py() or "") for t in batch.column("text")]
            found = [scanner.best_of(m) for m in every]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)] if found else []
            if found:
                lists = pa.array([[dict(zip(_MATCH.names, m, strict=True)) for m in ms] for ms in every], pa.list_(_MATCH))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, lists], ["doc_id", "license", "coverage", "first_word", "end_word", "matches"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, license string, coverage double, first_word long, end_word long, matches array<struct<license string, coverage double, first_word long, end_word long>>")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licenses of every document: the best with the template's coverage, and all matches."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
