"""License scans by patience alignment.

A text is aligned with a license template on the words that both have exactly once: the longest
increasing run of those anchors is fixed, and the gaps between them are aligned in the same way. What share
of the template is covered says whether the license is there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+")
MATCHES = "array<struct<license: string, coverage: double, span_coverage: double, start: bigint, end: bigint>>"

_GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public
License as published by the Free Software Foundation; {version}."""
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_CC = "This work is licensed under a Creative Commons {kind} {version} International License."
_CC_KINDS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

# Short licenses as a whole, and of long ones the notices by which works are put under them, by version.
TEMPLATES = {
    "All-Rights-Reserved": "All rights reserved.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-only-notice": _GPL.format(kind="General", version="version 2 of the License"),
    "GPL-2.0-or-later-notice": _GPL.format(kind="General", version="either version 2 of the License, or (at your option) any later version"),
    "GPL-3.0-only-notice": _GPL.format(kind="General", version="version 3 of the License"),
    "GPL-3.0-or-later-notice": _GPL.format(kind="General", version="either version 3 of the License, or (at your option) any later version"),
    "LGPL-2.1-or-later-notice": _GPL.format(kind="Lesser General", version="either version 2.1 of the License, or (at your option) any later version"),
    "LGPL-3.0-or-later-notice": _GPL.format(kind="Lesser General", version="either version 3 of the License, or (at your option) any later version"),
    "AGPL-3.0-or-later-notice": _GPL.format(kind="Affero General", version="either version 3 of the License, or (at your option) any later version"),
    "MPL-1.1-notice": """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not
use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/""",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR
A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": f"{_REDISTRIBUTION} {_DISCLAIMER}",
    "BSD-3-Clause": f"""{_REDISTRIBUTION} 3. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission. {_DISCLAIMER}""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software
must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
    **{f"CC-{kind}-{version}-line": _CC.format(kind=name, version=version) for version in ("3.0", "4.0") for kind, name in _CC_KINDS.items()},
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_rise(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence of different ``values``, by patience sorting."""
    tops: list[int] = []
    at_top: list[int] = []
    before: list[int] = []
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            at_top.append(i)
        else:
            tops[pile], at_top[pile] = value, i
        before.append(at_top[pile - 1] if pile else -1)
    out, i = [], at_top[-1] if at_top else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, rising in both."""
    matched, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        anchors = sorted((i, once_b[w]) for w, i in once_a.items() if w in once_b)
        rise = [anchors[i] for i in longest_rise([j for _, j in anchors])]
        matched += rise
        if rise:
            borders = [(a0 - 1, b0 - 1), *rise, (a1, b1)]
            open_ += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(borders, borders[1:])]
    return sorted(matched)


def _once(words: list[str], start: int, end: int) -> dict[str, int]:
    """Positions of the words that occur once in a range."""
    found: dict[str, int] = {}
    for i in range(start, end):
        found[words[i]] = -1 if words[i] in found else i
    return {w: i for w, i in found.items() if i >= 0}


@dataclass
class Template:
    name: str
    words: list[str]
    least: float

    @property
    def rare(self) -> set[str]:
        """Words of which at least one must be in any text that covers the template well enough.

        Too few words are left without them. Long words are taken, being rare in other texts.
        """
        different = sorted(set(self.words), key=lambda w: (-len(w), w))
        need, left = self.least * len(self.words), len(self.words)
        for i, word in enumerate(different):
            left -= self.words.count(word)
            if left < need:
                return set(different[: i + 1])
        return set(different)

    @property
    def numbers(self) -> set[int]:
        """Places of the numbers, which tell versions apart: an alignment without one of them is none."""
        return {i for i, w in enumerate(self.words) if w.isdigit()}

    def alignments(self, text: list[str], marks: list[int]) -> list[Alignment]:
        """All alignments near ``marks`` (positions of rare words) that cover enough of the template."""
        size, own, out, seen = len(self.words), set(self.words), [], set()
        # Words of the template before each place of the text: a stretch with too few of them cannot cover it.
        held = list(accumulate((w in own for w in text), initial=0))

        def align(start: int, end: int) -> Alignment | None:
            start, end = max(0, start), min(len(text), end)
            if (start, end) in seen or held[end] - held[start] < self.least * size:
                return None
            seen.add((start, end))
            pairs = trimmed(patience(self.words, text[start:end]), size)
            if len(pairs) < self.least * size or not self.numbers <= {i for i, _ in pairs}:
                return None
            first, last = start + pairs[0][1], start + pairs[-1][1]
            return Alignment(self.name, len(pairs), size, first, last)

        done = -1  # end of a whole copy
        for mark in marks:
            if mark <= done:
                continue
            # Where one copy would lie, for two copies side by side have no word once; then with room for words put in; then widely around.
            at = [i for i, w in enumerate(self.words) if w == text[mark]]
            room, far = size // 4 + 2, mark // size * size
            windows = [*((mark - i, mark - i + size) for i in at), *((mark - i - room, mark - i + size + room) for i in at), (far - 2 * size, far + 3 * size)]
            for window in windows:
                if found := align(*window):
                    out.append(found)
                    if found.coverage == found.span_coverage == 1.0:
                        done = found.last
                        break
        return out


@dataclass(frozen=True)
class Alignment:
    """Words that match, words of the template, and the first and last word of the span."""

    name: str
    matched: int
    size: int
    first: int
    last: int

    @property
    def coverage(self) -> float:
        return self.matched / self.size

    @property
    def span_coverage(self) -> float:
        return self.matched / (self.last - self.first + 1)

    @property
    def gain(self) -> int:
        """Words that match, less those of the template and of the span that do not."""
        return 3 * self.matched - self.size - (self.last - self.first + 1)


def trimmed(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The pairs without strays at either end, as long as that raises the product of both shares."""
    def score(i: int, j: int) -> float:
        return (j - i) ** 2 / size / (pairs[j - 1][1] - pairs[i][1] + 1)

    i, j = 0, len(pairs)
    while j - i > 1:
        now, head, tail = score(i, j), score(i + 1, j), score(i, j - 1)
        if max(head, tail) <= now:
            break
        i, j = (i + 1, j) if head >= tail else (i, j - 1)
    return pairs[i:j]


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.templates = [Template(name, words_of(text), least) for name, text in templates.items()]
        self.rare: dict[str, list[int]] = {}
        for i, template in enumerate(self.templates):
            for word in template.rare:
                self.rare.setdefault(word, []).append(i)

    def scan(self, text: str) -> list[tuple[str, float, float, int, int]]:
        """Matches (license, coverage, span coverage, start, end) that do not overlap, best ones first come, in order of the text."""
        found = list(WORD.finditer(text)) if not self.rare.keys().isdisjoint(words_of(text)) else []
        words = [m[0].lower() for m in found]
        marks: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            for i in self.rare.get(word, ()):
                marks.setdefault(i, []).append(at)
        every = {a for i, at in marks.items() for a in self.templates[i].alignments(words, at)}
        starts: list[int] = []
        chosen: list[Alignment] = []
        # Of templates that overlap at a place the one stays that gains most; a longer span wins a tie.
        for a in sorted(every, key=lambda a: (-a.gain, a.first - a.last, a.first, a.name)):
            at = bisect_left(starts, a.first)
            if (at == len(starts) or chosen[at].first > a.last) and (at == 0 or chosen[at - 1].last < a.first):
                starts.insert(at, a.first)
                chosen.insert(at, a)
        return [(a.name, a.coverage, a.span_coverage, found[a.first].start(), found[a.last].end()) for a in chosen]


def license_matches(templates: dict[str, str], least: float, text: Column) -> Column:
    """Licenses of whole texts: name, matched shares of template and span, and the span in code points, end exclusive."""
    state: dict = {}

    def scan(texts: pa.Array) -> pa.Array:
        if "scanner" not in state:
            state["scanner"] = Scanner(templates, least)
        rows = [[dict(zip(("license", "coverage", "span_coverage", "start", "end"), m)) for m in state["scanner"].scan(t.as_py())] for t in texts]
        kind = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("span_coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
        return pa.array(rows, pa.list_(kind))

    return F.arrow_udf(scan, MATCHES).asNondeterministic()(F.coalesce(text.cast("string"), F.lit("")))


def scan_licenses(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: dict[str, str] | None = None, least_coverage: float = LEAST_COVERAGE,
) -> DataFrame:
    """A row per row of ``df``: ``id`` and ``matches``, all alignments with a template that is covered well enough.

    Matches do not overlap: where several templates fit, the one stays that has most matched words, less those of template and span that
    do not match; the numbers of a template (versions) must all match. Of equally good ones the longer counts, then the first, then the first by name.
    Null and repeated ids are rows like any other; a null or empty text has no match, and an empty table gives no
    row. Texts are read whole, however long, and other columns do not matter.
    """
    found = license_matches(templates or TEMPLATES, least_coverage, F.col(f"`{text_col}`"))
    return df.select(F.col(f"`{id_col}`").alias("id"), found.alias("matches"))
