"""License scans: patience alignment of texts to notice templates.

Template and text are compared word by word. Words that are unique in both are anchors; their longest
increasing subsequence is kept, and the gaps between are aligned the same way until nothing is unique.
Coverage is the share of the template's words that align.

To find where to align without missing anything: if coverage is at least ``COVER``, at most that many of the
template's words are unmatched as it leaves, so of one more than that of its words (the longest) one occurs in the text. Around each
occurrence a window of the template's length and a quarter more on either side is aligned; a text or window without
enough of the template's words at all is dropped first. Where no window covers enough, words may be inserted, any number at any place: the
longest common subsequence of template and whole text decides, over the text's words that the template has; as scattered
words aren't a notice, each break in their patience alignment, of k such words, counts as log2(k + 1) words less in what must reach ``COVER``.
Its place is the shortest that ends where the subsequence is first complete.

Of templates that cover one place (a whole licence, its beginning, one with a clause less), that which matches most words there stands, and of
equals the one that is better covered; a row within the place of another is dropped.

Nulls and edge cases: null and empty texts hold no notice; a notice that occurs several times gives its best
place, the first of equals; a text shorter than a template can still cover
part of it. Texts are scanned whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

COVER = 0.8

_SOFTWARE_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_REST = "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_APACHE = "Licensed under the Apache License, Version 2.0"
_APACHE_HEADER = f"{_APACHE} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_GPL_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"

#: Whole licences where they are short, headers and notices, by SPDX identifier and kind.
TEMPLATES = {
    "MIT/notice": "Released under the MIT License",
    "MIT/grant": _MIT_GRANT,
    "MIT/conditions": _MIT_REST,
    "MIT/full": f"{_MIT_GRANT}, {_MIT_REST}",
    "Apache-2.0/notice": _APACHE,
    "Apache-2.0/header": _APACHE_HEADER,
    "Apache-2.0/full-header": f"{_APACHE_HEADER} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0/header": _GPL_HEADER,
    "GPL-3.0/full-header": f"{_GPL_HEADER}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "BSD/grant": _BSD_GRANT,
    "BSD/disclaimer": _BSD_REST,
    "BSD-2-Clause/full": f"{_BSD_GRANT}: {_BSD_TWO} {_BSD_REST}",
    "BSD-3-Clause/full": f"{_BSD_GRANT}: {_BSD_TWO} {_BSD_THIRD} {_BSD_REST}",
    "ISC/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "ISC/full": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_SOFTWARE_AS_IS}",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "reserved/notice": "All rights reserved",
}


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of two sequences, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1 and na.get(w) == 1}
        common = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if w in where]
        if not common:
            continue
        tails, ends, before = [], [], []
        for n, (_, j) in enumerate(common):
            at = bisect_left(tails, j)
            before.append(ends[at - 1] if at else -1)
            tails[at:] = [j] if at == len(tails) else [j, *tails[at + 1 :]]
            ends[at:] = [n] if at == len(ends) else [n, *ends[at + 1 :]]
        chain, n = [], ends[-1]
        while n >= 0:
            chain.append(common[n])
            n = before[n]
        x, y = a0, b0
        for i, j in [*reversed(chain), (a1, b1)]:
            todo.append((x, i, y, j))
            if i < a1:
                out.append((i, j))
            x, y = i + 1, j + 1
    return sorted(out)


def spread(text: list, words: list) -> tuple[int, int, int]:
    """Length of the longest common subsequence; first and last place in the text where it is first complete, and shortest then."""

    def ends(a, b) -> tuple[int, int]:
        full, most, at = (1 << len(b)) - 1, 0, -1
        where: dict = defaultdict(int)
        for j, w in enumerate(b):
            where[w] |= 1 << j
        row = full  # a bit is 0 where the length grows
        for i, w in enumerate(a):
            both = row & where.get(w, 0)
            if both:
                row = (row + both | row - both) & full
                if (length := len(b) - row.bit_count()) > most:
                    most, at = length, i
        return most, at

    most, last = ends(text, words)
    return most, last - ends(text[last::-1], words[::-1])[1] if most else -1, last


class Scanner:
    """Templates as word hashes, with the words that give a place away."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, cover: float = COVER):
        self.names, self.cover = list(templates), cover
        t = C.Tokens(pa.array([templates[n].lower() for n in self.names], pa.string()))
        self.words = [t.hash[a:b] for a, b in zip(t.first, t.first[1:])]
        self.probes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k in range(len(self.names)):
            own = range(t.first[k], t.first[k + 1])
            # places that can stay unmatched, and one more
            most = int((1 - cover) * len(own) + 1e-9) + 1
            longest = sorted(own, key=lambda i: (t.start[i] - t.end[i], i))
            for i in longest[:most]:
                self.probes[int(t.hash[i])].append((k, i - int(t.first[k])))
        self.probes = dict(self.probes)
        self.keys = np.sort(np.array(list(self.probes), np.uint64))
        self.sets = [np.unique(w) for w in self.words]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def scan(self, t: C.Tokens) -> list[tuple[int, int, float, int, int]]:
        """(text, template, coverage, first word, end word) of the best place of each template in each text."""
        at = np.flatnonzero(self.bits[(t.hash >> np.uint64(48)).astype(np.int64)])
        at = at[np.isin(t.hash[at], self.keys)]
        places: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i in at:
            for k, offset in self.probes[int(t.hash[i])]:
                places[int(t.row[i]), k].add(int(t.place[i]) - offset)
        found: dict[int, list] = defaultdict(list)
        for (row, k), starts in places.items():
            words, n, best = self.words[k], len(self.words[k]), None
            text, slack = t.hash[t.first[row] : t.first[row + 1]], max(3, n // 4)
            held = np.flatnonzero(np.isin(text, self.sets[k]))
            if np.isin(words, text[held]).sum() < self.cover * n:
                continue
            for start in sorted(starts):
                a, b = max(0, start - slack), min(len(text), start + n + slack)
                window = text[a:b]
                if np.isin(words, window).sum() < self.cover * n:
                    continue
                got = patience(window.tolist(), words.tolist())
                share = len(got) / n
                if share >= self.cover and (best is None or share > best[0]):
                    best = share, a + got[0][0], a + got[-1][0] + 1
            if not best:
                most, a, b = spread(text[held].tolist(), words.tolist())
                got = patience(text[held[a : b + 1]].tolist(), words.tolist()) if most >= self.cover * n else []
                breaks = sum(log2(q[0] - p[0]) for p, q in zip(got, got[1:]))
                if got and len(got) - breaks >= self.cover * n:
                    best = most / n, int(held[a]), int(held[b]) + 1
            if best:
                found[row].append((-round(best[0] * n), -best[0], k, *best))
        out = []
        for row, rows in found.items():
            kept: list = []
            for _, _, k, share, a, b in sorted(rows):
                if not any(x <= a and b <= y for *_, x, y in kept):
                    kept.append((row, k, share, a, b))
            out += kept
        return out


def license_notices(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, cover: float = COVER) -> DataFrame:
    """(doc_id, license, coverage, start_word, end_word): each notice that a document covers well enough."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(templates or TEMPLATES, cover))  # the templates' words

    def run(batches):
        for batch in batches:
            for part in C.slices(batch, "t"):
                got = scanner.value.scan(C.Tokens(part.column("t")))
                row, k, share, a, b = zip(*got) if got else ((), (), (), (), ())
                names = [scanner.value.names[i] for i in k]
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(row, pa.int64())), pa.array(names, pa.string()), pa.array(np.round(np.array(share, float), 4)), pa.array(a, pa.int32()), pa.array(b, pa.int32())], [key, "license", "coverage", "start_word", "end_word"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.lower(F.col(text)).alias("t")).where("t is not null").mapInArrow(run, f"{key} {kind}, license string, coverage double, start_word int, end_word int")
