"""Licence scans by a generalised suffix automaton (operator 10).

The automaton holds the word sequences of all licence templates and phrases.  A file streams through it and
gives matching statistics: at each word, the longest run ending there that occurs in any template.  Phrases
are read off the suffix links; long maximal matches become anchors, which are chained by template (both
positions rising, small gaps) into covered spans.  A template labels a file where a chain covers enough of it.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased: ASCII letters and digits, and all beyond ASCII.
Defined results: null or empty texts have no words, no places and empty labels; ties between chains go to the
earlier span; repeated rows and null ids are scanned like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that label a file by themselves.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Sections of public licence texts and notices, as their publishers word them.  Each section is a template of
#: its own, so that coverage is by section: MIT, BSD (2 and 3 clauses), ISC, zlib, Boost's grant and the Unlicense's dedication are whole; of Apache
#: the grants, trademarks and disclaimer, of GPL-3 the disclaimers; besides them standard headers and one-line notices.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mit", "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/"),
    ("apache-2", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("apache-2", "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work, where such license applies only to those patent claims licensable by such Contributor that are necessarily infringed by their Contribution(s) alone or by combination of their Contribution(s) with the Work to which such Contribution(s) was submitted."),
    ("apache-2", "Trademarks. This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file."),
    ("apache-2", "Disclaimer of Warranty. Unless required by applicable law or agreed to in writing, Licensor provides the Work (and each Contributor provides its Contributions) on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied, including, without limitation, any warranties or conditions of TITLE, NON-INFRINGEMENT, MERCHANTABILITY, or FITNESS FOR A PARTICULAR PURPOSE. You are solely responsible for determining the appropriateness of using or redistributing the Work and assume any risks associated with Your exercise of permissions under this License."),
    ("gpl-3", "THERE IS NO WARRANTY FOR THE PROGRAM, TO THE EXTENT PERMITTED BY APPLICABLE LAW. EXCEPT WHEN OTHERWISE STATED IN WRITING THE COPYRIGHT HOLDERS AND/OR OTHER PARTIES PROVIDE THE PROGRAM AS IS WITHOUT WARRANTY OF ANY KIND, EITHER EXPRESSED OR IMPLIED, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE ENTIRE RISK AS TO THE QUALITY AND PERFORMANCE OF THE PROGRAM IS WITH YOU. SHOULD THE PROGRAM PROVE DEFECTIVE, YOU ASSUME THE COST OF ALL NECESSARY SERVICING, REPAIR OR CORRECTION."),
    ("gpl-3", "IN NO EVENT UNLESS REQUIRED BY APPLICABLE LAW OR AGREED TO IN WRITING WILL ANY COPYRIGHT HOLDER, OR ANY OTHER PARTY WHO MODIFIES AND/OR CONVEYS THE PROGRAM AS PERMITTED ABOVE, BE LIABLE TO YOU FOR DAMAGES, INCLUDING ANY GENERAL, SPECIAL, INCIDENTAL OR CONSEQUENTIAL DAMAGES ARISING OUT OF THE USE OR INABILITY TO USE THE PROGRAM"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl-2", "licensed under the GNU General Public License version 2"),
    ("gpl-3", "licensed under the GNU General Public License version 3"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("lgpl-2.1", "licensed under the GNU Lesser General Public License version 2.1"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License version 3"),
    ("agpl-3", "licensed under the GNU Affero General Public License version 3"),
    ("mpl-2", "licensed under the Mozilla Public License version 2.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
)

SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,coverage:double>>"
_KEPT = set(range(48, 58)) | set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))
_TABLE = bytes((i + 32 if 65 <= i <= 90 else i) if i in _KEPT else 32 for i in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """A generalised suffix automaton of word sequences; state 0 is the root."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.length = [{}], [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, seq in enumerate(sequences):
            last = 0
            for pos, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].add((k, pos))
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]] |= self.ends[v] if self.link[v] else set()

    def _state(self, nxt: dict, link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state for the longest string of ``p`` plus ``c``; a longer one's state is split."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        cur, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, c)
        return cur

    def stream(self, codes: list[int]):
        """Matching statistics: (state, length) after each word."""
        v, n, nxt, link, length = 0, 0, self.next, self.link, self.length
        for c in codes:
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v, n = nxt[v][c], n + 1
            else:
                v, n = 0, 0
            yield v, n


@dataclass
class Span:
    label: str
    start: int
    end: int
    covered: int
    coverage: float


def nearest(spans: list[Span]) -> list[Span]:
    """Without spans that lie mostly inside one of another licence that matches more words there (versions differ in few words)."""
    by_start, out = sorted(spans, key=lambda s: s.start), []
    longest = max((s.end - s.start for s in spans), default=0)
    starts = [s.start for s in by_start]
    for s in spans:
        rivals = by_start[bisect_left(starts, s.start - longest) : bisect_left(starts, s.end)]
        if not any(t.label != s.label and 2 * (min(s.end, t.end) - max(s.start, t.start)) > s.end - s.start and (t.covered, t.coverage) > (s.covered, s.coverage) for t in rivals):
            out.append(s)
    return out


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match: int = 4, max_gap: int = 12, min_coverage: float = 0.6):
        self.labels = [label for label, _ in templates] + [label for _, label in phrases]
        seqs = [words(t) for _, t in templates] + [words(p) for p, _ in phrases]
        self.codes = {w: i for i, w in enumerate(dict.fromkeys(w for s in seqs for w in s))}
        self.sequences = [[self.codes[w] for w in s] for s in seqs]
        self.automaton = Automaton(self.sequences)
        self.n_templates, self.min_match, self.max_gap, self.min_coverage = len(templates), min_match, max_gap, min_coverage
        self.shortest = min([min_match, *(len(s) for s in self.sequences[self.n_templates :])])
        ended = {}  # state -> phrases that are suffixes of it
        for k in range(self.n_templates, len(seqs)):
            v = 0
            for c in self.sequences[k]:
                v = self.automaton.next[v][c]
            ended.setdefault(v, []).append(k)
        self.suffixes = []
        for v in range(len(self.automaton.next)):
            here, u = [], v
            while u > 0:
                here += ended.get(u, [])
                u = self.automaton.link[u]
            self.suffixes.append([(len(self.sequences[k]), k) for k in here])

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], list[Span]]:
        """Places (start, sequence) of phrases, and the spans that chains cover."""
        places, anchors = [], []
        get = self.codes.get
        codes = np.fromiter((get(w, -1) for w in ws), "i4", len(ws))
        known = np.flatnonzero(np.diff(np.concatenate([[0], codes >= 0, [0]]).astype("i1")))
        for a, b in known.reshape(-1, 2).tolist():
            if b - a < self.shortest:
                continue
            v0, n0 = 0, 0
            for i, (v, n) in enumerate(self.automaton.stream(codes[a:b].tolist()), a):
                for k, s in self.suffixes[v]:
                    if k <= n:
                        places.append((i - k + 1, s))
                if n <= n0 and n0 >= self.min_match:
                    anchors.append((i, n0, v0))
                v0, n0 = v, n
            if n0 >= self.min_match:
                anchors.append((b, n0, v0))
        return places, self._chains(anchors)

    def _chains(self, anchors: list[tuple[int, int, int]]) -> list[Span]:
        """Anchors (end, length, state), by end: each extends the open chain of its template that ends nearest before it."""
        open_, done = {}, []  # template -> [start, end, template position, covered]
        for end, n, v in anchors:
            for k, pos in sorted(self.automaton.ends[v]):
                if k >= self.n_templates:
                    continue
                start, first = end - n, pos - n + 1
                c = open_.get(k)
                if c and end > c[1] and pos > c[2] and start - c[1] <= self.max_gap and first - c[2] - 1 <= 4 * self.max_gap:
                    c[3] += min(n, end - c[1], pos - c[2])
                    c[1], c[2] = end, pos
                elif not c or start >= c[1]:
                    if c:
                        done.append((k, c))
                    open_[k] = [start, end, pos, n]
        done += open_.items()
        spans = [Span(self.labels[k], c[0], c[1], c[3], c[3] / len(self.sequences[k])) for k, c in done]
        return sorted(nearest([s for s in spans if s.coverage >= self.min_coverage]), key=lambda s: (s.start, s.label, s.end))

    def row(self, text: str | None) -> tuple:
        ws = words(text)
        places, spans = self.scan(ws)
        starts = [p for p, _ in places]
        base = sorted({self.labels[k] for _, k in places})
        labels = sorted({*base, *(s.label for s in spans)})
        score = 1.0 if base else max((min(1.0, s.coverage) for s in spans), default=0.0)
        return (len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score,
                [{"label": s.label, "start": s.start, "end": s.end, "coverage": min(1.0, s.coverage)} for s in spans])


@lru_cache(maxsize=4)
def _scanner(templates, phrases) -> Scanner:
    return Scanner(templates, phrases)


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Every document's phrases, labels, score and covered spans (word positions from 0, ends exclusive).  No shuffle."""

    def rows(batches):
        s = _scanner(templates, phrases)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))]
        for b in batches:
            cols = list(zip(*(s.row(t) for t in b.column(1).to_pylist()))) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, SCAN)
