"""License scans: MinHash bands over overlapping text windows, verified by shingle containment.

A text's 5-word shingles are covered by windows of 1, 2, 4, ... shingles that overlap: a window of L shingles starts every L / 4 (every
one up to 4), so each stretch of at most L - L / 4 + 1 shingles lies in one of them whole. A template is looked for in the shortest windows that
are long enough for it. A window's BANDS minima (one row each) retrieve templates that have the same minimum in the same band.

A window that holds the share LEAST of a template's n shingles has a resemblance of LEAST * n / (L + n - LEAST * n) or more, at least 0.257 for
LEAST = 0.75, since n > 3 / 8 L; so BANDS = 48 miss it with a probability below 1e-6. Retrieved templates are verified: the share of the template's distinct
shingles in each stretch of the template's length about the window decides, and of stretches that overlap the best one is reported.

Scale: one scan, no shuffle; templates are few and their bands a small fixed table in each task. Texts are scanned together in runs of about
RUN shingles; a long text costs time in proportion to its words and is cut into such runs too.

Defined results: null and empty texts and those of fewer than five words have no matches; overlapping stretches of one template are
one match, the best, then the first; repeated rows match alike; null doc_ids are kept; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import WordHashes, each, mix64

_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution."""
#: Texts of public licenses, their headers, and notices that name a license.
TEMPLATES = {
    "0bsd": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause": f"{_BSD}\n{_DISCLAIMER}",
    "bsd-3-clause": f"""{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission. {_DISCLAIMER}""",
    "boost-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the
"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor.""",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along
with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "gpl-3.0-preamble": """The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed
to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to
make sure it remains free software for all its users. We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies also to any other work
released this way by its authors. You can apply it to your programs, too.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This
notice may not be removed or altered from any source distribution.""",
}
WIDTH = 5
LEAST = 0.75
BANDS = 48
#: Shingles of texts that are scanned together.
RUN = 8192
_TOKENS = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.-][a-z0-9\x80-\xff]+)*").findall
_MULTIPLY = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64, BANDS, np.uint64) | np.uint64(1)
_NOTHING = np.uint32(0xFFFFFFFF)


def tokens_of(text: str | None) -> list[bytes]:
    return _TOKENS(text.encode("utf-8", "surrogatepass").lower()) if text else []


def _shingles(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows of WIDTH words, in order."""
    n = max(0, len(hashes) - WIDTH + 1)
    value = np.full(n, WIDTH, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WIDTH if n else 0):
            value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n + i])
    return value


def _hashed(values: np.ndarray) -> np.ndarray:
    """BANDS 32-bit hashes of each shingle."""
    with np.errstate(over="ignore"):
        return ((values[:, None] * _MULTIPLY) >> np.uint64(32)).astype(np.uint32)


def _step(level: int) -> int:
    """Windows of 2**level shingles start at multiples of this."""
    return max(1, 2**level // 4)


def level_of(n: int) -> int:
    """The level of the shortest windows of which one holds any n shingles in a row."""
    level = 0
    while n > 2**level - _step(level) + 1:
        level += 1
    return level


class Scanner:
    """Texts -> matches (template, first word, words, containment) of each."""

    def __init__(self, templates: dict[str, str], least: float = LEAST):
        self.least, self.hashes = least, WordHashes()
        self.names, self.size, self.index, self.levels = list(templates), [], [], {}
        for i, text in enumerate(templates.values()):
            values = _shingles(self.hashes.of(tokens_of(text)))
            if not len(values):
                raise ValueError(f"template {self.names[i]} has fewer than {WIDTH} words")
            self.size.append(len(values))
            self.index.append({v: k for k, v in enumerate(dict.fromkeys(values.tolist()))})
            keys = self.levels.setdefault(level_of(len(values)), {})
            for band, low in enumerate(_hashed(values).min(0).tolist()):
                keys.setdefault(band << 32 | low, []).append(i)
        self.sorted = {level: np.array(sorted(keys), np.uint64) for level, keys in self.levels.items()}
        self.rough = {}
        for level, keys in self.sorted.items():
            self.rough[level] = np.zeros(1 << 16, bool)
            self.rough[level][(keys & np.uint64(0xFFFFFFFF)) >> np.uint64(16)] = True

    def retrieved(self, values: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, start, stop) of windows of which a band has the template's minimum."""
        low, step, found = _hashed(values), 1, set()
        for level in range(max(self.levels) + 1):
            if level:
                # windows of 2**level from two of half the length; starts thin out with the step
                half = 2 ** (level - 1) // step
                pair = np.full_like(low, _NOTHING)
                pair[: max(0, len(low) - half)] = low[half:]
                thin = _step(level) // step
                low, step = np.minimum(low, pair)[::thin], _step(level)
            if level in self.levels:
                near = np.flatnonzero(self.rough[level][(low >> np.uint32(16)).ravel()])
                window, band = np.divmod(near, BANDS)
                key = band.astype(np.uint64) << np.uint64(32) | low.ravel()[near]
                keys = self.sorted[level]
                same = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                for w, k in zip(window[same].tolist(), key[same].tolist()):
                    found.update((i, w * step, w * step + 2**level) for i in self.levels[level][k])
        return found

    def verified(self, i: int, values: np.ndarray) -> list[tuple[int, float]]:
        """(start, containment) of the best stretches of a template's length, which don't overlap."""
        n, index = self.size[i], self.index[i]
        place = [index.get(v, -1) for v in values.tolist()]
        # distinct shingles of the template in each stretch, by moving it along
        have, share, distinct = [0] * len(index), [], 0
        for at, p in enumerate(place):
            if p >= 0:
                distinct += not have[p]
                have[p] += 1
            if at >= n and (gone := place[at - n]) >= 0:
                have[gone] -= 1
                distinct -= not have[gone]
            if at >= n - 1 or at == len(place) - 1:
                share.append((-distinct / len(index), max(0, at - n + 1)))
        out = []
        for part, start in sorted(set(share)):
            if -part < self.least:
                break
            if all(abs(start - other) >= n for other, _ in out):
                out.append((start, -part))
        return out

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """Matches of each text; short texts share runs, long ones are cut into runs that overlap."""
        out, run, size = [[] for _ in texts], [], 0
        for k, text in enumerate(texts):
            values = _shingles(self.hashes.of(tokens_of(text)))
            if len(values):
                run.append((k, values))
                size += len(values)
            if run and (size >= RUN or k == len(texts) - 1):
                self._scan_run(run, out)
                run, size = [], 0
        if run:
            self._scan_run(run, out)
        return out

    def _scan_run(self, run: list[tuple[int, np.ndarray]], out: list) -> None:
        starts = np.cumsum([0, *(len(v) for _, v in run)])
        values = np.concatenate([v for _, v in run])
        longest = 2 ** max(self.levels)
        spots: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for base in range(0, len(values), RUN):
            # a window that starts in a piece may end beyond it
            for i, a, b in self.retrieved(values[base : base + RUN + longest]):
                a, b = base + a, min(base + b, len(values))
                for d in range(int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left"))):
                    lo, hi = max(a, starts[d]), min(b, starts[d + 1])
                    if hi > lo:
                        n = self.size[i]
                        spots.setdefault((d, i), []).append((max(int(lo - starts[d]) - n, 0), min(int(hi - starts[d]) + n, len(run[d][1]))))
        for (d, i), regions in sorted(spots.items()):
            k, own = run[d]
            regions.sort()
            merged = [list(regions[0])]
            for a, b in regions[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                out[k] += [(self.names[i], a + start, self.size[i] + WIDTH - 1, part) for start, part in self.verified(i, own[a:b])]
        for k, _ in run:
            out[k].sort(key=lambda m: (m[1], m[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id and matches: array of (template, first word, words, containment)."""
    chosen = templates or TEMPLATES
    kind = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())]))

    def run(batches):
        scanner = Scanner(chosen, least)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, batch.num_rows, 500):
                found = [[dict(zip(("template", "first_word", "words", "containment"), m)) for m in matches] for matches in scanner.scan(list(each(texts.slice(at, 500))))]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 500), pa.array(found, kind)], ["doc_id", "matches"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, matches array<struct<template:string,first_word:long,words:long,containment:double>>")


def summarized(found: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses (distinct templates, in order), best containment, matches as text."""
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["template"])))
    lines = F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["first_word"].cast("string"), m["words"].cast("string")))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("containment"), F.array_join(lines, ",").alias("spans"))
