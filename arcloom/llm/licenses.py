"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

For a template of t shingles a text is cut into windows of at most 1.5 t, each at most a quarter
of t after the last, so some window holds any run of t shingles. If such a run contains 80 % of
the template, window and template have a similarity of 0.45 or more; with bands of one
minimum, 32 of them miss such a window with probability below 1e-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, load, mix, runs_hash, texts

SHINGLE, BANDS, LEAST = 5, 32, 0.8
#: Bytes of text scanned at once; a longer text is scanned by itself.
BLOCK = 1 << 20
WORD = re.compile(rb"[a-z0-9]+")

#: Shingles whose minima are held at once; a longer text goes through in parts that overlap by the widest window.
PART = 1 << 16
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

#: Public license texts, notices and grants, by identifier.
TEMPLATES = {
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. """
    + _AS_IS
    + """ IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "BSD-grant": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "GPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
}
_SEEDS = mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64))
_A, _B = _SEEDS[:BANDS].astype(np.uint32) | np.uint32(1), _SEEDS[BANDS:].astype(np.uint32)


def hashes(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(32)).astype(np.uint32)[:, None] * _A + _B


def shifted_minimum(m: np.ndarray, by: int) -> np.ndarray:
    """Of each row the minimum with the row `by` further on; at the end, rows stay as they are."""
    return np.concatenate([np.minimum(m[:-by], m[by:]), m[-by:]]) if by else m


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.cache = WordHashes()
        self.names = sorted(templates)
        self.sets = [np.unique(self.shingles(templates[x].encode())) for x in self.names]
        self.names = [x for x, s in zip(self.names, self.sets, strict=True) if len(s)]
        self.sets = [s for s in self.sets if len(s)]
        #: by template size: its templates, and for each band the minima to look up, sorted, with their templates
        self.groups: dict[int, tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]] = {}
        for t in sorted({len(s) for s in self.sets}):
            who = np.array([k for k, s in enumerate(self.sets) if len(s) == t])
            low = np.array([hashes(self.sets[k]).min(axis=0) for k in who])
            self.groups[t] = (who, low)

    def shingles(self, text: bytes) -> np.ndarray:
        return runs_hash(self.cache.of(WORD.findall(text.lower())), SHINGLE)

    def best(self, s: np.ndarray, template: int) -> tuple[int, int, int] | None:
        """(shingles matched, start, end in shingles) of the best run of at most 1.25 t shingles, the first and shortest."""
        t = len(self.sets[template])
        where = np.searchsorted(self.sets[template], s)
        where[where == t] = 0
        at = np.flatnonzero(self.sets[template][where] == s).tolist()
        longest, counts, left, top = max(1, int(1.25 * t)), {}, 0, None
        for right, p in enumerate(at):
            counts[where[p]] = counts.get(where[p], 0) + 1
            while at[left] <= p - longest or counts[where[at[left]]] > 1:
                counts[where[at[left]]] -= 1
                if not counts[where[at[left]]]:
                    del counts[where[at[left]]]
                left += 1
            if top is None or len(counts) > top[0]:
                top = (len(counts), at[left], p + 1)
        return top if top and top[0] >= LEAST * t else None

    def runs(self, s: np.ndarray, template: int) -> list[tuple[int, int, int]]:
        """(shingles matched, start, end in shingles) of each run as in `best` that reaches the containment; none overlap.

        A run is settled once no better window overlaps it, and the sweep restarts behind it; what it leaves before itself is swept again.
        """
        t = len(self.sets[template])
        where = np.searchsorted(self.sets[template], s)
        where[where == t] = 0
        places = np.flatnonzero(self.sets[template][where] == s).tolist()
        longest, out, parts = max(1, int(1.25 * t)), [], [places]
        while parts:
            at, counts, left, right, top, free = parts.pop(), {}, 0, 0, None, 0
            while right < len(at) or top:
                if right < len(at):
                    p = at[right]
                    counts[where[p]] = counts.get(where[p], 0) + 1
                    while at[left] <= p - longest or counts[where[at[left]]] > 1:
                        counts[where[at[left]]] -= 1
                        if not counts[where[at[left]]]:
                            del counts[where[at[left]]]
                        left += 1
                    if len(counts) >= LEAST * t and (top is None or len(counts) > top[0]):
                        top = (len(counts), left, right)
                    right += 1
                if top and (right >= len(at) or left > top[2] or top[0] == t):
                    out.append((top[0], at[top[1]], at[top[2]] + 1))
                    if top[1] - free >= LEAST * t:
                        parts.append(at[free : top[1]])
                    free = left = right = top[2] + 1
                    counts, top = {}, None
        return sorted(out, key=lambda x: x[1])

    def retrieved(self, s: np.ndarray, bounds: np.ndarray) -> dict[int, set[int]]:
        """For each template the texts (s[bounds[d]:bounds[d + 1]]) that have a window which agrees with it in some band."""
        found: dict[int, set[int]] = {}
        widest = 2 * max(self.groups, default=0) + 16
        for at in range(0, len(s), PART):
            h = hashes(s[at : at + PART + widest])
            blocks, sliding = {1: h}, {}  # minima of blocks of q shingles; of 2**n neighbouring blocks
            for t, (who, low) in self.groups.items():
                q = 1 << (max(1, t // 4).bit_length() - 1)
                while q not in blocks:
                    top = max(blocks)
                    blocks[2 * top] = np.minimum.reduceat(blocks[top], np.arange(0, len(blocks[top]), 2), axis=0)
                wide = 1 if t == 1 else -(-t // q) + 1
                n = min(wide, len(blocks[q])).bit_length() - 1
                for j in range(n + 1):
                    if (q, j) not in sliding:
                        sliding[q, j] = shifted_minimum(sliding[q, j - 1], 1 << (j - 1)) if j else blocks[q]
                m = shifted_minimum(sliding[q, n], min(wide, len(blocks[q])) - (1 << n))
                for k, row in zip(who, low, strict=True):
                    windows = np.flatnonzero((m == row).any(axis=1))
                    # a window may begin in a text before the one that holds the match
                    first, last = windows * q + at, np.minimum(windows * q + wide * q, len(h)) - 1 + at
                    for a, b in set(zip(*((np.searchsorted(bounds, x, side="right") - 1).tolist() for x in (first, last)), strict=True)):
                        found.setdefault(int(k), set()).update(range(a, b + 1))
        return found

    def scan(self, docs: list[bytes]) -> list[list[dict]]:
        """Matches of each text: template, start, end (words), containment."""
        each = [self.shingles(d) for d in docs]
        bounds = np.concatenate(([0], np.cumsum([len(s) for s in each])))
        out: list[list[dict]] = [[] for _ in docs]
        if not bounds[-1]:
            return out
        for k, owners in self.retrieved(np.concatenate(each), bounds).items():
            for d in owners:
                for n, start, end in self.runs(each[d], k):
                    out[d].append({"template": self.names[k], "start": start, "end": end + SHINGLE - 1, "containment": n / len(self.sets[k])})
        return [sorted(x, key=lambda y: (y["start"], y["template"])) for x in out]


MATCH = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Adds `licenses`: array of (template, start, end, containment), one for each place where a template occurs.

    Places are in words (runs of a-z and 0-9, lower-cased); of runs that overlap the best
    is given, of equal ones the first. A template of fewer than 5 words never occurs; null and short texts have
    none; every row and its columns stay (one named licenses is replaced).
    """
    templates = TEMPLATES if templates is None else templates
    kept = docs.drop("licenses")

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            found, block, size = [], [], 0
            for d in texts(batch):
                if block and size + len(d) > BLOCK:
                    found += scanner.scan(block)
                    block, size = [], 0
                block.append(d)
                size += len(d)
            found += scanner.scan(block) if block else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, MATCH)], [*batch.schema.names, "licenses"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(batches_of, ", ".join([*fields, "licenses array<struct<template:string,start:int,end:int,containment:double>>"]))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(load(spark, sf_dir, "documents").select("doc_id", "text"))
    said = F.transform("licenses", lambda x: F.concat_ws(":", x["template"], x["start"], x["end"], F.format_number(x["containment"], 4)))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(said, ",").alias("licenses"))
