"""License scans by conditional compression.

A candidate block (words around licensing words, over line and sentence ends) is compressed with zstandard alone and
with each template as raw dictionary; templates are ranked by how much they save.  All are confirmed by exact wording
differences: the words that a stretch of the block lacks or has beyond a template's wording.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from swellworks.llm.runtime import map_slices, utf8

#: Templates: fixed values, the public wording of notices and license texts.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Words of which a candidate block has one, lower case.
TRIGGERS = ("licens", "licenc", "copyright", "redistribut", "hereby granted", "public domain", "creative commons", "cc by", "source code form")
_TRIGGER = re.compile("|".join(map(re.escape, TRIGGERS)))
_TURN = r"-[ \t]*\r?\n[\s#*/;]*"  # a hyphen at a line's end, and the comment signs before the next
_WORD = re.compile(rf"\w+(?:(?:[-.]|{_TURN})\w+)*")
_TURN = re.compile(_TURN)
_VERSION = re.compile(r"\d+(?:\.\d+)*")
MAX_DIFFERENCE = 0.2  # of a template's words


def words(text: str) -> list[str]:
    """Lower-case words; inner dots and hyphens count (2.0, BY-NC), over a line's end as well."""
    return [_TURN.sub("-", w) for w in _WORD.findall(text.lower())]


@dataclass(frozen=True)
class Match:
    license: str
    line: int  # of its first word
    saved: float  # share of the block's compressed size that the template saves
    missing: tuple[str, ...]
    extra: tuple[str, ...]


@functools.cache
def _templates() -> tuple[tuple[str, list[str], bytes, object, tuple[tuple[str, int], ...]], ...]:
    made = []
    for name, text in TEMPLATES.items():
        w = words(text)
        raw = " ".join(w).encode()
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append((name, w, raw, zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False), tuple(Counter(w).items())))
    return tuple(made)


@functools.cache
def _plain() -> object:
    return zstandard.ZstdCompressor(level=3, write_content_size=False)


@functools.cache
def _longest() -> int:
    """Words of the longest stretch that can still be confirmed."""
    return int((1 + MAX_DIFFERENCE) * max(len(t[1]) for t in _templates())) + 1


def blocks(text: str) -> list[tuple[int, list[str], list[int]]]:
    """(first word's number, words, their lines): all words as near to a licensing word as a confirmed stretch may reach.

    Neither line ends, empty lines and comment signs nor sentence ends part a block; blocks that touch are one.
    """
    low = text.lower()
    spans = [m.span() for m in _WORD.finditer(low)]
    w = [_TURN.sub("-", low[a:b]) for a, b in spans]
    starts = np.cumsum([0] + [len(x) + 1 for x in w])
    hits = np.searchsorted(starts, [m.start() for m in _TRIGGER.finditer(" ".join(w))], "right") - 1
    ends = np.array([i for i, c in enumerate(low) if c == "\n"], np.int64)
    out: list[list[int]] = []
    for h in hits.tolist():
        a, b = max(0, h - _longest()), min(len(w), h + _longest() + 1)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, w[a:b], np.searchsorted(ends, [x for x, _ in spans[a:b]]).tolist()) for a, b in out]


def stretches(template: list[str], block: list[str], most: float) -> list[tuple[int, int]]:
    """(start, end) of the block's stretches that differ from the template by ``most`` of its words at the most.

    Words missing and words in between count one each, exactly (short templates may miss none); the best stretch comes
    first, those that overlap a better one are left out.
    """
    n, m = len(block), len(template)
    one, gap = 1 << 32, (1 << 32) * (m + n if m <= 8 else 1)
    at = np.arange(n + 1, dtype=np.int64)
    number = {x: i for i, x in enumerate(dict.fromkeys(template))}
    ids = np.array([number.get(x, -1) for x in block], np.int64)
    cost = n - at  # differences << 32 | words from the start of the stretch to the block's end: of equals the shortest
    for x in template:
        now = cost + gap
        now[1:] = np.minimum(now[1:], np.where(ids == number[x], cost[:-1], now[1:]))
        cost = np.minimum.accumulate(now - at * one) + at * one
    found: list[tuple[int, int]] = []
    good = np.flatnonzero(cost >> 32 <= most * m)
    for b in good[np.lexsort((good, cost[good] >> 32))].tolist():
        a = n - int(cost[b] & one - 1)
        if all(b <= x or y <= a for x, y in found):
            found.append((a, b))
    return found


def difference(template: list[str], stretch: list[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(words the stretch lacks, words it has in between), as few as possible."""
    n, m = len(stretch), len(template)
    common = [[0] * (m + 1) for _ in range(n + 1)]  # longest common subsequence of what follows
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            common[i][j] = common[i + 1][j + 1] + 1 if stretch[i] == template[j] else max(common[i + 1][j], common[i][j + 1])
    missing, extra, i, j = [], [], 0, 0
    while i < n or j < m:
        if i < n and j < m and stretch[i] == template[j]:
            i, j = i + 1, j + 1
        elif j < m and (i == n or common[i][j + 1] >= common[i + 1][j]):
            missing.append(template[j])
            j += 1
        else:
            extra.append(stretch[i])
            i += 1
    return tuple(missing), tuple(extra)


def classify(block: list[str], most: float = MAX_DIFFERENCE) -> list[tuple[str, float, tuple[str, ...], tuple[str, ...], int]]:
    """(license, saved, missing, extra, start) of each confirmed stretch, in their order; of kindred templates on one stretch the closest counts.

    Every template that has enough words in the block is confirmed, in order of what it saves.  A version number that
    the stretch lacks makes it another license.
    """
    held = Counter(block)
    able = [t for t in _templates() if sum(min(c, held[x]) for x, c in t[4]) >= (1 - most if len(t[1]) > 8 else 1) * len(t[1])]
    raw = " ".join(block).encode() if able else b""
    alone = max(1, len(_plain().compress(raw))) if able else 1
    found = []
    for saved, name, template in sorted(((1 - len(t[3].compress(raw)) / alone, t[0], t[1]) for t in able), key=lambda x: (-x[0], x[1])):
        for a, b in stretches(template, block, most):
            missing, extra = difference(template, block[a:b]) if block[a:b] != template else ((), ())
            if not any(_VERSION.fullmatch(x) for x in set(missing) - set(block[a:b])):
                found.append((name, round(saved, 4), missing, extra, a, b, (len(missing) + len(extra)) / len(template)))
    over = lambda f, g: f is not g and f[4] < g[5] and g[4] < f[5]
    kept = [f for f in found if not any(over(f, g) and (f[6] > g[6] and _kin(f[0], g[0]) or f[0] == g[0] + "-notice") for g in found)]
    return [f[:5] for f in sorted(kept, key=lambda f: f[4])]


@functools.cache
def _kin(a: str, b: str) -> bool:
    """Whether two templates share so much wording that a block can't mean both at once."""
    x, y = set(words(TEMPLATES[a])), set(words(TEMPLATES[b]))
    return len(x & y) >= 0.5 * min(len(x), len(y))


def scan(text: str | None) -> list[Match]:
    """Confirmed licenses of a text, in the order they stand; of several on one line each license counts once."""
    return matches(blocks(text or ""))


def matches(parts: list[tuple[int, list[str], list[int]]]) -> list[Match]:
    found: dict[tuple[str, int], Match] = {}
    for _, block, lines in parts:
        for name, saved, missing, extra, start in classify(block):
            found.setdefault((name, lines[start]), Match(name, lines[start], saved, missing, extra))
    return list(found.values())


def may_hold(text: Column) -> Column:
    """A JVM-side sieve: whether a licensing word occurs at all."""
    low, on = F.lower(text), F.lit(False)
    for t in TRIGGERS:
        on = on | low.contains(t)
    return on


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_blocks, n_matches, licenses array<string>, first_lines array<int>, n_missing, n_extra) of every row.

    Licenses are distinct and sorted; first_lines has the first line of each.  n_missing and n_extra sum the wording
    differences of all matches.  Null and empty texts have no match; repeated rows stay rows; an empty table gives an
    empty result; a text of any length is scanned whole; other columns are ignored.
    """
    rows = docs.select("doc_id", F.when(may_hold(F.col("text")), F.col("text")).alias("text"))

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = utf8(piece.column(1))
        n = piece.num_rows
        found, lines, counts = [[] for _ in range(n)], [[] for _ in range(n)], np.zeros((4, n), np.int32)
        for k in np.flatnonzero(np.diff(offs)).tolist():
            text = buf[offs[k] : offs[k + 1]].tobytes().decode("utf-8")
            parts, first = blocks(text), {}
            got = matches(parts)
            for m in got:
                first.setdefault(m.license, m.line)
            found[k], lines[k] = sorted(first), [first[x] for x in sorted(first)]
            counts[:, k] = len(parts), len(got), sum(len(m.missing) for m in got), sum(len(m.extra) for m in got)
        b, m, x, y = (pa.array(c) for c in counts)
        return pa.record_batch([piece.column(0), b, m, pa.array(found, pa.list_(pa.string())), pa.array(lines, pa.list_(pa.int32())), x, y], ["doc_id", "n_blocks", "n_matches", "licenses", "first_lines", "n_missing", "n_extra"])

    return map_slices(rows, "text", work, "doc_id long, n_blocks int, n_matches int, licenses array<string>, first_lines array<int>, n_missing int, n_extra int")
