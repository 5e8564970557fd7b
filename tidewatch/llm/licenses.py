"""License scans by patience alignment against license texts and notices."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_schema, in_arrow, with_row_id

#: Share of a template's words that must be aligned; window slack as a share of the template and in words.
COVERAGE, SLACK, SLACK_WORDS = 0.8, 0.25, 6
#: Words from which on a template may differ by the whole share; a shorter one by less, a notice not at all.
WHOLE = 50
#: Words that may come or go freely.
FILLERS = frozenset("a an and conditions of terms the".split())
#: Words that tell licenses apart: neither missing from a match nor added to it. Nor may a number be missing.
MARKS = frozenset("affero lesser library nc nd noncommercial noderivatives noderivs sa sharealike".split())

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
    "other materials provided with the distribution."
)
# Public license texts and notices, by SPDX name.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    *(
        (f"{short}-{v}-or-later", f"{what} is free software: you can redistribute it and/or modify it under the terms of "
        f"the GNU {kind}General Public License as published by the Free Software Foundation, either version {v.removesuffix('.0')} of the "
        f"License, or (at your option) any later version. {what} is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the GNU {kind}General Public License for more details.")
        for short, kind, what, v in [
            ("GPL", "", "This program", "3.0"), ("GPL", "", "This program", "2.0"),
            ("LGPL", "Lesser ", "This library", "3.0"), ("LGPL", "Lesser ", "This library", "2.1"),
            ("AGPL", "Affero ", "This program", "3.0"),
        ]
    ),
    *(
        (f"{short}-{v}-{end}", f"licensed under the GNU {kind}General Public License, version {v.removesuffix('.0')}{more}.")
        for short, kind, v in [
            ("GPL", "", "3.0"), ("GPL", "", "2.0"), ("LGPL", "Lesser ", "3.0"), ("LGPL", "Lesser ", "2.1"),
            ("AGPL", "Affero ", "3.0"),
        ]
        for end, more in [("only", ""), ("or-later", " or any later version"), ("or-later", " or later")]
    ),
    ("EUPL-1.2", "Licensed under the EUPL license."),
    ("EUPL-1.2", "Licensed under the EUPL."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    *(
        (f"CC-BY-{short}-4.0", f"This work is licensed under a Creative Commons Attribution-{long} 4.0 International License.")
        for short, long in [
            ("ND", "NoDerivatives"), ("NC-SA", "NonCommercial-ShareAlike"), ("NC-ND", "NonCommercial-NoDerivatives"),
        ]
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("BSD-2-Clause", _BSD),
    (
        "BSD-3-Clause",
        _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORD.findall(text.lower())


def patience(left: list[str], right: list[str], head: bool = True, tail: bool = True) -> list[tuple[int, int]]:
    """Aligned positions of two word lists, in order.

    Equal ends are matched first; then words unique to both sides are anchors, the longest increasing
    subsequence of them stands, and each gap between anchors is aligned in the same way. Without
    ``head`` or ``tail`` the lists go on beyond that end, so equal words there mean nothing.
    """
    pairs, todo = [], [(0, len(left), 0, len(right), head, tail)]
    while todo:
        alo, ahi, blo, bhi, head, tail = todo.pop()
        while head and alo < ahi and blo < bhi and left[alo] == right[blo]:
            pairs.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while tail and alo < ahi and blo < bhi and left[ahi - 1] == right[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            pairs.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        in_left, in_right = Counter(left[alo:ahi]), Counter(right[blo:bhi])
        place = {right[j]: j for j in range(blo, bhi) if in_right[right[j]] == 1}
        anchors = [(i, place[left[i]]) for i in range(alo, ahi) if in_left[left[i]] == 1 and left[i] in place]
        ends: list[int] = []
        rows: list[tuple[tuple[int, int], int]] = []
        last: list[int] = []
        for i, j in anchors:
            k = bisect_left(ends, j)
            rows.append(((i, j), last[k - 1] if k else -1))
            ends[k : k + 1], last[k : k + 1] = [j], [len(rows) - 1]
        if not last:
            continue
        chain, at = [], last[-1]
        while at >= 0:
            chain.append(rows[at][0])
            at = rows[at][1]
        edge_a, edge_b = alo, blo
        for i, j in reversed(chain):
            pairs.append((i, j))
            todo.append((edge_a, i, edge_b, j, head or edge_a > alo, True))
            edge_a, edge_b = i + 1, j + 1
        todo.append((edge_a, ahi, edge_b, bhi, True, tail))
    return sorted(pairs)


class Scanner:
    """Finds templates in texts: alignments that grow out from a template's key words, and are measured.

    A template has one key more than it may miss words, so every match holds a key. Keys are words
    that few templates and rarely prose has: fewest templates, then the longest.
    """

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE):
        self.templates = [(name, words(text)) for name, text in templates]
        held = Counter(w for _, body in self.templates for w in set(body))
        self.keys: dict[str, list[tuple[int, int]]] = {}
        self.costs, self.spare = [], []
        for k, (_, body) in enumerate(self.templates):
            n = len(body)
            self.spare.append(int((1 - coverage) * n * min(1.0, n / WHOLE) + 1e-9))
            self.costs.append(Counter(w for w in body if w not in FILLERS))
            rare = sorted(self.costs[k] or set(body), key=lambda w: (held[w] > 4, -len(w), w))[: self.spare[k] + 1]
            for w in rare:
                self.keys.setdefault(w, []).extend((k, o) for o, x in enumerate(body) if x == w)
        self.probe = tuple(self.keys)

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(name, first word, words, coverage) of each match, by place; of overlaps the one with most aligned stays."""
        low = text.lower()
        if not any(p in low for p in self.probe):
            return []
        body = words(text)
        # Where a template would start, and the keys that say so.
        starts: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for at, w in enumerate(body):
            for k, offset in self.keys.get(w, ()):
                starts.setdefault((k, at - offset), []).append((at, offset))
        queue: list[tuple] = []
        for (k, _), keys in starts.items():
            for at, offset in keys:
                if self._offer(queue, k, at, offset, body, 0, len(body)):
                    break
        kept: list[tuple[int, int, str, float]] = []
        while queue:
            _, share, first, last, name, k, at, offset = heappop(queue)
            n = bisect_left(kept, (at + 1,))
            low, high = kept[n - 1][1] + 1 if n else 0, kept[n][0] if n < len(kept) else len(body)
            if low <= first and last < high:
                insort(kept, (first, last, name, -share))
            elif low <= at:
                # Part of it belongs to a better match: try what is left around the key.
                self._offer(queue, k, at, offset, body, low, high)
        return [(name, a, b - a + 1, share) for a, b, name, share in kept]

    def _offer(self, queue: list, k: int, at: int, offset: int, body: list[str], low: int, high: int) -> bool:
        """Put the match of template ``k`` around a key between two places into the queue, if there is one."""
        match = self._match(k, at, offset, body, low, high)
        if match:
            share, n, first, last = match
            heappush(queue, (-share * n, -share, first, last, self.templates[k][0], k, at, offset))
        return match is not None

    def _match(
        self, k: int, at: int, offset: int, body: list[str], low: int, high: int
    ) -> tuple[float, int, int, int] | None:
        """Coverage, aligned words, first and last place of template ``k`` whose key ``offset`` is at ``at``.

        Both sides are aligned from the key outwards. Coverage is the aligned share of the longer of
        both, the template and the stretch.
        """
        template, spare, costs = self.templates[k][1], self.spare[k], self.costs[k]
        slack = int(SLACK * len(template)) + SLACK_WORDS
        lo, hi = max(low, at - offset - slack), min(high, at - offset + len(template) + slack)
        there = Counter(w for w in body[lo:hi] if w in costs)
        if sum((costs - there).values()) > spare:
            return None
        before = patience(template[:offset], body[lo:at], head=False)
        after = patience(template[offset + 1 :], body[at + 1 : hi], tail=False)
        pairs = [(i, lo + j) for i, j in before] + [(offset, at)] + [(offset + 1 + i, at + 1 + j) for i, j in after]
        # A word aligned far off at an end would stretch the match: leave it if that aligns more closely.
        while len(pairs) > 1:
            gaps = pairs[1][1] - pairs[0][1] - 1, pairs[-1][1] - pairs[-2][1] - 1
            if max(gaps) == 0 or max(gaps) <= spare:
                break
            pairs = pairs[1:] if gaps[0] >= gaps[1] else pairs[:-1]
        aligned, taken = {i for i, _ in pairs}, {j for _, j in pairs}
        first, last = pairs[0][1], pairs[-1][1]
        missing = [w for i, w in enumerate(template) if i not in aligned and w not in FILLERS]
        added = [body[j] for j in range(first, last + 1) if j not in taken and body[j] not in FILLERS]
        if max(len(missing), len(added)) > spare or any(w in MARKS or w.isdigit() for w in missing):
            return None
        if any(w in MARKS for w in added):
            return None
        return len(pairs) / max(len(template), last - first + 1), len(pairs), first, last


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: _rid, doc_id, matches (license, start, words, coverage).

    Start and words count runs of letters and digits of the whole text. Null and empty texts match
    nothing; repeated rows match alike; of templates that overlap in a text the one with the larger
    product of aligned words and coverage stays. Short notices match only whole, fillers apart.
    """
    schema = "_rid long, doc_id long, matches array<struct<license: string, start: long, words: long, coverage: double>>"
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, names = Scanner(templates).scan, ("license", "start", "words", "coverage")
        for b in batches:
            got = [[dict(zip(names, m)) for m in find(x.as_py() or "")] for x in b.column("_text")]
            columns = [b.column("_rid"), b.column("doc_id"), pa.array(got, kind.field("matches").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    rows = with_row_id(docs.select(F.col("doc_id").cast("long"), F.col(text).alias("_text")))
    return rows.select("_rid", "doc_id", "_text").transform(in_arrow, run, schema)
