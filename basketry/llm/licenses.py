"""License scans by patience alignment of a text's passages with license templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import raw_texts

# fixed values: license statements and the opening passages of license texts, as published
TEMPLATES = {
    "MIT-statement": "Released under the MIT License.",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-statement": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
}
# fixed values: words too common in prose to point at a license
COMMON = frozenset("either following including limitation person please provided should through whether within without".split())
COVERAGE = 0.8
_EDGES = re.compile(r"^\W+|\W+$")


def normal(words: Sequence[str]) -> list[str]:
    """Words in lower case without punctuation at their edges."""
    return [_EDGES.sub("", w).lower() for w in words]


def increasing(positions: Sequence[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(positions)
    for i, p in enumerate(positions):
        k = bisect_left(tops, p)
        if k == len(tops):
            tops.append(p)
            at.append(i)
        else:
            tops[k], at[k] = p, i
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(text: Sequence[str], template: Sequence[str]) -> list[tuple[int, int]]:
    """Matched (text position, template position) pairs, increasing in both.

    Equal ends of both sides match; then words that each side has once are anchors, a longest increasing run of them is kept, and the
    gaps between are aligned the same way. A gap without anchors gives no more matches.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            pairs.append((b - 1, d - 1))
            b, d = b - 1, d - 1
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(text[a:b], a) if here[w] == 1}
        anchors = [(place[w], j) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in place]
        kept = [anchors[k] for k in increasing([x for x, _ in anchors])]
        if not kept:
            continue
        for i, j in kept:
            todo.append((a, i, c, j))
            pairs.append((i, j))
            a, c = i + 1, j + 1
        todo.append((a, b, c, d))
    return sorted(pairs)


class Scanner:
    """Looks for templates in whole texts. Passages around the words that point at a template are aligned, window by window."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {name: normal(text.split()) for name, text in templates.items()}
        # words that point at a template: long ones, and short ones that it writes in capitals
        self.pointers: dict[str, list[str]] = {}
        self.needed: dict[str, int] = {}
        for name, words in self.templates.items():
            marked = {w for w, raw in zip(words, templates[name].split(), strict=True) if len(w) > 5 or len(w) > 1 and raw.isupper()}
            own = (marked - COMMON) or set(words)
            for w in own:
                self.pointers.setdefault(w, []).append(name)
            # a passage that covers enough of the template lacks no more words than this
            self.needed[name] = max(1, len(own) - int((1 - coverage) * len(words) + 1e-9))
        self._plain: dict[bytes, str] = {}

    def _words(self, text: bytes) -> list[str]:
        raws, plain = text.split(), self._plain
        if len(plain) > 300_000:
            plain.clear()
        for raw in {x for x in raws if x not in plain}:
            plain[raw] = _EDGES.sub("", raw.decode()).lower()
        return [plain[r] for r in raws]

    def scan(self, text: bytes | None) -> list[tuple[str, int, int, int, int]]:
        """(license, first word, word behind the last, matched words, template words), best passages first, not overlapping."""
        words = self._words(text or b"")
        here = self.pointers.keys() & set(words)
        if not here:
            return []
        hits: dict[str, list[tuple[int, str]]] = {}
        for i, w in enumerate(words):
            if w in here:
                for name in self.pointers[w]:
                    hits.setdefault(name, []).append((i, w))
        found = []
        for name, at in hits.items():
            template, need = self.templates[name], self.needed[name]
            m, done, ahead, seen = len(template), -1, 0, Counter()
            for p, w in at:
                while ahead < len(at) and at[ahead][0] < p + 2 * m:
                    seen[at[ahead][1]] += 1
                    ahead += 1
                # one alignment for the passages that begin in the same half template
                if len(seen) >= need and p >= done:
                    start, end, done = max(0, p - m), min(len(words), p + 2 * m), p + max(1, m // 2)
                    pairs = _tightest(patience(words[start:end], template), m)
                    if len(pairs) >= self.coverage * m:
                        found.append((name, start + pairs[0][0], start + pairs[-1][0] + 1, len(pairs), m))
                seen[w] -= 1
                if not seen[w]:
                    del seen[w]
        found.sort(key=lambda x: (-x[3] / x[4], -x[4], x[1], x[0]))
        kept: list[tuple[str, int, int, int, int]] = []
        for x in found:
            if all(x[2] <= y[1] or x[1] >= y[2] or x[0] != y[0] for y in kept):
                kept.append(x)
        return kept


def _tightest(pairs: list[tuple[int, int]], m: int) -> list[tuple[int, int]]:
    """Pairs within a stretch of twice the template's words, the one with most pairs: stray matches far off don't count."""
    best: list[tuple[int, int]] = []
    j = 0
    for i in range(len(pairs)):
        while j < len(pairs) and pairs[j][0] < pairs[i][0] + 2 * m:
            j += 1
        if j - i > len(best):
            best = pairs[i:j]
    return best


def scan(docs: DataFrame, coverage: float = COVERAGE, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, start_word, end_word, matched, template_words, coverage): passages that cover `coverage` of a template.

    Passages of the same license don't overlap; of overlapping ones the best covered stays. Null and empty texts hold none; every row of a
    repeated doc_id is scanned; other columns are ignored.
    """
    chosen = templates or TEMPLATES

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage)
        for part in parts:
            rows = [(d, *x) for d, t in zip(part.column(0).to_pylist(), raw_texts(part), strict=True) for x in scanner.scan(t)]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                    ["doc_id", "license", "start_word", "end_word", "matched", "template_words"],
                )

    found = docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, license string, start_word bigint, end_word bigint, matched bigint, template_words bigint"
    )
    return found.withColumn("coverage", F.col("matched") / F.col("template_words"))
