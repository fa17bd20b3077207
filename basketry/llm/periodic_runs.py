"""Repeats in a row: runs of words as maximal pairs at close distance, from the tree of LCP intervals of each text.

A maximal pair is two places of a text whose next L words agree, and neither the words before nor those after them. With a distance q of
at most L / 2 the two stretches overlap into one with period q, q + L words long, that no neighbouring word extends: a run.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basketry.llm.common import raw_texts

SHORTEST, TIMES = 24, 3
#: Words whose suffixes are sorted together; a longer text is sorted alone.
GROUP_WORDS = 250_000


def least_agreement(shortest: int = SHORTEST, times: int = TIMES) -> int:
    """Words that the pair of any run agrees in: q + L >= shortest and L >= (times - 1) q."""
    return min(max(shortest - q, (times - 1) * q) for q in range(1, shortest + 1))


def ranked(keys: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, … keys, until no two are equal; one rank more, of the end.

    A suffix that no other equals keeps its rank, so each doubling sorts only those that are still equal to another.
    """
    n = len(keys)
    places, wide = np.arange(n), keys.astype(np.int64)
    rank = np.full(n + 1, n, np.int64)
    before = np.zeros(n, np.int64)
    levels, step = [], 0
    while True:
        pair = wide if step == 0 else before * (n + 1) + rank[np.minimum(places + step, n)]
        order = np.argsort(pair, kind="stable")
        pair, places, before = pair[order], places[order], before[order]
        new = np.concatenate((np.ones(1, bool), pair[1:] != pair[:-1]))[: len(pair)]
        group = np.concatenate((np.ones(1, bool), before[1:] != before[:-1]))[: len(pair)]
        at = np.arange(len(pair))
        start = np.maximum.accumulate(np.where(new, at, 0))
        old = np.maximum.accumulate(np.where(group, at, 0))
        before = before + start - old
        rank[places] = before
        levels.append(rank.astype(np.int32))
        alone = new & np.append(new[1:], True)
        places, before = places[~alone], before[~alone]
        if not len(places):
            return levels
        step = max(1, 2 * step)


def agreement(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal keys from the places `a` and `b` on."""
    end = len(levels[0]) - 1
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a + out, end)] == levels[k][np.minimum(b + out, end)]
        out += same << k
    return out


def close_pairs(suffixes: list[int], common: list[int], left: list[int], shortest: int, times: int) -> list[tuple[int, int, int]]:
    """(start, distance, agreement) of the maximal pairs of a run's length and repetitions.

    `suffixes` are in their order, `common[i]` is the agreement of suffix i with the one before (0: another subtree), `left` the class of
    each place's left word. LCP intervals close bottom-up; each keeps its places, sorted, with their left-word classes. When two children of
    an interval meet, every place of the smaller looks for partners in the larger. Only its two neighbours there count: were a third
    occurrence between the places of a pair at distance q <= L / 2, their common words would have a period that divides q, so the run
    would have that smaller period.
    """
    found = []

    def met(one: list[int], other: list[int], length: int) -> list[int]:
        small, large = (one, other) if len(one) <= len(other) else (other, one)
        reach = length // (times - 1)
        for x in small:
            at = bisect_left(large, x)
            for y in large[max(at - 1, 0) : at + 1]:
                gap = abs(x - y)
                if gap <= reach and gap + length >= shortest and left[x] != left[y]:
                    found.append((min(x, y), gap, length))
        if len(small) * 16 < len(large):
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
        return large

    open_: list[tuple[int, list[int]]] = []
    current = [suffixes[0]] if suffixes else []
    for place, length in zip([*suffixes[1:], -1], [*common[1:], 0], strict=True) if suffixes else ():
        while open_ and open_[-1][0] > length:
            deep, places = open_.pop()
            current = met(places, current, deep)
        if open_ and open_[-1][0] == length:
            open_[-1] = (length, met(open_[-1][1], current, length))
        elif length:
            open_.append((length, current))
        current = [place]
    return found


def runs(texts: list[np.ndarray], shortest: int = SHORTEST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text of word numbers, sorted: at least `shortest` words and `times` periods."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sizes.sum():
        return out
    words = np.concatenate(texts).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    keys = text * (words.max() + 1) + words  # the same word of two texts differs, so nothing agrees across texts
    levels = ranked(keys)
    least = least_agreement(shortest, times)
    depth = min(least.bit_length() - 1, len(levels) - 1)
    # by the largest power of two up to the least agreement: suffixes that equal no other are in no pair
    rank = levels[depth][:-1]
    order = np.argsort(levels[-1][:-1])
    same = rank[order[1:]] == rank[order[:-1]]
    some = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    common = np.zeros(len(some), np.int64)
    common[1:] = agreement(levels, some[:-1], some[1:])
    common[common < least] = 0
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))[np.flatnonzero(sizes)]
    left = np.concatenate(([0], keys[:-1]))
    left[first] = -1 - np.arange(len(first))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    shortest_period: dict[tuple[int, int], int] = {}
    for start, gap, length in close_pairs(some.tolist(), common.tolist(), left.tolist(), shortest, times):
        stretch = (start, gap + length)
        shortest_period[stretch] = min(gap, shortest_period.get(stretch, gap))
    for (start, length), period in shortest_period.items():
        out[text[start]].append((int(start - begins[text[start]]), length, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def looped(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word each word becomes, for the documents that get a planted repetition; None for the others."""
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return places


def _row(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    keep = np.ones(len(words), bool)
    best = None
    for start, length, period in found:
        keep[start + period : start + length] = False
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    kept = [words[i] for i in np.flatnonzero(keep).tolist()] if found else words
    told = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
    return (
        len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(told).hexdigest(),
        hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


_SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _detected(planted: bool, shortest: int, times: int, group_words: int):
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def done(ids: list[int | None], words: list[list[bytes]]) -> pa.RecordBatch:
        codes: dict[bytes, int] = {}
        coded = [np.fromiter((codes.setdefault(w, len(codes)) for w in text), np.int64, len(text)) for text in words]
        rows = [(d, *_row(w, found)) for d, w, found in zip(ids, words, runs(coded, shortest, times), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, count = [], [], 0
        for part in parts:
            for doc_id, text in zip(part.column("doc_id").to_pylist(), raw_texts(part), strict=True):
                words = (text or b"").split()
                places = looped(len(words), doc_id) if planted else None
                if places is not None:
                    words = [words[i] for i in places.tolist()]
                if ids and count + len(words) > group_words:
                    yield done(ids, texts)
                    ids, texts, count = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                count += len(words)
        if ids:
            yield done(ids, texts)

    return run


def detected(docs: DataFrame, planted: bool = False, shortest: int = SHORTEST, times: int = TIMES, group_words: int = GROUP_WORDS) -> DataFrame:
    """Runs of each row of `docs(doc_id, text)`: their number, the one with the greatest exponent, and digests of all runs and of the collapsed text.

    A run has at least `shortest` words and `times` periods. Collapsing drops every word that some run holds after its first period. With
    `planted`, the documents that `looped` names are repeated first. One text is sorted in one task, texts never meet.
    Null and empty texts and texts of white space have no run and the digest of the empty text. Repeated rows and equal doc_ids are rows of
    their own; a null doc_id is kept and counts as the empty text in `looped`. Empty tables give no rows. Other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_detected(planted, shortest, times, group_words), _SCHEMA)
