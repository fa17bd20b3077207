"""Removal of repeated 50-word passages by FM-indexes of shards and backward search.

Which shard holds a window is decided by its minimizer, the smallest hash of its eight-word sequences: equal windows have equal
minimizers and meet in one shard. The windows of a document that share a minimizer's place are consecutive and form a piece.
Pieces whose minimizer occurs in one document only can't repeat and need no index.

Texts are shuffled once, into buckets by document; lists of pieces and ranges go to the texts, and not the texts to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from basketry.llm.common import bucketed, discard, raw_texts, release, spread, stored
from basketry.llm.fm_index import FMIndex

WIDTH, GRAM = 50, 8
#: Words of one shard. A minimizer with more words than this in its distinct pieces is spread window by window.
SHARD_WORDS = 500_000
#: What tells rows of documents apart, and bytes of text in a bucket of them.
KEY, BUCKET_BYTES = ["doc_id", "tid"], 16 << 20


def pieces(words: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, last window) of each piece of a document, left to right."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    grams = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        grams = (grams ^ codes[k : n - gram + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(32)
    inside = width - gram + 1
    place = np.lib.stride_tricks.sliding_window_view(grams, inside).argmin(axis=1) + np.arange(n - width + 1)
    first = np.flatnonzero(np.concatenate((np.ones(1, bool), np.diff(place) != 0)))
    last = np.concatenate((first[1:] - 1, [len(place) - 1]))
    return grams[place[first]].view(np.int64), first, last


def _bounds(words: list[bytes]) -> tuple[memoryview, np.ndarray]:
    """The words joined by spaces, and where each begins there; one more entry for the end."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    return memoryview(b" ".join(words)), np.concatenate((np.zeros(1, np.int64), ends))


def _digests(words: list[bytes], first: np.ndarray, last: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of pieces; with the minimizer, 128 bits tell pieces apart."""
    view, begins = _bounds(words)
    ranges = zip(begins[first].tolist(), (begins[last + width] - 1).tolist(), strict=True)
    return np.fromiter((xxh3_64_intdigest(view[a:b], seed) for a, b in ranges), np.uint64, len(first)).view(np.int64)


_PIECES = "doc_id bigint, tid bigint, mz bigint, first int, last int, digest bigint"
_NAMES = ["doc_id", "tid", "mz", "first", "last", "digest"]


def _all_pieces(width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 512):
                some = part.slice(at, 512)
                found = []
                for text in raw_texts(some):
                    words = (text or b"").split()
                    mz, first, last = pieces(words, width)
                    found.append((mz, first, last, _digests(words, first, last, width) if len(mz) else mz))
                times = [len(x[0]) for x in found]
                row = pa.array(np.repeat(np.arange(len(found)), times))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id").take(row), some.column("tid").take(row), pa.array(np.concatenate([x[0] for x in found])),
                        pa.array(np.concatenate([x[1] for x in found]).astype(np.int32)), pa.array(np.concatenate([x[2] for x in found]).astype(np.int32)),
                        pa.array(np.concatenate([x[3] for x in found])),
                    ],
                    _NAMES,
                )

    return run


def _single_windows(width: int):
    """Pieces of one window each, a second hash of it in place of the minimizer, for the listed ranges of windows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(part.num_rows):
                one = part.slice(at, 1)
                words = raw_texts(one)[0].split()
                places = np.concatenate([np.arange(x["first"], x["last"] + 1) for x in one.column("own")[0].as_py()])
                digests, keys = (pa.array(_digests(words, places, places, width, seed)) for seed in (0, 1))
                n, spots = len(places), pa.array(places.astype(np.int32))
                ids = [pa.array(np.full(n, one.column(c)[0].as_py(), np.int64)) for c in ("doc_id", "tid")]
                yield pa.RecordBatch.from_arrays([*ids, keys, spots, spots, digests], _NAMES)

    return run


def _cut(width: int):
    """The words of listed pieces."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 64):
                rows = []
                some = part.slice(at, 64)
                for doc_id, text, own in zip(some.column("doc_id").to_pylist(), raw_texts(some), some.column("own").to_pylist(), strict=True):
                    view, begins = _bounds(text.split())
                    rows += [(x["shard"], x["mz"], x["digest"], doc_id, bytes(view[begins[x["first"]] : begins[x["last"] + width] - 1])) for x in own]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "mz", "digest", "owner", "words"]
                )

    return run


def _search(width: int):
    """Streams a shard's pieces through its index: ranges of windows with the smallest document that holds them."""

    def run(group: pa.Table) -> pa.Table:
        seen: set[tuple[int, int]] = set()
        kept, codes, text, owners = [], {}, [0], []
        starts, lengths = [], []
        for mz, digest, owner, raw in zip(*(group.column(c).to_pylist() for c in ("mz", "digest", "owner", "words")), strict=True):
            if (mz, digest) in seen:
                continue
            seen.add((mz, digest))
            words = raw.split()
            kept.append((mz, digest))
            owners.append(owner)
            starts.append(len(text))
            lengths.append(len(words))
            text += [codes.setdefault(w, len(codes) + 1) for w in words]
            text.append(0)
        piece = np.repeat(np.arange(len(kept)), np.array(lengths) + 1)
        doc_at = np.concatenate((np.full(1, np.iinfo(np.int64).max), np.array(owners, np.int64)[piece]))
        text, starts, lengths = np.array(text, np.int64), np.array(starts), np.array(lengths)
        index = FMIndex(text, len(codes) + 1, width)
        least = index.class_least(doc_at)
        which, window, smallest = [], [], []
        for rows, step, found in index.statistics(text, starts, lengths):
            which.append(rows)
            window.append(lengths[rows] - step)
            smallest.append(least[found])
        which, window, smallest = (np.concatenate(x) for x in (which, window, smallest))
        order = np.lexsort((window, which))
        which, window, smallest = which[order], window[order], smallest[order]
        new = np.concatenate((np.ones(1, bool), (which[1:] != which[:-1]) | (smallest[1:] != smallest[:-1])))
        begin = np.flatnonzero(new)
        end = np.concatenate((begin[1:] - 1, [len(which) - 1]))
        return pa.table(
            {
                **{c: pa.array([kept[i][k] for i in which[begin].tolist()], pa.int64()) for k, c in enumerate(("mz", "digest"))}, "from_window": pa.array(window[begin].astype(np.int64)),
                "to_window": pa.array(window[end].astype(np.int64)), "smallest": pa.array(smallest[begin]),
            }
        )

    return run


def by_document(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, tid, text) of `docs(doc_id, text)` in buckets by document, and the number of buckets."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    parts = spread(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, BUCKET_BYTES)
    texts = bucketed(rows, "texts", KEY, parts)
    release(docs.sparkSession)  # the shuffle of the texts
    return texts, parts


def _listed(rows: DataFrame, what: Column, name: str, parts: int) -> DataFrame:
    """What belongs to each document as one list, dealt like the buckets of texts."""
    return rows.repartition(parts, *KEY).groupBy(*KEY).agg(F.collect_set(what).alias(name))


def repeated_ranges(docs: DataFrame, parts: int, width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, tid, ranges): word ranges [a, b) of each document of `docs(doc_id, tid, text)` that a smaller doc_id holds too.

    `tid` tells apart rows of the same doc_id; rows equal in both are one. Rows without doc_id take no part. `docs` lies in `parts` buckets.
    """
    spark = docs.sparkSession
    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    every = stored(named.select("doc_id", "tid", "text").mapInArrow(_all_pieces(width), _PIECES), "pieces")
    # a minimizer of one document only can't repeat; repeated rows of a document don't count
    shared = every.groupBy("mz").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("mz")
    some = stored(every.join(shared, "mz").select(*_NAMES), "shared-pieces")
    discard(every)
    release(spark)
    size = F.col("last") - F.col("first") + width
    owner = F.min(F.struct("doc_id", "tid", "first", "last")).alias("o")
    distinct = lambda rows: stored(rows.groupBy("mz", "digest").agg(owner).select("mz", "digest", "o.*"), "contents")
    contents = distinct(some)
    hot = stored(contents.groupBy("mz").agg(F.sum(size).alias("n")).filter(F.col("n") > shard_words).select("mz"), "hot-minimizers")
    if not hot.isEmpty():  # too many different pieces around one minimizer: their windows go by their own digests
        cut = _listed(some.join(hot, "mz", "left_semi"), F.struct("first", "last"), "own", parts)
        texts = named.select("doc_id", "tid", "text").join(cut, KEY)
        some = stored(some.join(hot, "mz", "left_anti").unionByName(texts.mapInArrow(_single_windows(width), _PIECES)), "split-pieces")
        contents = distinct(some)
    release(spark)
    total = contents.agg(F.sum(size)).first()[0] or 0
    # of a shard's minimizers none is large, so a shard stays near its size
    homes = contents.withColumn("shard", F.pmod(F.xxhash64("mz"), F.lit(spread(total, shard_words))))
    own = _listed(homes, F.struct("mz", "first", "last", "digest", "shard"), "own", parts)
    texts = named.select("doc_id", "tid", "text").join(own, KEY)
    cut = texts.mapInArrow(_cut(width), "shard bigint, mz bigint, digest bigint, owner bigint, words binary")
    found = cut.groupBy("shard").applyInArrow(_search(width), "mz bigint, digest bigint, from_window bigint, to_window bigint, smallest bigint")
    found = stored(found, "matches")
    release(spark)
    hits = some.select("doc_id", "tid", "first", "mz", "digest").join(found, ["mz", "digest"]).filter("smallest < doc_id")
    span = F.struct((F.col("first") + F.col("from_window")).alias("a"), (F.col("first") + F.col("to_window") + width).alias("b"))
    return _listed(hits, span, "ranges", parts)


def _kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at in range(0, part.num_rows, 256):
            some = part.slice(at, 256)
            counts, gone, digests = [], [], []
            for text, ranges in zip(raw_texts(some), some.column("ranges").to_pylist(), strict=True):
                words = (text or b"").split()
                keep = np.ones(len(words), bool)
                for x in ranges or ():
                    keep[x["a"] : x["b"]] = False
                left = [words[i] for i in np.flatnonzero(keep).tolist()] if ranges else words
                counts.append(len(words))
                gone.append(len(words) - len(left))
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests)],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )


def deduplicated(docs: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of `docs(doc_id, text)`.

    A word goes if a window of `width` words covers it that also starts in a document with a smaller doc_id; windows are those of the
    input. Texts that are null, empty or shorter than a window keep all words. Rows with the same doc_id don't remove from each other, nor
    does a row without doc_id from or to any. Other columns are ignored.
    """
    rows, parts = by_document(docs)
    ranges = repeated_ranges(rows, parts, width, shard_words)
    joined = rows.join(ranges, KEY, "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_kept, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
