"""Removal of repeated byte strings by sorted suffixes: sampled splitters deal them out by leading bytes, buckets sort them locally.

Sorting every suffix of a corpus would move each byte as often as a string is long. So only suffixes that can matter are moved: of the
GRAM-byte sequences inside a WIDTH-byte window the one with the smallest hash is its anchor. Equal windows have equal anchors at the same
offset, hence windows whose anchor text occurs once are unique. The windows of one anchor are neighbours; from the first of them to
the end of the last is a piece. Pieces equal as a whole are one. Only where an anchor text has several different pieces are suffixes sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from basketry.llm.common import discard, raw_texts, release, spread, stored

WIDTH, GRAM = 200, 56
#: Bytes of pieces sorted together.
BUCKET = 4_000_000
#: An anchor text with more different pieces than this has its windows dealt out one by one.
MANY = 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every `gram` consecutive bytes, from running sums of a polynomial."""
    up, down = _scales(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up, out=sums[1:])
    out = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def pieces(text: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor, place of the anchor, first window, last window) of each piece, left to right."""
    n = len(text)
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    hashes = gram_hashes(np.frombuffer(text, np.uint8), gram)
    bits = np.uint64(int(len(hashes)).bit_length())
    # the hash and, among equal ones, the place: the smallest of a window is its leftmost least gram
    least = hashes >> bits << bits | np.arange(len(hashes), dtype=np.uint64)
    inside, span = width - gram + 1, 1
    while 2 * span <= inside:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    windows = n - width + 1
    least = np.minimum(least[:windows], least[inside - span : inside - span + windows])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate((np.ones(1, bool), np.diff(place) != 0)))
    last = np.append(first[1:] - 1, windows - 1)
    return hashes[place[first]].view(np.int64), place[first], first, last


_NAMES = ["did", "tid", "gram", "anchor", "first", "last", "digest"]
_PIECES = "did bigint, tid bigint, gram bigint, anchor int, first int, last int, digest bigint"


def _all_pieces(width: int, gram: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 256):
                some = part.slice(at, 256)
                found, digests = [], []
                for text in raw_texts(some):
                    own = pieces(text or b"", width, gram)
                    view = memoryview(text or b"")
                    found.append(own)
                    digests += [xxh3_64_intdigest(view[a : b + width]) for a, b in zip(own[2].tolist(), own[3].tolist(), strict=True)]
                row = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
                mz, anchor, first, last = (np.concatenate([x[i] for x in found]) for i in range(4))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("did").take(row), some.column("tid").take(row), pa.array(mz),
                        *(pa.array(x.astype(np.int32)) for x in (anchor, first, last)), pa.array(np.array(digests, np.uint64).view(np.int64)),
                    ],
                    _NAMES,
                )

    return run


def _cut(width: int, gram: int):
    """The bytes of listed pieces, and of their suffixes from the anchor on the first `gram`."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 64):
                rows = []
                some = part.slice(at, 64)
                for text, own in zip(raw_texts(some), some.column("own").to_pylist(), strict=True):
                    rows += [
                        (x["gram"], x["digest"], x["copies"], text[x["anchor"] : x["anchor"] + gram], text[x["first"] : x["last"] + width]) for x in own
                    ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["gram", "digest", "copies", "lead", "bytes"]
                )

    return run


def suffix_classes(text: bytes, starts: np.ndarray, width: int) -> np.ndarray:
    """Number of suffixes at `starts` that share their first `width` bytes, for each of them, by multikey quicksort.

    A group of suffixes equal so far is parted by its next eight bytes at once; suffixes alone in their group are done.
    """
    raw = np.frombuffer(text + bytes(width + 8), np.uint8)
    eight = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1), writeable=False)
    out = np.ones(len(starts), np.int64)
    rows, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, width, 8) if len(rows) else ():
        key = np.ascontiguousarray(eight[starts[rows] + depth]).view(">u8").ravel().astype(np.uint64)
        if width - depth < 8:  # bytes beyond the string don't count
            key >>= np.uint64(8 * (8 - (width - depth)))
        order = np.lexsort((key, group))
        rows, group, key = rows[order], group[order], key[order]
        new = np.concatenate((np.ones(1, bool), (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        alone = new & np.append(new[1:], True)
        group = np.cumsum(new)
        rows, group = rows[~alone], group[~alone]
        if not len(rows):
            return out
    out[rows] = np.bincount(group)[group]
    return out


_FOUND = "gram bigint, digest bigint, from_window int, to_window int"


def _ranges(which: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of consecutive windows of one piece."""
    new = np.concatenate((np.ones(1, bool), (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1)))[: len(which)]
    begin = np.flatnonzero(new)
    return begin, np.append(begin[1:], len(which))[: len(begin)] - 1


def _sorted_bucket(width: int, bucket: int):
    """Ranges of windows that occur in several pieces; reads pieces sorted by their leading bytes, whole anchors at a time."""

    def solved(rows: dict[tuple[int, int], tuple[int, bytes]]) -> pa.RecordBatch:
        keys, copies = list(rows), np.array([c for c, _ in rows.values()], np.int64)
        texts = [t for _, t in rows.values()]
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        piece = np.repeat(np.arange(len(texts)), sizes - width + 1)
        window = np.arange(len(piece)) - np.repeat(np.cumsum(sizes - width + 1) - (sizes - width + 1), sizes - width + 1)
        repeated = (suffix_classes(b"".join(texts), begins[piece] + window, width) > 1) | (copies[piece] > 1)
        piece, window = piece[repeated], window[repeated]
        begin, end = _ranges(piece, window)
        return pa.RecordBatch.from_arrays(
            [
                *(pa.array([keys[i][k] for i in piece[begin].tolist()], pa.int64()) for k in (0, 1)),
                pa.array(window[begin].astype(np.int32)), pa.array(window[end].astype(np.int32)),
            ],
            ["gram", "digest", "from_window", "to_window"],
        )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, bytes]] = {}
        lead, size = None, 0
        for part in parts:
            for gram, digest, copies, this, text in zip(*(part.column(c).to_pylist() for c in ("gram", "digest", "copies", "lead", "bytes")), strict=True):
                if this != lead and size >= bucket:  # no window is on both sides: equal ones have equal leading bytes
                    yield solved(held)
                    held, size = {}, 0
                lead = this
                if (gram, digest) not in held:
                    held[gram, digest] = (copies, text)
                    size += len(text)
        if held:
            yield solved(held)

    return run


_WINDOWS = "gram bigint, digest bigint, window int, a bigint, b bigint, copies bigint"


def _windows(width: int):
    """Every window of the pieces with 128 bits of hash."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 128):
                rows = []
                some = part.slice(at, 128)
                for gram, digest, copies, text in zip(*(some.column(c).to_pylist() for c in ("gram", "digest", "copies", "bytes")), strict=True):
                    view = memoryview(text)
                    for i in range(len(text) - width + 1):
                        one = view[i : i + width]
                        rows.append((gram, digest, i, *(xxh3_64_intdigest(one, s) - (1 << 63) for s in (0, 1)), copies))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["gram", "digest", "window", "a", "b", "copies"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def repeated_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, bucket: int = BUCKET, many: int = MANY) -> DataFrame:
    """(did, tid, ranges): byte ranges [a, b) of `docs(did, tid, text)` covered by strings of `width` bytes that start elsewhere too."""
    whole = F.lit(0).alias("from_window"), (F.col("last") - F.col("first")).alias("to_window")
    every = stored(docs.mapInArrow(_all_pieces(width, gram), _PIECES), "suffix-pieces")
    counts = every.groupBy("gram").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    shared = counts.filter("n > 1").select("gram", (F.col("lo") != F.col("hi")).alias("differ"))
    some = stored(every.join(shared, "gram").select(*_NAMES, "differ"), "shared-suffixes")
    discard(every)
    release(docs.sparkSession)
    place = F.struct("did", "tid", "anchor", "first", "last")
    contents = some.filter("differ").groupBy("gram", "digest").agg(F.count("*").alias("copies"), F.min(place).alias("o")).select("gram", "digest", "copies", "o.*")
    own = contents.groupBy("did", "tid").agg(F.collect_list(F.struct("gram", "digest", "copies", "anchor", "first", "last")).alias("own"))
    texts = docs.join(own, ["did", "tid"]).select("text", "own")
    cut = stored(texts.mapInArrow(_cut(width, gram), "gram bigint, digest bigint, copies bigint, lead binary, bytes binary"), "suffixes")
    release(docs.sparkSession)
    size = F.length("bytes")
    hot = stored(cut.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > many).select("gram"), "hot-anchors")
    total = cut.agg(F.sum(size)).first()[0] or 0
    dealt = cut.join(F.broadcast(hot) if hot.count() < 10_000 else hot, "gram", "left_anti")
    # Spark samples the splitters; a bucket never parts suffixes with the same leading bytes
    dealt = dealt.repartitionByRange(spread(total, bucket), "lead").sortWithinPartitions("lead")
    found = dealt.mapInArrow(_sorted_bucket(width, bucket), _FOUND)
    if not hot.isEmpty():
        single = stored(cut.join(hot, "gram", "left_semi").mapInArrow(_windows(width), _WINDOWS), "single-windows")
        again = single.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("copies").alias("c")).filter("n > 1 OR c > 1").select("a", "b")
        found = found.unionByName(single.join(again, ["a", "b"]).select("gram", "digest", F.col("window").alias("from_window"), F.col("window").alias("to_window")))
    found = stored(found, "repeated-windows")
    release(docs.sparkSession)
    hits = some.filter("differ").join(found, ["gram", "digest"]).unionByName(some.filter("NOT differ").select("*", *whole))
    span = F.struct((F.col("first") + F.col("from_window")).alias("a"), (F.col("first") + F.col("to_window") + width).alias("b"))
    return hits.groupBy("did", "tid").agg(F.collect_list(span).alias("ranges"))


def _kept(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at in range(0, part.num_rows, 256):
            some = part.slice(at, 256)
            rows = []
            ranges = some.column("ranges")
            for i, (doc_id, text) in enumerate(zip(some.column("doc_id").to_pylist(), raw_texts(some), strict=True)):
                text = text or b""
                left, gone, spans = text, 0, 0
                if ranges[i].is_valid:
                    own = ranges[i].values
                    a, b = own.field("a").to_numpy(), own.field("b").to_numpy()
                    steps = np.zeros(len(text) + 1, np.int64)
                    np.add.at(steps, a, 1)
                    np.add.at(steps, b, -1)
                    covered = np.cumsum(steps[:-1]) > 0
                    left = np.frombuffer(text, np.uint8)[~covered].tobytes()
                    gone = int(covered.sum())
                    spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                rows.append((doc_id, len(text), gone, spans, hashlib.sha256(left).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )


def deduplicated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, bucket: int = BUCKET, many: int = MANY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per row of `docs(doc_id, text)`.

    A byte of the UTF-8 text goes if a string of `width` bytes covers it that also starts anywhere else, be it in the same row; strings are those of
    the input and never cross rows. Repeated rows are separate, so texts of `width` bytes or more in two rows go whole; a row without doc_id takes
    part like any other. Null and empty texts have 0 bytes; texts shorter than `width` keep all. Empty tables give no rows, other columns are ignored.
    """
    rows = docs.select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("did"), F.xxhash64("text", F.col("doc_id").isNull()).alias("tid")
    )
    texts = rows.filter(F.octet_length("text") >= width).select("did", "tid", "text")
    ranges = repeated_ranges(texts, width, gram, bucket, many)
    joined = rows.join(ranges, ["did", "tid"], "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_kept, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
