"""Near-duplicates of Jaccard 0.8 and more on five-word shingles: SimHash balls and MinHash bands show candidates, rare shingles their pairs, each link is verified.

Balls of 3 bits (`simhash.py`) alone don't find them all: Jaccard 0.8 lies near 10 of 64 bits. So bands show candidates beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from basketry.llm.common import discard, raw_texts, release, stored
from basketry.llm.components import components

WIDTH = 5
#: Near-duplicates share at least this part of their distinct shingles, as numerator and denominator.
PART = (4, 5)
#: A pair of Jaccard j shares a band with probability 1 - (1 - j**ROWS)**BANDS: 0.9994 at 0.8, 0.49 at 0.6, 0.03 at 0.4.
BANDS, ROWS = 40, 8
#: Members of a band that are compared with all others of it in a round: one, then GROWTH times as many in every further round.
GROWTH = 8
_draw = np.random.default_rng(20240229)
_XOR = _draw.integers(0, 2**64, BANDS * ROWS, np.uint64)
_ODD = _draw.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_LAST = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """64-bit hashes of the `width`-word shingles, repeats included; of a shorter text, one of all its words; none without words."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - width] + 1)).tolist()
        view = memoryview(joined)
        hashes = [xxh64_intdigest(view[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    return np.array(hashes, np.uint64)


def distinct_shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(shingles(text, WIDTH))


def bands(own: np.ndarray) -> list[int]:
    """A signed key per band; equal sets have equal keys, an empty set has none."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(own), 4096):
        mixed = (own[at : at + 4096, None] ^ _XOR) * _ODD
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * _LAST).min(axis=0))
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The document's key, `cls`, which equal sets of shingles share, the SimHash of its set and the bands."""
    from basketry.llm.simhash import majority

    for part in parts:
        sets = [distinct_shingles(t) for t in raw_texts(part, "text")]
        fps = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
        cls = np.array([xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
        keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), pa.array(cls), pa.array(fps), keys], ["id", "row", "cls", "fp", "bands"])


def _sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        sets = pa.array([distinct_shingles(t).tobytes() for t in raw_texts(part, "text")], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("cls"), sets], ["cls", "own"])


def _exploded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class and shingle."""
    for part in parts:
        for at in range(0, part.num_rows, 256):
            some = part.slice(at, 256)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in some.column("own")]
            row = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([some.column("cls").take(row), pa.array(np.concatenate(sets))], ["cls", "key"])


def _near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets share enough."""
    for part in parts:
        near = []
        for x, y in zip(part.column("a"), part.column("b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(PART[1] * both >= PART[0] * (len(x) + len(y) - both))
        yield part.select(["u", "v", "ru", "rv"]).filter(pa.array(near, pa.bool_()))


def prefixes(sets: DataFrame) -> DataFrame:
    """(cls, key, pos, size, weight): the shingles of each set that a near set has to share one of, as keys, and their places.

    Shingles are ordered from the rarest to the most frequent of all sets. Two sets that share a given part of their shingles share one among the first
    |x| - part * |x| + 1 of each; a copy with many changed words has only shingles of its own there and meets nobody. `weight` sums up
    the frequencies of a set's keys.
    """
    tokens = sets.select("cls", "own").mapInArrow(_exploded, "cls bigint, key bigint")
    ranked = tokens.join(tokens.groupBy("key").agg(F.count("*").alias("n")), "key").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("all"))
    size = F.size("all")
    needed = F.ceil(F.lit(PART[0]) * size / F.lit(PART[1]))
    first = ranked.select("cls", size.alias("size"), F.slice("all", F.lit(1), (size - needed + 1).cast("int")).alias("first"))
    first = first.withColumn("weight", F.aggregate("first", F.lit(0).cast("bigint"), lambda s, x: s + x["n"]))
    return first.select("cls", "size", "weight", F.posexplode("first").alias("pos", "x")).filter("x.n > 1").select("cls", F.col("x.key").alias("key"), "pos", "size", "weight")


def _nearer_roots(pairs: DataFrame) -> DataFrame:
    """(root, joined): a smaller root within two links of each linked root.

    Members of one star get one root. Roots that more links would connect stay apart for the next round, which costs comparisons and
    changes no link that is found.
    """
    both = stored(pairs.unionByName(pairs.select(F.col("rv").alias("ru"), F.col("ru").alias("rv"))).distinct(), "near-roots")
    once = both.groupBy("ru").agg(F.least(F.min("rv"), F.first("ru")).alias("least"))
    twice = both.join(once.withColumnRenamed("ru", "rv"), "rv").groupBy("ru").agg(F.min("least").alias("joined"))
    return twice.withColumnRenamed("ru", "root")


def links(active: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): verified links that connect the same classes as all near pairs that share a key of `active(cls, key)`.

    A round compares the first members of each key with all others of it that are not connected with them yet, and takes these first ones
    out. A key is done when what is left of it is connected. The members whose keys are the most frequent come first: they lie in
    the middle of their group, so most of a group of near copies is connected by one comparison each. No pair that could connect something is
    passed over, whatever the size of the group. Keys may come with their places (`pos`, `size`, `weight` as from `prefixes`): then pairs are left
    out whose sets can't share enough, given how much of each lies before the key. In particular the smaller set of a pair has its key early, so
    only such members become first ones, and others leave a key whose early members are all too large for them.
    """
    if "pos" not in active.columns:
        size = active.groupBy("key").agg(F.count("*").alias("n"))
        weight = active.join(size, "key").groupBy("cls").agg(F.sum("n").alias("weight"))
        lengths = sets.select("cls", (F.octet_length("own") / 8).cast("int").alias("size"))
        active = active.join(weight, "cls").join(lengths, "cls").withColumn("pos", F.lit(0))
    cols = ["cls", "key", "pos", "size", "weight", "root"]
    active = stored(active.withColumn("root", F.col("cls")).select(cols), "near-active")
    early = F.lit(PART[0] + PART[1]) * (F.col("size") - F.col("pos")) >= F.lit(2 * PART[0]) * F.col("size")
    largest = F.lit((PART[0] + PART[1]) / PART[0]) * (F.col("size") - F.col("pos")) - F.col("size") + F.lit(1e-6)
    first, found = 1, []
    while not active.isEmpty():
        order = W.partitionBy("key").orderBy(F.desc("weight"), "cls")
        centres = active.filter(early).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= first)
        centres = stored(centres.select("key", *(F.col(c).alias(f"c_{c}") for c in ("cls", "pos", "size", "root"))), "near-centres")
        # what two sets share lies at or behind their first common key
        rest_of = F.least(F.col("size") - F.col("pos"), F.col("c_size") - F.col("c_pos"))
        enough = F.lit(PART[0] + PART[1]) * rest_of >= F.lit(PART[0]) * (F.col("size") + F.col("c_size"))
        pairs = active.join(centres, (active["key"] == centres["key"]) & (F.col("root") != F.col("c_root")) & enough)
        pairs = pairs.select(
            F.least("cls", "c_cls").alias("u"), F.greatest("cls", "c_cls").alias("v"), F.least("root", "c_root").alias("ru"), F.greatest("root", "c_root").alias("rv")
        ).distinct()
        for end, name in (("u", "a"), ("v", "b")):
            pairs = pairs.join(sets.select(F.col("cls").alias(end), F.col("own").alias(name)), end)
        near = stored(pairs.select("u", "v", "ru", "rv", "a", "b").mapInArrow(_near, "u bigint, v bigint, ru bigint, rv bigint"), "near-links")
        found.append(near)
        joined = _nearer_roots(near.select("ru", "rv"))
        rest = active.join(centres.select("key", F.col("c_cls").alias("cls")), ["key", "cls"], "left_anti")
        rest = rest.join(joined, "root", "left").withColumn("root", F.coalesce("joined", "root")).select(cols)
        kept = rest = stored(rest, "near-rest")
        least = rest.filter(early).groupBy("key").agg(F.min("size").alias("least"))
        rest = rest.join(least, "key").filter(early | (largest >= F.col("least"))).select(cols)
        open_keys = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
        following, first = stored(rest.join(open_keys, "key", "left_semi").select(cols), "near-active"), first * GROWTH
        for done in (active, centres, kept):
            discard(done)
        active = following
        release(active.sparkSession)
    none = active.select(F.col("cls").alias("u"), F.col("cls").alias("v")).limit(0)
    return reduce(DataFrame.unionByName, [f.select("u", "v") for f in found], none)


def candidates(classes: DataFrame) -> DataFrame:
    """(cls): the classes of `classes(cls, fp, bands)` that may have a near one, as a fingerprint lies within 3 bits of theirs or a band is shared."""
    from basketry.llm import simhash

    prints = classes.filter(F.size("bands") > 0).groupBy("fp").agg(F.count("*").alias("n"))
    balls = stored(simhash.links(prints.select("fp")), "near-balls")
    release(classes.sparkSession)
    close = prints.filter("n > 1").select("fp").unionByName(balls.select(F.explode(F.array("u", "v")).alias("fp"))).distinct()
    places = classes.select("cls", F.explode("bands").alias("key"))
    shared = places.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    by_band = places.join(shared, "key", "left_semi").select("cls")
    by_ball = classes.filter(F.size("bands") > 0).join(close, "fp", "left_semi").select("cls")
    return by_ball.unionByName(by_band).distinct()


def heads(docs: DataFrame) -> DataFrame:
    """(id, row): the first row of each component of `docs(id, row, text)` by id and row.

    SimHash balls and bands choose the classes that may have a near one; which pairs of these are compared is decided by the shingles themselves.
    """
    each = docs.select("id", "row", "text").mapInArrow(_sketch, f"id {docs.schema['id'].dataType.simpleString()}, row string, cls bigint, fp bigint, bands array<bigint>")
    found = each.groupBy("cls").agg(F.min(F.struct("id", "row")).alias("head"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = stored(found, "near-classes")
    chosen = candidates(classes)
    asked = classes.join(chosen, "cls").select("cls", "head.id", "head.row")
    texts = docs.select("id", "row", "text").join(asked, ["id", "row"]).dropDuplicates(["cls"])
    sets = stored(texts.select("cls", "text").mapInArrow(_sets, "cls bigint, own binary"), "near-sets")
    release(docs.sparkSession)
    active = stored(prefixes(sets), "near-prefixes")
    release(docs.sparkSession)
    roots = components(links(active, sets)).withColumnRenamed("node", "cls")
    named = classes.join(roots, "cls", "left").groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("head").alias("head"))
    named = stored(named.select("head.id", "head.row"), "near-heads")
    for done in (classes, active, sets):
        discard(done)
    release(docs.sparkSession)
    return named


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of near-duplicates, the first by doc_id and then by all columns. Rows without doc_id stay.

    Rows are told apart by all their columns, so different texts under one doc_id are different documents; rows equal in all columns are one. Texts
    without words (null, empty, white space) are equal to each other and to nothing else; a text of fewer than five words equals only
    texts of the same words. Long texts count whole. Empty tables give no rows, and columns of any name stay as they are.
    """
    packed = docs.select(
        F.struct("*").alias("__doc"), F.col("doc_id").alias("id"), F.col("text"), F.sha2(F.to_json(F.struct("*")), 256).alias("row")
    )
    known = packed.filter("id IS NOT NULL")
    first = heads(known.select("id", "row", "text"))
    kept = known.select("__doc", "id", "row").join(first, ["id", "row"], "left_semi").dropDuplicates(["id", "row"])
    return kept.select("__doc.*").unionByName(docs.filter("doc_id IS NULL"))
