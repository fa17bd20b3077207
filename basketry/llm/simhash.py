"""Near-duplicates by SimHash, found by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import raw_texts, spread, stored
from basketry.llm.components import components
from basketry.llm.near import keep_one, shingles  # noqa: F401

RADIUS = 3
#: Variants that one task of the collision search holds, about ten bytes each.
BUCKET_VARIANTS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so multiplying is one-to-one
_ONE = np.uint64(1)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash over `width`-word shingles, repeats included; zero without words."""
    return majority(shingles(text, width))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero without any."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `fp`, the fingerprint as a signed long, one row per document. A null or empty text has fp 0."""
    narrow = docs.select(*keep, F.col(text).alias("__text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = np.fromiter(map(fingerprint, raw_texts(part, "__text")), np.uint64, part.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(fps)], [*keep, "fp"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.select(*keep).schema)
    return narrow.mapInArrow(run, f"{kinds}, fp bigint")


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """Flips within half the radius: none and each single bit; and each pair of bits of the same 32-bit half.

    Of three differing bits two lie in one half, and fingerprints at an odd distance differ in the parity of their
    ones. So pairs at distance 3 meet if even fingerprints flip two bits of one half and odd ones flip one bit.
    """
    bit = _ONE << np.arange(64, dtype=np.uint64)
    single = np.concatenate((np.zeros(1, np.uint64), bit))
    pairs = [bit[i] | bit[j] for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]
    return single, np.array(pairs, np.uint64)


SINGLE, DOUBLE = _masks()
MASKS = np.concatenate((SINGLE, DOUBLE))


def _variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All variants of `fps` and the index of the flip that made each."""
    even = fps[np.bitwise_count(fps) % 2 == 0]
    keys = np.concatenate(((fps[:, None] ^ SINGLE).ravel(), (even[:, None] ^ DOUBLE).ravel()))
    flips = np.concatenate((np.tile(np.arange(65, dtype="<u2"), len(fps)), np.tile(np.arange(65, len(MASKS), dtype="<u2"), len(even))))
    return keys, flips


def _emit(buckets: int):
    """Variants of every fingerprint, packed by the bucket of the variant."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            every = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 2048):
                keys, flips = _variants(every[at : at + 2048])
                home = ((keys * _MIX) >> np.uint64(40)).astype(np.int64) * buckets >> 24
                order = np.argsort(home.astype(np.uint16) if buckets <= 65536 else home, kind="stable")
                home, keys, flips = home[order], keys[order], flips[order]
                cuts = np.flatnonzero(np.diff(home)) + 1
                starts = [0, *cuts.tolist()]
                ends = [*cuts.tolist(), len(keys)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(home[starts].astype(np.int64)),
                        pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                        pa.array([flips[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    ["bucket", "keys", "flips"],
                )

    return run


def _collide(group: pa.Table) -> pa.Table:
    """Links between fingerprints that share a variant: all of a variant's fingerprints to one that flipped a bit at most."""
    keys = np.frombuffer(b"".join(x.as_py() for x in group.column("keys")), np.uint64)
    flips = np.frombuffer(b"".join(x.as_py() for x in group.column("flips")), "<u2")
    order = np.argsort(keys)
    keys, flips = keys[order], flips[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    shared = same[1:] | same[:-1]
    keys, flips, first = keys[shared], flips[shared], ~same[:-1][shared]
    run = np.cumsum(first) - 1
    fps = keys ^ MASKS[flips]
    # the centre of a run: any member with at most one flip; without one, the members are pairs that other variants show
    centre = np.zeros(int(run[-1]) + 1 if len(run) else 0, np.uint64)
    known = np.zeros(len(centre), bool)
    near = flips < len(SINGLE)
    centre[run[near]], known[run[near]] = fps[near], True
    a, b, use = centre[run], fps, known[run]
    use &= (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    a, b = a[use], b[use]
    found = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
    return pa.table({"u": np.ascontiguousarray(found[:, 0]).view(np.int64), "v": np.ascontiguousarray(found[:, 1]).view(np.int64)})


def links(distinct_fps: DataFrame) -> DataFrame:
    """(u, v): links that connect all of `distinct_fps(fp)` with 3 or fewer differing bits, each verified.

    The pairs themselves are not all returned: fingerprints that share a variant are linked to one of them, which
    connects the same fingerprints with as many links as variants.
    """
    total = distinct_fps.count()
    buckets = spread(total * 560, BUCKET_VARIANTS)
    found = distinct_fps.mapInArrow(_emit(buckets), "bucket bigint, keys binary, flips binary").groupBy("bucket")
    return found.applyInArrow(_collide, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: fingerprints within 3 bits are linked, a component is named by its smallest doc_id.

    Null and empty texts have fingerprint zero and link like any other. Rows with the same doc_id are separate rows. A null
    doc_id keeps its row and never names a component, unless the component has no other. Other columns are ignored.
    """
    prints = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-classes")
    roots = components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
