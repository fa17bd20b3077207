"""Product codes of vectors: k-means of every part position over metric trees, whose whole balls go to one codebook entry.

Vectors lie in blocks, one metric tree per block and part position, built once and stored. A round sends the codebooks (at most 256 entries of a
vector's length) to all blocks and adds up sums and counts per entry; only these numbers reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import discard, stored
from basketry.llm.metric_tree import Balls, grown, nearest

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of one tree.
BLOCK = 2048
#: Sums are added by Spark in digits of this many bits, so that none overflows a long.
DIGIT = 40
LONGEST = 2**63 - 1

Codebooks = list[np.ndarray]


def usable(vector: Column) -> Column:
    """Whether a vector holds at least one component, all known and finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector.cast("array<double>"), finite), F.lit(False))


def _integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); Python's integers where a long is too small."""
    scaled = np.floor(values * float(SCALE))
    return scaled.astype(np.int64) if np.abs(scaled).max(initial=0) < 2.0**31 else np.vectorize(int, otypes=[object])(scaled)


def _parts(values: np.ndarray) -> list[np.ndarray]:
    """Equal parts; the last is filled up with zeros where the length is no multiple of their number."""
    width = -(-values.shape[1] // PARTS)
    wide = np.zeros((len(values), width * PARTS), values.dtype)
    wide[:, : values.shape[1]] = values
    return [wide[:, p * width : (p + 1) * width] for p in range(PARTS)]


def _packed(table: np.ndarray) -> bytes:
    return "\n".join(map(str, table.ravel().tolist())).encode() if table.dtype == object else b"\0" + table.astype("<i8").tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.frombuffer(raw[1:], "<i8") if raw[:1] == b"\0" else np.array([int(x) for x in raw.decode().split("\n")], object)
    return out.reshape(-1, width)


_NODES = ["low", "high", "left", "right"]
_TREE = "struct<points:binary,places:array<int>,low:array<int>,high:array<int>,left:array<int>,right:array<int>,radius:array<double>,sums:binary>"
_BLOCKS = f"ids array<bigint>, labels array<string>, trees array<{_TREE}>"


def _tree_row(points: np.ndarray) -> dict:
    t = grown(points)
    return {
        "points": _packed(t.points), "places": t.order.tolist(), **{c: getattr(t, c).tolist() for c in _NODES}, "radius": t.radius.tolist(),
        "sums": _packed(t.sums),
    }


def _tree(row: dict, width: int) -> Balls:
    points, sums = _unpacked(row["points"], width), _unpacked(row["sums"], width)
    return Balls(points, np.array(row["places"]), *(np.array(row[c]) for c in _NODES), np.array(row["radius"]), sums)


def _planted(size: int, block: int):
    """Blocks of vectors of `size` components with their trees."""
    kind = pa.struct([
        ("points", pa.binary()), ("places", pa.list_(pa.int32())), *((c, pa.list_(pa.int32())) for c in _NODES), ("radius", pa.list_(pa.float64())),
        ("sums", pa.binary()),
    ])
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("trees", pa.list_(kind))])

    def made(rows: pa.Table) -> pa.RecordBatch:
        values = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        row = {
            "ids": rows.column("id").to_pylist(), "labels": rows.column("label").to_pylist(),
            "trees": [_tree_row(p) for p in _parts(_integers(values))],
        }
        return pa.RecordBatch.from_pylist([row], schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for part in parts:
            at = 0
            while at < part.num_rows:
                some = part.slice(at, block - count)
                held.append(some)
                at, count = at + some.num_rows, count + some.num_rows
                if count == block:
                    yield made(pa.Table.from_batches(held))
                    held, count = [], 0
        if count:
            yield made(pa.Table.from_batches(held))

    return run


def _sums(books: Codebooks):
    """Sums and counts of the points that each entry owns, over all blocks of a task; sums in digits."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), b.shape[1] + 1), object) for b in books]
        for part in parts:
            for at in range(part.num_rows):
                for p, row in enumerate(part.column("trees")[at].as_py()):
                    t = _tree(row, books[p].shape[1])
                    owned, rows, entry = nearest(t, books[p])
                    for node, e in owned:
                        total[p][e, 0] += int(t.high[node] - t.low[node])
                        total[p][e, 1:] += t.sums[node].astype(object)
                    for e in np.unique(entry):
                        mine = t.points[rows[entry == e]]
                        total[p][e, 0] += len(mine)
                        total[p][e, 1:] += mine.sum(0).astype(object)
        rows = []
        for p, table in enumerate(total):
            for e in range(len(table)):
                for k, v in enumerate(table[e].tolist() if table[e, 0] else ()):
                    sign, v, digit = (1 if v >= 0 else -1), abs(v), 0
                    while v or k + digit == 0:
                        rows.append((p, e, k, digit, sign * (v & (1 << DIGIT) - 1)))
                        v, digit = v >> DIGIT, digit + 1
        if rows:
            kinds = [pa.int32()] * 4 + [pa.int64()]
            names = ["part", "entry", "place", "digit", "value"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _coded(books: Codebooks):
    """Codes and errors of all vectors of the blocks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(part.num_rows):
                ids, labels = part.column("ids")[at].as_py(), part.column("labels")[at].as_py()
                codes, errors = [], np.zeros(len(ids), object)
                for p, row in enumerate(part.column("trees")[at].as_py()):
                    t = _tree(row, books[p].shape[1])
                    owned, rows, chosen = nearest(t, books[p])
                    entry = np.zeros(len(ids), np.int64)
                    entry[rows] = chosen
                    for node, e in owned:
                        entry[t.low[node] : t.high[node]] = e
                    gap = t.points.astype(object) - books[p][entry].astype(object)
                    mine = np.zeros(len(ids), np.int64)
                    mine[t.order] = entry
                    codes.append(mine)
                    errors[t.order] += (gap * gap).sum(1)
                texts = ["".join(f"{c:02x}" for c in row) for row in zip(*(c.tolist() for c in codes), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(texts), pa.array([min(int(e), LONGEST) for e in errors], pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    return run


def moved(books: Codebooks, blocks: DataFrame) -> Codebooks:
    """The entries after one round: the floor of the mean of their points; entries without points stay."""
    digits = blocks.select("trees").mapInArrow(_sums(books), "part int, entry int, place int, digit int, value bigint")
    # at most ENTRIES rows a component: the size of the codebooks
    rows = digits.groupBy("part", "entry", "place", "digit").agg(F.sum("value").alias("value")).collect()
    total = [np.zeros((len(b), b.shape[1] + 1), object) for b in books]
    for r in rows:
        total[r["part"]][r["entry"], r["place"]] += r["value"] << DIGIT * r["digit"]
    out = []
    for book, table in zip(books, total, strict=True):
        new = book.astype(object)
        for e in np.flatnonzero(table[:, 0] > 0):
            new[e] = [v // table[e, 0] for v in table[e, 1:]]
        small = max((abs(x) for x in new.ravel()), default=0) < 2**62
        out.append(new.astype(np.int64) if small else new)
    return out


def digest(books: Codebooks) -> str:
    """SHA-256 of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def trained(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, block: int = BLOCK) -> tuple[DataFrame, Codebooks] | None:
    """The stored blocks of `vectors(id, label, vector)` and the codebooks; None without rows."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return None
    size = len(first[0]["vector"])
    same = [r["vector"] for r in first if len(r["vector"]) == size]
    books = _parts(_integers(np.array(same, float)))
    rows = vectors.filter(F.size("vector") == size)
    # few rows a file, as a row holds a whole block
    blocks = stored(rows.mapInArrow(_planted(size, block), _BLOCKS), "metric-trees", maxRecordsPerFile=64)
    for _ in range(rounds):
        books = moved(books, blocks)
    return blocks, books


def encoded(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each usable vector, in PARTS parts of one byte.

    Rows whose vector is null, empty, or holds null, NaN or infinite components are dropped. The vector of the smallest id sets the number of
    components; rows with another number have no place in the codebooks and are dropped, and a number that PARTS doesn't divide is filled up with
    zeros. Without usable rows the result is empty. Equal ids are separate rows, ordered by vector where codebooks start; null ids come last.
    Fewer rows than entries make smaller codebooks. Null labels are one label. Other columns are ignored. Components of any finite size are exact;
    `error` and `label_error` stop at the largest long.
    """
    vectors = rows.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    ).filter(usable(F.col("vector")))
    done = trained(vectors, rounds, entries, block)
    schema = "vec_id bigint, label string, code string, error bigint"
    if done is None:
        coded, sha = rows.sparkSession.createDataFrame([], schema), ""
    else:
        blocks, books = done
        coded, sha = stored(blocks.mapInArrow(_coded(books), schema), "vector-codes"), digest(books)
        discard(blocks)
    total = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("bigint").alias("label_error"))
    both = coded.alias("a").join(total.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same codes by comparing every part with every entry; vectors of one length that PARTS divides."""
    parts = [
        f"""WITH v AS (
          SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS w, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (
          SELECT vec_id, label, rn, part, w[part * len(w) // {PARTS} + 1 : (part + 1) * len(w) // {PARTS}] AS w FROM v, (SELECT unnest(range({PARTS})) AS part)),
        book0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, w FROM p WHERE rn <= {ENTRIES})"""
    ]
    for k in range(ROUNDS + 1):
        parts.append(
            f"""near{k} AS MATERIALIZED (
          SELECT vec_id, part, arg_min(entry, (gap, entry)) AS entry, min(gap) AS gap FROM (
            SELECT a.vec_id, a.part, b.entry, list_sum(list_transform(list_zip(a.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS gap
            FROM p AS a JOIN book{k} AS b USING (part))
          GROUP BY vec_id, part)"""
        )
        if k < ROUNDS:
            parts.append(
                f"""mean{k} AS (
          SELECT part, entry, list(m ORDER BY i) AS w FROM (
            SELECT part, entry, i, floor(sum(x) / count(*)) AS m FROM (SELECT part, entry, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM p JOIN near{k} USING (vec_id, part))
            GROUP BY part, entry, i)
          GROUP BY part, entry),
        book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.w, b.w) AS w FROM book{k} AS b LEFT JOIN mean{k} AS m USING (part, entry))"""
            )
    last = f"""SELECT vec_id, string_agg(printf('%02x', entry::BIGINT), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id"""
    return ",\n".join(parts) + f""",
        coded AS (SELECT c.vec_id, c.code, c.error, v.label FROM ({last}) AS c JOIN v USING (vec_id))
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
          (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
        FROM coded"""


ORACLE = _oracle()
