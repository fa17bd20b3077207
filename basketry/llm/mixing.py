"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets an expected number of copies, its source's target over its source's size. The whole part is certain;
the fractional part is rounded by pairing: two documents trade words until one of them has a whole number of
copies, at random and without changing either's expectation or their sum of words. One open document is left of each
block; these meet in the next level of a reduction tree, until one per source is left.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import raw_texts, spread, stored

WEIGHTS, TOTAL_PERCENT, MOST_COPIES = (3, 1, 2), 150, 2
#: Documents that one task of a level rounds, and open documents that the next level brings together.
BLOCK, FAN_IN = 50_000, 20_000


def with_sizes(docs: DataFrame) -> DataFrame:
    """`docs` with `size`, the number of words of the whole text (null: 0)."""
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = pa.array([len(x.split()) if x else 0 for x in raw_texts(part)], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, sizes], [*part.schema.names, "size"])

    return docs.mapInArrow(run, ", ".join([*names, "size bigint"]))


def targets(sizes: dict, weights: Sequence[int] = WEIGHTS, percent: int = TOTAL_PERCENT, most: int = MOST_COPIES) -> dict:
    """Target words of each source: shares by weight of `percent` of all words, no more than `most` times the source's words.

    Sources are ordered by code point, null last, and take the weights in turn. What a stopped source can't take is shared
    anew among the others by weight until none is above its limit.
    """
    order = sorted((s for s in sizes if s is not None), key=str)
    order += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = percent * sum(sizes.values()) / 100, list(order), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        stopped = [s for s in open_ if left * weight[s] / whole >= most * sizes[s]]
        if not stopped:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in stopped:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in stopped)
        open_ = [s for s in open_ if s not in stopped]
    return out


def _uniform(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) that depends on the pair alone, so a repeated task makes the same choices."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / 2.0**53


def round_pairs(keys: Sequence[int], sizes: Sequence[int], p: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """Pivotal rounding in the given order: probabilities after it, and the index of the one still open (-1: none).

    Trading keeps the sum of size times probability; entries of size 0 or with a whole probability take no part.
    """
    p = p.astype(float).copy()
    eps, held = 1e-12, -1
    for j in range(len(p)):
        if not eps < p[j] < 1 - eps:
            p[j] = round(p[j])
            continue
        if held < 0:
            held = j
            continue
        i, ratio = held, sizes[j] / sizes[held]
        up = min(1 - p[i], p[j] * ratio)  # i gains words of j
        down = min(p[i], (1 - p[j]) * ratio)  # i gives words to j
        if _uniform(keys[i], keys[j], seed) * (up + down) < down:
            p[i], p[j] = p[i] + up, p[j] - up / ratio
        else:
            p[i], p[j] = p[i] - down, p[j] + down / ratio
        held = -1
        for k in (i, j):
            if eps < p[k] < 1 - eps:
                held = k
            else:
                p[k] = round(p[k])
    return p, held


def _level(last: bool, seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # large documents first: what stays open at the end is then a small one
        group = group.sort_values(["size", "k", "rank"], ascending=[False, True, True], kind="stable", ignore_index=True)
        p, held = round_pairs(group["k"].tolist(), group["size"].tolist(), group["p"].to_numpy(), seed)
        if last and held >= 0:  # the root: the only step that doesn't keep the sum, so it takes the nearer side
            p[held] = float(p[held] >= 0.5)
        return group.assign(p=p)

    return run


def copies(sized: DataFrame, seed: int = 0) -> DataFrame:
    """`sized(rid, doc_id, source, size)` with `source_size`, `target`, `copies` for every row.

    `rid` names a row. The rounding depends on doc_id, source and size alone, so reruns agree. Documents of size 0 and those whose
    expectation is whole need no rounding.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).collect()  # a row per source
    sizes = {r["source"]: r["source_size"] for r in totals}
    goal = targets(sizes)
    rows = [(r["source"], int(r["source_size"]), float(goal[r["source"]]), spread(r["docs"], BLOCK)) for r in totals]
    table = spark.createDataFrame(rows, "s string, source_size bigint, target double, blocks bigint")
    df = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s")))  # as many rows as sources
    expected = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(0.0)
    df = df.withColumn("sure", F.floor(expected)).withColumn("p", expected - F.floor(expected))
    df = df.withColumn("k", F.xxhash64("doc_id", "size")).withColumn("rank", F.coalesce("doc_id", F.lit(0))).withColumn("block", F.pmod("k", "blocks"))
    columns = "rid string, s string, block bigint, k bigint, size bigint, rank bigint, p double"
    names = ["rid", "s", "block", "k", "size", "rank", "p"]
    todo = df.filter("p > 0 AND p < 1").select(*names)
    most, done, level = max((r[3] for r in rows), default=1), None, 0
    while True:
        last = most == 1
        after = stored(todo.groupBy("s", "block").applyInPandas(_level(last, seed + 2 * level), columns), "mix-level")
        whole = after.filter("p = 0 OR p = 1").select("rid", F.col("p").alias("extra"))
        done = whole if done is None else done.unionByName(whole)
        if last:
            break
        todo = after.filter("p > 0 AND p < 1").withColumn("block", F.expr(f"block DIV {FAN_IN}"))
        most, level = spread(most, FAN_IN), level + 1
    out = df.join(done, "rid", "left")
    return out.select(
        *sized.columns, "source_size", "target", (F.col("sure") + F.coalesce("extra", F.lit(0.0))).cast("bigint").alias("copies")
    )


def _numbered(docs: DataFrame) -> DataFrame:
    """Sizes of all rows, written once, with an id of each row."""
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    sized = with_sizes(narrow).drop("text").withColumn("rid", F.monotonically_increasing_id().cast("string"))
    return stored(sized, "mix-sizes")


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), one row per row of `docs(doc_id, text, source)`.

    `taken` is size times copies. Each source's taken words differ from its target by half a document at most.
    Null and empty texts have size 0 and take nothing; a null source is a source; repeated rows are rows of their own.
    """
    out = copies(_numbered(docs), seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def resampled(docs: DataFrame, seed: int = 0) -> DataFrame:
    """`docs` with each row as often as the mix takes it; rows of size 0 go. Rows stay equal to their originals."""
    marked = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().cast("string").alias("rid")), "mix-rows")
    narrow = marked.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.source").cast("string").alias("source"), F.col("row.text").alias("text"))
    times = copies(stored(with_sizes(narrow).drop("text"), "mix-sizes"), seed).filter("copies > 0").select("rid", "copies")
    taken = marked.join(times, "rid").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("row.*")
