"""Connected components of a graph given by links, without a driver-side or per-group collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links(u, v)`; root is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the links no longer change. Each step takes
    the smallest neighbour by an aggregate with partial sums and joins it back, so a node with very many links is not
    gathered in one task. Self-links, repeated links and an empty table are fine; null ends are not links.
    """
    both = links.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = stored(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        edges = stored(_small_star(_large_star(edges)), "links")
        after = _mark(edges)
        if after == mark:
            break
        mark = after
    # every link now leads from a node to the root of its component
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Count and two order-free sums that tell two sets of links apart."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND(0xFFFFFFFF))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest of the node and its neighbours."""
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    larger = pairs.filter("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    smaller = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
