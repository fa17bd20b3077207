"""Unions and id-set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*dfs: DataFrame) -> DataFrame:
    """Rows of all inputs, columns matched by name."""
    return reduce(DataFrame.unionByName, dfs)


def common_ids(a: DataFrame, b: DataFrame, id: str) -> DataFrame:
    return a.select(id).intersect(b.select(id))


def missing_ids(a: DataFrame, b: DataFrame, id: str) -> DataFrame:
    """Distinct ids of `a` that `b` does not have."""
    return a.select(id).subtract(b.select(id))


def overlap(a: DataFrame, b: DataFrame, id: str) -> DataFrame:
    """One row: ids in common, in either, and their ratio. The union size needs no union."""
    sides = a.select(id).distinct().withColumn("__a", F.lit(1)).join(
        b.select(id).distinct().withColumn("__b", F.lit(1)), id, "full_outer"
    )
    sizes = sides.agg(
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("common"),
        F.count(F.lit(1)).alias("union"),
    )
    return sizes.withColumn("jaccard", F.coalesce(F.try_divide(F.col("common"), F.col("union")), F.lit(0.0)))
