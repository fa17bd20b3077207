"""Grouped and global aggregates, frequency tables, crosstabs, correlations, column summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.values import pct
from basketry.operators.moments import co_moments
from basketry.operators.ordering import as_list, quantile_columns, with_group_total


def aggregate(
    df: DataFrame, keys: str | Sequence[str], specs: Mapping[str, Column], keep_null_keys: bool = True
) -> DataFrame:
    """Named aggregates per key; groups with a null key can be left out."""
    keys = as_list(keys)
    if not keep_null_keys:
        df = df.na.drop(subset=keys)
    return df.groupBy(*keys).agg(*[value.alias(name) for name, value in specs.items()])


def having(df: DataFrame, keys: str | Sequence[str], specs: Mapping[str, Column], cond: Column) -> DataFrame:
    return aggregate(df, keys, specs).filter(cond)


def summary_row(df: DataFrame, specs: Mapping[str, Column]) -> DataFrame:
    return df.agg(*[value.alias(name) for name, value in specs.items()])


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows, or distinct combinations of some columns."""
    return df.distinct() if cols is None else df.select(*cols).distinct()


def with_global(df: DataFrame, name: str, agg: Column) -> DataFrame:
    """One aggregate over all rows, repeated on each of them (a one-row broadcast)."""
    return with_group_total(df, None, {name: agg})


def frequency_table(df: DataFrame, col: str, name: str = "rows") -> DataFrame:
    """Count and percentage per value; the null value counts too."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    total = counts.agg(F.sum(name).alias("__total"))
    return counts.crossJoin(F.broadcast(total)).select(col, name, pct(F.col(name), F.col("__total")).alias("percentage"))


def share_of_total(df: DataFrame, value: str, by: str | Sequence[str], name: str = "share") -> DataFrame:
    """Each row's part of its group's sum."""
    summed = with_group_total(df, by, {"__total": F.sum(value)})
    return summed.withColumn(name, F.try_divide(F.col(value).cast("double"), F.col("__total"))).drop("__total")


def crosstab(
    df: DataFrame, a: str, b: str, values: Sequence, margins: bool = True, names: Sequence[str] | None = None
) -> DataFrame:
    """Counts of `a` by the listed values of `b`, with an `All` row and column on request."""
    names = list(names or [str(v) for v in values])
    base = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    counts = [F.count_if(F.col(b) == F.lit(v)).alias(n) for v, n in zip(values, names)]
    if not margins:
        return base.groupBy(F.col(a).cast("string").alias(a)).agg(*counts)
    every = F.count(F.lit(1)).alias("All")
    cells = base.groupBy(F.col(a).cast("string").alias(a)).agg(*counts, every)
    totals = cells.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*names, "All"]])
    return cells.unionByName(totals.withColumn(a, F.lit("All")))


def unpivot_row(row: DataFrame, key: str, cells: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Turn one wide row into one row per entry: `{entry: {column: expression}}`."""
    entries = F.array(
        *[
            F.struct(F.lit(entry).alias(key), *[value.alias(name) for name, value in columns.items()])
            for entry, columns in cells.items()
        ]
    )
    return row.select(F.inline(entries))


def describe_long(df: DataFrame, cols: Sequence[str], ps: Sequence[float] = (0.25, 0.5, 0.75), **limits: int) -> DataFrame:
    """count, mean, std, min, quantiles and max: one row per column."""
    wide = df.agg(
        *[
            agg(F.col(c).cast("double")).alias(f"{c}__{name}")
            for c in cols
            for name, agg in [
                ("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max),
            ]
        ]
    )
    wanted = {f"{c}__p{i}": (c, p) for c in cols for i, p in enumerate(ps)}
    wide = wide.crossJoin(quantile_columns(df, wanted, **limits))
    cells = {
        c: {
            **{name: F.col(f"`{c}__{name}`") for name in ["count", "mean", "std", "min"]},
            **{quantile_name(p): F.col(f"`{c}__p{i}`") for i, p in enumerate(ps)},
            "max": F.col(f"`{c}__max`"),
        }
        for c in cols
    }
    return unpivot_row(wide, "column", cells)


def quantile_name(p: float) -> str:
    """0.05 → p05, 0.5 → p50."""
    return "p" + f"{p * 100:g}".replace(".", "_").zfill(2)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, each pair once: (feature_a, feature_b, correlation).

    One pass for all pairs, each over the rows that know both columns; null with fewer than two of them.
    """
    pairs = co_moments(df, cols).filter("a < b")
    named = F.array(*[F.lit(c) for c in cols])
    value = F.when(F.col("n") > 1, F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")))
    listed = df.sparkSession.range(len(cols)).select(F.col("id").cast("int").alias("a"))
    every = listed.join(listed.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    return every.join(pairs, ["a", "b"], "left").select(
        F.get(named, F.col("a")).alias("feature_a"), F.get(named, F.col("b")).alias("feature_b"), value.alias("correlation")
    )


def correlated_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.8) -> DataFrame:
    """Pairs whose correlation is at least `threshold` in absolute value."""
    return correlation_matrix(df, cols).filter(F.abs("correlation") >= threshold)
