"""Sorting and top-n selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.ordering import Order, as_columns, as_list


def sort(df: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Sort by (column, "asc" | "desc") pairs; nulls last, as in the source reports."""
    return df.orderBy(
        *[F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in keys]
    )


def top_n(df: DataFrame, col: str, n: int, tie: str | Sequence[str], ascending: bool = False) -> DataFrame:
    """First n rows by value, ties by key: every task keeps n rows, one merges them."""
    first = F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_last()
    return df.orderBy(first, *as_list(tie)).limit(n)


def top_n_per_group(
    df: DataFrame, by: str | Sequence[str], order: str | Order, n: int, name: str = "rank"
) -> DataFrame:
    """First n rows of each group.

    The filter on row_number lets Spark keep only n rows per group in each task
    before the shuffle (WindowGroupLimit), so a hot group arrives already cut.
    """
    over = Window.partitionBy(*as_list(by)).orderBy(*as_columns(order))
    return df.withColumn(name, F.row_number().over(over)).filter(F.col(name) <= n)


def latest_complete_weeks(
    tx: DataFrame, before: int, n: int = 8, week: str = "WEEK_NO", day: str = "DAY"
) -> DataFrame:
    """The latest n weeks that have all seven days and end before a given day."""
    weeks = tx.groupBy(week).agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.countDistinct(day).alias("days")
    )
    whole = (F.col("first_day") < F.col("last_day")) & (F.col("days") == 7) & (F.col("last_day") < before)
    return weeks.filter(whole).orderBy(F.col(week).desc()).limit(n).select(week)
