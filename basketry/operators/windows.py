"""Per-series windows and ranks.

`add_lags`, `add_trailing` and `period_change` work on series with one row per
period, so a group is bounded by the calendar. Ranks are over rows of any
number and go through `ordering`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.ordering import (
    Order,
    as_columns,
    as_list,
    number_rows,
    previous,
    with_group_total,
)

__all__ = [
    "number_rows", "previous", "add_lags", "add_trailing", "period_change", "time_index",
    "rank_by_score", "rank_first", "rank_percentile",
]

TRAILING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def add_lags(
    df: DataFrame, col: str, lags: Sequence[int], by: str | Sequence[str] = (), order: str | Order = "date"
) -> DataFrame:
    """`lag_k` per series for each k."""
    over = Window.partitionBy(*as_list(by)).orderBy(*as_columns(order))
    return df.withColumns({f"lag_{k}": F.lag(col, k).over(over) for k in lags})


def add_trailing(
    df: DataFrame,
    col: str,
    windows: Sequence[int],
    stats: Sequence[str],
    by: str | Sequence[str] = (),
    order: str | Order = "date",
    min_periods: int | None = None,
    prefix: str = "rolling",
) -> DataFrame:
    """`{prefix}_{stat}_{w}` over the w rows before the current one.

    A value needs a full window, or `min_periods` known values.
    """
    added = {}
    for w in windows:
        frame = Window.partitionBy(*as_list(by)).orderBy(*as_columns(order)).rowsBetween(-w, -1)
        enough = F.count(col).over(frame) >= (w if min_periods is None else min_periods)
        for stat in stats:
            added[f"{prefix}_{stat}_{w}"] = F.when(enough, TRAILING[stat](col).over(frame))
    return df.withColumns(added)


def period_change(
    df: DataFrame, col: str, by: str | Sequence[str], order: str | Order, name: str | None = None
) -> DataFrame:
    """Difference to the preceding period of the series."""
    over = Window.partitionBy(*as_list(by)).orderBy(*as_columns(order))
    return df.withColumn(name or f"{col}_change", F.col(col) - F.lag(col).over(over))


def time_index(df: DataFrame, date: str, by: str | Sequence[str] = (), name: str = "time_index") -> DataFrame:
    """0-based day number in a gap-free series: days since its start, without ordering the rows."""
    starts = with_group_total(df, by, {"__start": F.min(date)})
    return starts.withColumn(name, F.datediff(F.col(date), F.col("__start"))).drop("__start")


def rank_by_score(
    df: DataFrame, score: str, id: str, by: str | Sequence[str] = (), name: str = "decision_rank", **limits: int
) -> DataFrame:
    """Rank 1 for the highest score; equal scores in id order."""
    return number_rows(df, by, [F.col(score).desc(), F.col(id).asc()], name, **limits)


def rank_first(df: DataFrame, score: str, id: str | Sequence[str], name: str, **limits: int) -> DataFrame:
    """Distinct descending ranks over all rows, ties in id order."""
    return number_rows(df, None, [F.col(score).desc(), *[F.col(i).asc() for i in as_list(id)]], name, **limits)


def rank_percentile(df: DataFrame, rank: str, by: str | Sequence[str] = (), name: str = "rank_percentile") -> DataFrame:
    """rank / group size."""
    sized = with_group_total(df, by, {"__n": F.count(F.lit(1))})
    return sized.withColumn(name, F.col(rank) / F.col("__n")).drop("__n")
