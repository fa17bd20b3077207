"""Positions, running totals and exact quantiles over groups of any size.

A window function brings a whole group into one task. That is the right plan
while every group is small, and each operator here probes for it with one
map-side combined count per group. Where some group is larger than
`group_rows`, rows are range-partitioned by (group, order) instead, so one hot
group spreads over many tasks; only one subtotal per (group, slice) is then
needed to turn local results into global ones. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import cut_lineage

GROUP_ROWS = 4_000_000
DISTINCT_VALUES = 1_000_000

Order = Sequence[str | Column]


def as_list(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def as_columns(order: str | Column | Order) -> list[Column]:
    items = [order] if isinstance(order, str | Column) else list(order)
    return [F.col(o) if isinstance(o, str) else o for o in items]


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def join_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach per-group values to rows; null keys match, the group table is small or hashed by key."""
    keys = list(keys)
    extra = [c for c in groups.columns if c not in keys]
    if not keys:
        return df.crossJoin(F.broadcast(groups))
    renamed = groups.select(*[F.col(k).alias(f"__g_{k}") for k in keys], *extra)
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__g_{key}"))
    return df.join(renamed, condition, how).drop(*[f"__g_{k}" for k in keys])


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group; one number reaches the driver."""
    if not by:
        return df.count()
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _slices(df: DataFrame, by: Sequence[str], order: list[Column]) -> DataFrame:
    """All rows in (by, order), cut into ranges: `__slice` numbers the range, `__row` the row in it.

    The position is stored by a checkpoint, so a retried task cannot change it.
    """
    keys = [F.col(b) for b in by] + order
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut_lineage(placed.withColumn("__at", F.monotonically_increasing_id()))
    return placed.withColumns(
        {"__slice": F.shiftright("__at", 33), "__row": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}
    ).drop("__at")


def _earlier_slices(subtotals: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """For each (group, slice): the group's totals over the slices before it."""
    before = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    return subtotals.withColumns({f"__b_{n}": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in names})


def number_rows(
    df: DataFrame,
    by: str | Sequence[str] | None,
    order: str | Order,
    name: str,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Position of each row in its group, from 1. `order` has to be unique within a group."""
    by, keys = as_list(by), as_columns(order)
    if largest_group(df, by) <= group_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*keys)).cast("long"))
    cut = _slices(df, by, keys)
    spans = cut.groupBy(*by, "__slice").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    spans = _earlier_slices(spans, by, ["__n"]).drop("__n")
    placed = join_groups(cut, spans, [*by, "__slice"])
    return placed.withColumn(name, F.col("__row") - F.col("__first") + F.col("__b___n") + 1).drop(
        "__slice", "__row", "__first", "__b___n"
    )


def running_totals(
    df: DataFrame,
    by: str | Sequence[str] | None,
    order: str | Order,
    totals: Mapping[str, Column],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Sum of each expression over the group's rows up to and including this one."""
    by, keys = as_list(by), as_columns(order)
    if largest_group(df, by) <= group_rows:
        upto = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(value).over(upto) for name, value in totals.items()})
    cut = _slices(df.withColumns({f"__v_{n}": v for n, v in totals.items()}), by, keys)
    spans = cut.groupBy(*by, "__slice").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in totals])
    spans = _earlier_slices(spans, by, [f"__s_{n}" for n in totals]).drop(*[f"__s_{n}" for n in totals])
    upto = (
        Window.partitionBy(*by, "__slice").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    )
    local = join_groups(cut, spans, [*by, "__slice"])
    local = local.withColumns({n: F.sum(f"__v_{n}").over(upto) + F.col(f"__b___s_{n}") for n in totals})
    return local.drop(
        "__slice", "__row", *[f"__v_{n}" for n in totals], *[f"__b___s_{n}" for n in totals]
    )


def previous(
    df: DataFrame,
    col: str,
    by: str | Sequence[str],
    order: str | Order,
    name: str | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Value of the preceding row of the group."""
    by, keys, name = as_list(by), as_columns(order), name or f"previous_{col}"
    if largest_group(df, by) <= group_rows:
        return df.withColumn(name, F.lag(col).over(Window.partitionBy(*by).orderBy(*keys)))
    numbered = number_rows(df, by, keys, "__at", group_rows)
    shifted = numbered.select(*by, (F.col("__at") + 1).alias("__at"), F.col(col).alias(name))
    return join_groups(numbered, shifted, [*by, "__at"], "left").drop("__at")


def with_group_total(
    df: DataFrame, by: str | Sequence[str] | None, totals: Mapping[str, Column]
) -> DataFrame:
    """Attach aggregates of each row's group (of all rows without `by`).

    Aggregate-and-join instead of a window: partial sums are combined before
    the shuffle, so a hot group never has to fit into one task.
    """
    by = as_list(by)
    values = [value.alias(name) for name, value in totals.items()]
    groups = df.groupBy(*by).agg(*values) if by else df.agg(*values)
    return join_groups(df, groups, by)


def quantiles(
    df: DataFrame,
    col: str,
    ps: Sequence[float],
    by: str | Sequence[str] | None = (),
    distinct_values: int = DISTINCT_VALUES,
) -> DataFrame:
    """Exact percentiles with linear interpolation: one row per group and p.

    Equal values are counted before anything is ordered. If a group has more
    distinct values than one task should hold, the two neighbours of each
    position are found through distributed running counts.
    """
    by, ps = as_list(by), [float(p) for p in ps]
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("__x")).agg(
        F.count(F.lit(1)).alias("__c")
    )
    wanted = F.array(*[F.lit(p) for p in ps])
    if largest_group(counts, by) <= distinct_values:
        found = F.percentile("__x", wanted, F.col("__c")).alias("__q")
        values = counts.groupBy(*by).agg(found) if by else counts.agg(found)
        pairs = F.arrays_zip(wanted.alias("p"), F.col("__q").alias("value"))
        return values.filter("__q is not null").select(*by, F.explode(pairs).alias("r")).select(
            *by, F.col("r.p").alias("p"), F.col("r.value").alias("value")
        )
    upto = running_totals(counts, by, "__x", {"__upto": F.col("__c")}, distinct_values)
    upto = cut_lineage(upto)
    sizes = upto.groupBy(*by).agg(F.sum("__c").alias("__n")) if by else upto.agg(F.sum("__c").alias("__n"))
    placed = join_groups(upto, sizes, by).withColumn("p", F.explode(wanted))
    at = (F.col("__n") - 1) * F.col("p")
    first, last = F.col("__upto") - F.col("__c"), F.col("__upto")
    low, high = F.floor(at), F.ceil(at)
    has_low, has_high = (first <= low) & (low < last), (first <= high) & (high < last)
    ends = placed.filter(has_low | has_high).groupBy(*by, "p").agg(
        F.max(F.when(has_low, F.col("__x").cast("double"))).alias("__lo"),
        F.max(F.when(has_high, F.col("__x").cast("double"))).alias("__hi"),
        F.max(at - low).alias("__t"),
    )
    value = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__t")
    return ends.select(*by, "p", value.alias("value"))


def quantile_columns(
    df: DataFrame,
    wanted: Mapping[str, tuple[str, float]],
    by: str | Sequence[str] | None = (),
    distinct_values: int = DISTINCT_VALUES,
) -> DataFrame:
    """Named quantiles side by side: `{name: (column, p)}`, one row per group."""
    by = as_list(by)
    result = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__rows")) if by else df.agg(F.count(F.lit(1)).alias("__rows"))
    for col in dict.fromkeys(c for c, _ in wanted.values()):
        named = {name: p for name, (c, p) in wanted.items() if c == col}
        long = quantiles(df, col, sorted(set(named.values())), by, distinct_values)
        picks = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(n) for n, p in named.items()]
        wide = long.groupBy(*by).agg(*picks) if by else long.agg(*picks)
        result = join_groups(result, wide, by, "left")
    return result.drop("__rows")
