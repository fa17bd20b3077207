"""Conditional, guarded and banded values, and the aggregate expressions built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(n: Column, d: Column, scale: int | None = None, on_zero: float | None = None) -> Column:
    """n / d; a zero or null denominator gives `on_zero` (null by default)."""
    value = F.try_divide(n.cast("double"), d.cast("double"))
    if on_zero is not None:
        value = F.when(d.isNull() | (d == 0), F.lit(float(on_zero))).otherwise(value)
    return value if scale is None else F.round(value, scale)


def round_double(value: Column, digits: int) -> Column:
    """`round` of a double, half-up, for tables of many rows: decimals are built only near a half and for numbers too large to scale."""
    scale = F.lit(10.0**digits)
    moved = value * scale + F.lit(0.5)
    whole = F.floor(moved)
    clear = (F.abs(value * scale) < F.lit(1e11)) & (moved - whole).between(1e-4, 1 - 1e-4)
    return F.when(clear, whole / scale).otherwise(F.round(value, digits))


def positive_ratio(n: Column, d: Column) -> Column:
    """n / d where d > 0, else 0.0."""
    return F.when(d > 0, F.try_divide(n.cast("double"), d.cast("double"))).otherwise(F.lit(0.0))


def pct(n: Column, d: Column, scale: int | None = None) -> Column:
    return ratio(100.0 * n, d, scale)


def count_when(cond: Column) -> Column:
    return F.count_if(cond)


def count_distinct(col: Column | str) -> Column:
    return F.countDistinct(col)


def std(col: Column | str) -> Column:
    return F.stddev_samp(col)


def sum0(col: Column | str) -> Column:
    """Sum where a group without any value adds up to 0, not null."""
    return F.coalesce(F.sum(col), F.lit(0))


def first_value_by(col: str, order: str) -> Column:
    """First non-null value of a group by an explicit order key."""
    return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(order)))


def joined_set(col: Column, sep: str = " | ") -> Column:
    """Sorted distinct values of a group as one string; nulls are left out."""
    return F.array_join(F.sort_array(F.collect_set(col.cast("string"))), sep)


def clip(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Keep nulls; bound the rest."""
    value = col
    if low is not None:
        value = F.when(value.isNotNull(), F.greatest(value, F.lit(low)))
    if high is not None:
        value = F.when(value.isNotNull(), F.least(value, F.lit(high)))
    return value


def band(col: Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Label of the interval (edge, next edge] a value falls in; null outside all of them."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval is needed")
    value = F.lit(None).cast("string")
    for i in reversed(range(len(labels))):
        low, high = float(edges[i]), float(edges[i + 1])
        above = col >= low if include_lowest and i == 0 else col > low
        inside = above if high == float("inf") else above & (col <= high)
        value = F.when(inside, F.lit(labels[i])).otherwise(value)
    return value


def coalesce0(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def ladder(steps: Sequence[tuple[Column, Any]], default: Any = None) -> Column:
    """First matching condition wins."""
    tail = F.lit(default)
    return reduce(lambda rest, step: F.when(step[0], F.lit(step[1])).otherwise(rest), reversed(list(steps)), tail)


def map_labels(col: Column, labels: Mapping[Any, str], default: str | None = None) -> Column:
    """Static label per value, with a default for the rest."""
    mapping = F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])
    return F.coalesce(F.try_element_at(mapping, col), F.lit(default))


def record_id(pattern: str, *cols: Column) -> Column:
    """Identifier composed by a printf pattern."""
    return F.format_string(pattern, *cols)


def target_count(n: Column, fraction: Column | float) -> Column:
    """Size of the top fraction: floor of the double product, at least one."""
    share = F.lit(float(fraction)) if isinstance(fraction, int | float) else fraction.cast("double")
    return F.greatest(F.lit(1).cast("long"), F.floor(n.cast("double") * share).cast("long"))
