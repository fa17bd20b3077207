"""Joins with a stated cardinality, existence tests, interval joins and as-of roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.ordering import as_list


#: Values that are marked as bits, in `has_repeats_among`.
LISTED = 1024


def left_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right, as_list(on), "left")


def inner_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right, as_list(on), "inner")


def cross_one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row aggregates side by side."""
    return a.crossJoin(F.broadcast(b))


def has_repeats(df: DataFrame, on: str | Sequence[str]) -> bool:
    """Does a non-null key occur twice? Stops at the first one."""
    on = as_list(on)
    repeated = df.na.drop(subset=on).groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return not repeated.limit(1).isEmpty()


def has_repeats_among(df: DataFrame, key: str, among: str) -> bool:
    """Does a non-null pair (key, among) occur twice, where `among` has few values?

    A key's values are marked as bits of a few numbers, so a row per key is shuffled and not one per pair. Many values are left to `has_repeats`.
    """
    known = df.select(key, among).na.drop()
    listed = known.agg(F.sort_array(F.collect_set(among)).alias("__listed"))
    count = known.select(among).distinct().limit(LISTED + 1).count()
    if count > LISTED:
        return has_repeats(known, [key, among])
    at = F.array_position("__listed", F.col(among)) - 1
    placed = known.crossJoin(F.broadcast(listed)).select(key, at.cast("int").alias("__at"))
    bit = F.expr("shiftleft(1L, __at % 64)")
    words = [f"__w{i}" for i in range(-(-count // 64))]
    marks = [F.bit_or(F.when(F.floor(F.col("__at") / 64) == i, bit).otherwise(F.lit(0).cast("long"))).alias(w) for i, w in enumerate(words)]
    seen = placed.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *marks)
    marked = reduce(Column.__add__, [F.bit_count(w) for w in words], F.lit(0))
    return not seen.filter(F.col("__n") > marked).limit(1).isEmpty()


def checked_join(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left", validate: str = "m:1"
) -> DataFrame:
    """Join that raises if a side stated to be unique (`m:1`, `1:1`, `1:m`) repeats a key."""
    left_side, right_side = validate.split(":")
    if right_side == "1" and has_repeats(right, on):
        raise ValueError(f"keys {as_list(on)} repeat on the right side of a {validate} join")
    if left_side == "1" and has_repeats(left, on):
        raise ValueError(f"keys {as_list(on)} repeat on the left side of a {validate} join")
    return left.join(right, as_list(on), how)


def join_preserving(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> tuple[DataFrame, int]:
    """Left join that has to keep the row count; also returns how many rows found no partner."""
    on = as_list(on)
    marked = left.join(right.withColumn("__hit", F.lit(True)), on, "left")
    rows, unmatched = marked.agg(F.count(F.lit(1)), F.count_if(F.col("__hit").isNull())).first()
    if rows != left.count():
        raise ValueError("the join changed the row count")
    return marked.drop("__hit"), unmatched


def orphans(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Distinct non-null child keys without a parent."""
    keys = child.select(F.col(child_col)).na.drop().distinct()
    known = parent.select(F.col(parent_col).alias(child_col))
    return keys.join(known, child_col, "left_anti")


def semi_filter(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is in a set of ids."""
    return df.join(ids, as_list(on), "left_semi")


def exists_flag(df: DataFrame, ids: DataFrame, on: str | Sequence[str], name: str) -> DataFrame:
    """Boolean per row: is the key in a set of ids?"""
    on = as_list(on)
    known = ids.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(known, on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def match_coverage(left: DataFrame, right: DataFrame, on: str, by: str | Sequence[str]) -> DataFrame:
    """Per group: distinct keys, how many of them occur on the other side, and that share in percent."""
    by = as_list(by)
    keys = left.select(*by, on).distinct()
    marked = exists_flag(keys, right, on, "__hit")
    counted = marked.groupBy(*by).agg(F.count(on).alias("total"), F.count_if("__hit").alias("matched"))
    return counted.withColumn("coverage_pct", F.try_divide(100.0 * F.col("matched"), F.col("total")))


def without_overlap(
    members: DataFrame,
    assignments: DataFrame,
    windows: DataFrame,
    key: str,
    targets: DataFrame,
    group: str,
    start: str,
    end: str,
) -> DataFrame:
    """(member, target) rows for which the member holds no other assignment overlapping the target window.

    `windows` gives the interval of each `group`, `targets` the windows looked at; both are joined by equality only, and rows that are no interval
    (an end unknown or before the start) overlap nothing. Endpoints are sorted once per member: of the intervals it holds, those that
    overlap a target are those begun by the target's end, less those ended before its start. So a member with many
    assignments costs a sort of them and not a comparison of each pair, and nothing is broadcast by a hint.
    """
    whole = F.col(start) <= F.col(end)
    held = assignments.select(key, group).na.drop().distinct().join(windows.filter(whole).select(group, start, end).distinct(), group)
    aims = targets.filter(whole).select(F.col(group), F.col(start).alias("__from"), F.col(end).alias("__to"))
    asked = members.select(key, group).na.drop().distinct().join(aims, group)

    def events(rows: DataFrame, at: str, kind: int) -> DataFrame:
        # among equal times: a target's start, starts, ends, a target's end
        target = F.col(group) if kind in (0, 3) else F.lit(None).cast(rows.schema[group].dataType)
        return rows.select(key, F.col(at).alias("__at"), F.lit(kind).alias("__kind"), target.alias("__target"))

    moments = reduce(DataFrame.unionByName, [events(asked, "__from", 0), events(held, start, 1), events(held, end, 2), events(asked, "__to", 3)])
    upto = Window.partitionBy(key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = moments.withColumns({"__begun": F.count_if(F.col("__kind") == 1).over(upto), "__ended": F.count_if(F.col("__kind") == 2).over(upto)})
    # a target listed with several windows is asked once for each
    around = counted.filter("__target IS NOT NULL").groupBy(key, F.col("__target").alias(group)).agg(
        (F.sum(F.when(F.col("__kind") == 3, F.col("__begun")).otherwise(0)) - F.sum(F.when(F.col("__kind") == 0, F.col("__ended")).otherwise(0))).alias("__n")
    )
    # the target itself, where the member holds it
    own = held.join(aims, group).filter((F.col(start) <= F.col("__to")) & (F.col(end) >= F.col("__from"))).groupBy(key, group).agg(F.count(F.lit(1)).alias("__own"))
    clash = around.join(own, [key, group], "left").filter(F.col("__n") > F.coalesce("__own", F.lit(0))).select(key, group)
    return members.join(clash, [key, group], "left_anti")


def window_totals(
    entities: DataFrame, events: DataFrame, key: str, time: str, lo: Column, hi: Column, totals: Mapping[str, Column]
) -> DataFrame:
    """Totals of each entity row's events with lo <= time <= hi; entities without any keep a row.

    `lo` and `hi` are literals or columns of `entities`. `events` should already
    be combined to one row per (key, time), which is what keeps a hot key small.
    """
    facts = events.withColumnRenamed(key, "__key")
    inside = (F.col("__key") == F.col(key)) & F.col(time).between(lo, hi)
    joined = entities.join(facts, inside, "left")
    return joined.groupBy(*entities.columns).agg(*[value.alias(name) for name, value in totals.items()])


def attach_cutoffs(df: DataFrame, cutoffs: DataFrame, col: str = "cutoff_timestamp") -> DataFrame:
    """The sorted cutoffs as one array on every row: a one-row broadcast of a list bounded by the calendar."""
    listed = cutoffs.agg(F.sort_array(F.collect_set(col)).alias("cutoffs"))
    return df.crossJoin(F.broadcast(listed))


def first_cutoff_index(time: Column) -> Column:
    """Index of the first cutoff not before `time`; equals the array size when there is none."""
    return F.size(F.filter("cutoffs", lambda c: c < time))


def run_forward(steps: DataFrame, key: Sequence[str], sums: Sequence[str], latest: Sequence[str] = ()) -> DataFrame:
    """From totals per (key, index `at` of a cutoff) to running totals; `next_at` is the key's next index.

    `latest` columns carry their highest value so far. A window sees at most one row per cutoff of a key.
    """
    over = Window.partitionBy(*key).orderBy("at")
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumns(
        {
            **{s: F.sum(s).over(upto) for s in sums},
            **{c: F.max(c).over(upto) for c in latest},
            "next_at": F.lead("at").over(over),
        }
    )


def along_cutoffs(run: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Each row of `run_forward` once per cutoff from its own up to the next index.

    Adds `cutoff` and `age`, the number of cutoffs since the totals last changed. The list of cutoffs
    is attached here, and only the stretch a row covers is exploded.
    """
    placed = attach_cutoffs(run, cutoffs)
    stretch = F.slice("cutoffs", F.col("at") + 1, F.coalesce("next_at", F.size("cutoffs")) - F.col("at"))
    columns = [c for c in run.columns if c != "next_at"]
    return placed.select(*columns, F.posexplode(stretch).alias("age", "cutoff"))


def fill_forward_cutoffs(
    steps: DataFrame, key: Sequence[str], sums: Sequence[str], cutoffs: DataFrame, latest: Sequence[str] = ()
) -> DataFrame:
    """From totals per (key, index `at` of a cutoff) to running totals at that cutoff and all later ones, with `cutoff` and `age`."""
    return along_cutoffs(run_forward(steps, key, sums, latest), cutoffs)


def as_of_history(
    facts: DataFrame, cutoffs: DataFrame, key: str, time: str, totals: Mapping[str, Column]
) -> DataFrame:
    """Sums over each key's facts at or before each cutoff: one row per key and cutoff with any history.

    Facts are combined per (key, first cutoff that sees them) and then run
    forward, so a fact is shuffled once and never copied per cutoff.
    """
    placed = attach_cutoffs(facts.filter(F.col(key).isNotNull()), cutoffs)
    placed = placed.withColumn("at", first_cutoff_index(F.col(time))).filter(F.col("at") < F.size("cutoffs"))
    steps = placed.groupBy(key, "at").agg(*[F.sum(v).alias(n) for n, v in totals.items()])
    filled = fill_forward_cutoffs(steps, [key], list(totals), cutoffs)
    return filled.select(key, F.col("cutoff").alias("cutoff_timestamp"), *totals)


def happens_within(facts: DataFrame, cutoffs: DataFrame, key: str, time: str, days: int) -> DataFrame:
    """Distinct (key, cutoff) with a fact in (cutoff, cutoff + days]."""
    placed = attach_cutoffs(facts.filter(F.col(key).isNotNull()), cutoffs)
    return placed.select(key, F.explode(_followed(time, days)).alias("cutoff_timestamp")).distinct()


def listed_within(facts: DataFrame, cutoffs: DataFrame, key: str, time: str, days: int, name: str = "cutoffs_within") -> DataFrame:
    """The same as one row per key: the array of its cutoffs, each once. Keys without any have no row."""
    placed = attach_cutoffs(facts.filter(F.col(key).isNotNull()), cutoffs)
    return placed.select(key, F.explode(_followed(time, days)).alias("__at")).groupBy(key).agg(F.collect_set("__at").alias(name))


def _followed(time: str, days: int) -> Column:
    """The cutoffs that a fact follows by at most `days`."""
    span = F.make_dt_interval(F.lit(days))
    return F.filter("cutoffs", lambda c: (F.col(time) > c) & (F.col(time) <= c + span))


def fill_calendar(
    df: DataFrame,
    date: str,
    value: str,
    by: str | Sequence[str] = (),
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """One row per day and series from first to last date, zero where nothing was seen.

    The calendar of each series starts at its own first day; `start`/`end` override it.
    """
    by = as_list(by)
    first = F.min(date) if start is None else F.lit(start).cast("date")
    last = F.max(date) if end is None else F.lit(end).cast("date")
    spans = df.groupBy(*by).agg(first.alias("__a"), last.alias("__b")) if by else df.agg(first.alias("__a"), last.alias("__b"))
    days = spans.filter("__a is not null").select(*by, F.explode(F.sequence("__a", "__b", F.expr("interval 1 day"))).alias(date))
    return days.join(df, [*by, date], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))
