"""Data-quality checks and reconciliations.

A check is one row (check, column, status, observed, expected, severity).
Predicates over the same table are evaluated together: one aggregate pass for
all of them, and one grouped pass per uniqueness key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from basketry.functions.dates import days_between
from basketry.functions.text import has_word
from basketry.functions.values import pct
from basketry.operators.aggregates import unpivot_row
from basketry.operators.joins import listed_within, orphans
from basketry.operators.ordering import as_list
from basketry.operators.sets import union_all

RESULT = "check string, column string, status string, observed bigint, expected string, severity string"

# Rules a contract may name: id → (checked column, SQL predicate, whether a hit is a violation).
RULES: dict[str, tuple[str, str, bool]] = {
    "ORD-007": (
        "order_delivered_customer_date",
        "order_delivered_customer_date is not null and order_delivered_customer_date < order_purchase_timestamp",
        True,
    ),
    "ORD-008": (
        "order_delivered_customer_date",
        "order_status = 'delivered' and order_delivered_customer_date is null",
        False,
    ),
}


class _Pass:
    """Checks on one table that share a single aggregate."""

    def __init__(self, df: DataFrame):
        self.df, self.counters, self.rows = df, [], []

    def add(self, check: str, column: str | None, counter: Column, expected: int | None, severity: str, note: str | None = None):
        """`expected` None marks an observation that always passes."""
        name = f"m{len(self.counters)}"
        self.counters.append(counter.alias(name))
        observed = F.coalesce(F.col(name), F.lit(0)).cast("bigint")
        passed = F.lit(True) if expected is None else observed == F.lit(expected)
        self.rows.append(
            F.struct(
                F.lit(check).alias("check"),
                F.lit(column).cast("string").alias("column"),
                F.when(passed, "PASS").otherwise("FAIL").alias("status"),
                observed.alias("observed"),
                F.lit(note if expected is None else str(expected)).alias("expected"),
                F.lit(severity).alias("severity"),
            )
        )

    def results(self) -> DataFrame:
        return self.df.agg(*self.counters).select(F.inline(F.array(*self.rows)))


def _single(df: DataFrame, *args: Any) -> DataFrame:
    one = _Pass(df)
    one.add(*args)
    return one.results()


def check_not_null(df: DataFrame, col: str | Sequence[str], severity: str = "critical") -> DataFrame:
    one = _Pass(df)
    for c in as_list(col):
        one.add("not_null", c, F.count_if(F.col(c).isNull()), 0, severity)
    return one.results()


def check_accepted_values(df: DataFrame, col: str, values: Sequence[Any], severity: str = "critical") -> DataFrame:
    """Nulls are not judged."""
    return _single(df, "accepted_values", col, F.count_if(F.col(col).isNotNull() & ~F.col(col).isin(list(values))), 0, severity)


def check_row_count(df: DataFrame, expected: int, severity: str = "critical") -> DataFrame:
    return _single(df, "row_count", None, F.count(F.lit(1)), expected, severity)


def check_rule(df: DataFrame, predicate: str | Column, id: str, column: str | None = None, severity: str = "critical") -> DataFrame:
    """`predicate` describes a violation."""
    cond = F.expr(predicate) if isinstance(predicate, str) else predicate
    return _single(df, id, column, F.count_if(cond), 0, severity)


def observe_rule(df: DataFrame, predicate: str | Column, id: str, column: str | None = None, severity: str = "warning") -> DataFrame:
    """Counts something without judging it."""
    cond = F.expr(predicate) if isinstance(predicate, str) else predicate
    return _single(df, id, column, F.count_if(cond), None, severity, "tracked explicitly")


def check_unique(
    df: DataFrame, cols: str | Sequence[str], mode: str = "rows_minus_distinct", severity: str = "critical", check: str = "unique"
) -> DataFrame:
    """`rows_minus_distinct`/`beyond_first`: rows in excess of one per key, null being a key value.
    `groups`: number of keys that occur more than once."""
    cols = as_list(cols)
    keys = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    if mode == "groups":
        counter = F.count_if(F.col("n") > 1)
    elif mode in ("rows_minus_distinct", "beyond_first"):
        counter = F.sum(F.col("n") - 1)
    else:
        raise ValueError(f"unknown uniqueness mode: {mode}")
    return _single(keys, check, ",".join(cols), counter, 0, severity)


def check_fk(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str, name: str | None = None) -> DataFrame:
    """Distinct child keys without a parent."""
    return _single(
        orphans(child, child_col, parent, parent_col),
        "foreign_key", name or f"{child_col} -> {parent_col}", F.count(F.lit(1)), 0, "critical",
    )


def validate(df: DataFrame, contract: Mapping[str, Any], skip_reconciliation: bool = False) -> DataFrame:
    """All checks a contract declares: schema, then reconciliation, then registered rules.

    A rule id that nothing is registered for is reported as SKIPPED.
    """
    one, unique, skipped = _Pass(df), [], []
    for spec in contract.get("schema", []):
        c = spec["name"]
        if spec.get("nullable") is False:
            one.add("not_null", c, F.count_if(F.col(c).isNull()), 0, "critical")
        if spec.get("unique") is True:
            unique.append(check_unique(df, c))
        if "accepted_values" in spec:
            bad = F.col(c).isNotNull() & ~F.col(c).isin(list(spec["accepted_values"]))
            one.add("accepted_values", c, F.count_if(bad), 0, "critical")
    expected = contract.get("reconciliation", {}).get("expected_order_population")
    if expected is not None and not skip_reconciliation:
        one.add("row_count", None, F.count(F.lit(1)), int(expected), "critical")
    for rule in contract.get("quality_rules", []):
        severity = rule.get("severity", "critical")
        if rule.get("id") in RULES:
            column, predicate, violation = RULES[rule["id"]]
            one.add(rule["id"], column, F.count_if(F.expr(predicate)), 0 if violation else None, severity, "tracked explicitly")
        else:
            skipped.append((rule.get("id"), None, "SKIPPED", None, "no registered rule", severity))
    parts = ([one.results()] if one.rows else []) + unique
    if skipped:
        parts.append(df.sparkSession.createDataFrame(skipped, RESULT))
    return union_all(*parts)


def summarize(results: DataFrame) -> DataFrame:
    """total / passed / failed / overall of the checks that ran; a failed warning fails the whole."""
    counted = results.agg(
        F.count_if(F.col("status") != "SKIPPED").alias("total_checks"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
    )
    return counted.withColumn("status", F.when(F.col("failed") == 0, "PASS").otherwise("FAIL"))


def reconcile(src: DataFrame, dst: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row counts, column names and order, and the candidate key of the target."""
    expected = src.count()
    checks = [
        check_row_count(dst, expected),
        _schema_row(dst.sparkSession, "column_order", src.columns == dst.columns),
    ]
    if keys:
        any_null = F.lit(False)
        for k in keys:
            any_null = any_null | F.col(k).isNull()
        checks.append(check_rule(dst, any_null, "candidate_key_null_rows", ",".join(keys)))
        checks.append(check_unique(dst, keys, "groups", check="candidate_key_duplicate_groups"))
    return union_all(*checks)


def _schema_row(spark: SparkSession, check: str, passed: bool, column: str | None = None) -> DataFrame:
    row = (check, column, "PASS" if passed else "FAIL", 0 if passed else 1, "0", "critical")
    return spark.createDataFrame([row], RESULT)


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, null count and percentage, distinct non-null values; with rows and duplicate rows of the table.

    Distinct values and rows are counted by 96 bits of two hashes, combined per task before anything is shuffled: a value costs two numbers, however
    long its text is, and equal first hashes of different values are told apart by the second.
    """
    types = dict(df.dtypes)
    nulls = unpivot_row(
        df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]),
        "column",
        {
            c: {"data_type": F.lit(types[c]), "rows": F.col("__rows"), "null_count": F.col(f"`{c}`"), "null_pct": pct(F.col(f"`{c}`"), F.col("__rows"), 2)}
            for c in df.columns
        },
    )

    def hashed(*values: Column) -> list[Column]:
        return [F.xxhash64(*values).alias("a"), F.hash(F.lit(1), *values).alias("b")]

    values = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).cast("short").alias("k"), F.col(f"`{c}`").isNull().alias("unknown"), *hashed(F.col(f"`{c}`").cast("string")))
                    for i, c in enumerate(df.columns)
                ]
            )
        )
    ).filter("NOT unknown")
    named = F.element_at(F.array(*[F.lit(c) for c in df.columns]), F.col("k") + 1)
    distinct = values.groupBy("k", "a", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.count(F.lit(1)).alias("distinct_count"))
    distinct = distinct.select(named.alias("column"), "distinct_count")
    # a hash passes over nulls, so which columns are null goes into it too
    cells = [v for c in df.columns for v in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    copies = df.select(*hashed(*cells)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("__n")).agg(
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows")
    )
    return (
        nulls.join(distinct, "column", "left")
        .withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
        .crossJoin(F.broadcast(copies))
    )


def missingness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, most incomplete first."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    cells = {c: {"missing_count": F.col(f"`{c}`"), "missing_pct": pct(F.col(f"`{c}`"), F.col("__rows"))} for c in cols}
    return unpivot_row(row, "column", cells).orderBy(F.desc("missing_count"), "column")


def negatives(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Negative values per column."""
    row = df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in cols])
    return unpivot_row(row, "column", {c: {"negative_count": F.col(f"`{c}`")} for c in cols})


def kpi_identity_violations(kpis: DataFrame) -> DataFrame:
    """Executive rows whose class counts or recomputed rates disagree."""
    classes = F.col("late_orders") + F.col("on_time_orders") + F.col("delivery_data_missing_orders")
    repeat = pct(F.col("repeat_customers"), F.col("total_customers"), 2)
    late = pct(F.col("late_orders"), F.col("delivered_orders"), 2)
    return kpis.filter(
        (F.col("delivered_orders") != classes)
        | (F.round("repeat_customer_rate_pct", 2) != repeat)
        | (F.round("overall_late_delivery_rate_pct", 2) != late)
    )


def product_kpi_violations(items: DataFrame, product_kpis: DataFrame) -> DataFrame:
    """A row if the item or product totals of the mart differ from the source."""
    source = items.agg(
        F.count(F.lit(1)).alias("source_order_items"), F.countDistinct("product_id").alias("source_products")
    )
    mart = product_kpis.agg(
        F.sum("order_item_count").alias("product_kpi_order_items"), F.count(F.lit(1)).alias("product_kpi_products")
    )
    return source.crossJoin(F.broadcast(mart)).filter(
        (F.col("source_order_items") != F.col("product_kpi_order_items"))
        | (F.col("source_products") != F.col("product_kpi_products"))
    )


def unlinked_items(items: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Items whose order does not lead to a persistent customer."""
    linked = orders.select("order_id", "customer_id").join(
        customers.filter(F.col("customer_unique_id").isNotNull()).select("customer_id"), "customer_id"
    )
    return items.select("order_id", "order_item_id").join(linked, "order_id", "left_anti")


def missing_observed_payment(customer_360: DataFrame) -> DataFrame:
    return customer_360.filter(
        (F.col("payment_observation_status") == "observed") & F.col("total_payment_value").isNull()
    ).select("customer_unique_id", "payment_observation_status", "total_payment_value")


def missing_late_flag(orders: DataFrame) -> DataFrame:
    dated = F.col("order_delivered_customer_date").isNotNull() & F.col("order_estimated_delivery_date").isNotNull()
    return orders.filter(dated & F.col("is_late_delivery").isNull())


def gold_checks(
    orders: DataFrame, customers: DataFrame, items: DataFrame, product_kpis: DataFrame, kpis: DataFrame, customer_360: DataFrame
) -> DataFrame:
    """Violating rows per mart rule."""
    rules = {
        "executive_kpi_reconciliation": kpi_identity_violations(kpis),
        "product_kpi_reconciliation": product_kpi_violations(items, product_kpis),
        "product_kpi_customer_linkage": unlinked_items(items, orders, customers),
        "customer_360_observed_payment_value": missing_observed_payment(customer_360),
        "is_late_delivery_present_when_dates_available": missing_late_flag(orders),
    }
    return union_all(
        *[_single(rows, rule, None, F.count(F.lit(1)), 0, "critical") for rule, rows in rules.items()]
    )


def check_population(source: DataFrame, summary: DataFrame, count_col: str) -> DataFrame:
    """The counts of an aggregate have to add up to the source rows."""
    both = source.agg(F.count(F.lit(1)).alias("rows")).crossJoin(
        F.broadcast(summary.agg(F.coalesce(F.sum(count_col), F.lit(0)).alias("total")))
    )
    return _single(both, "population", count_col, F.sum(F.col("rows") - F.col("total")), 0, "critical")


def reconcile_totals(
    a: DataFrame, a_col: str, b: DataFrame, b_col: str, tolerance: float = 0.01
) -> DataFrame:
    """Two sums, their difference, and whether it is within the tolerance."""
    both = a.agg(F.coalesce(F.sum(a_col), F.lit(0.0)).alias("source_total")).crossJoin(
        F.broadcast(b.agg(F.coalesce(F.sum(b_col), F.lit(0.0)).alias("target_total")))
    )
    difference = F.col("target_total") - F.col("source_total")
    return both.withColumns(
        {"difference": difference, "status": F.when(F.abs(difference) <= tolerance, "PASS").otherwise("FAIL")}
    )


def count_differences(a: DataFrame, b: DataFrame, key: str, col: str) -> DataFrame:
    """Keys whose value differs between two tables, or which only one of them has."""
    left = a.select(key, F.col(col).alias("expected"))
    right = b.select(key, F.col(col).alias("observed"))
    return left.join(right, key, "full_outer").filter(~F.col("expected").eqNullSafe(F.col("observed")))


def check_feature_contract(df: DataFrame, features: Sequence[str], target: str | None = None, training: bool = False) -> DataFrame:
    """Missing, unexpected and misplaced columns, null values; the target must be absent from a serving table.

    A training table instead has to hold a binary target, and may hold key columns.
    """
    spark = df.sparkSession
    missing = sorted(set(features) - set(df.columns))
    extra = sorted(set(df.columns) - set(features) - ({target} if training else set()))
    present = [f for f in features if f in df.columns]
    rows = [
        ("missing_features", ", ".join(missing) or None, len(missing)),
        ("unexpected_features", ", ".join(extra) or None, 0 if training else len(extra)),
        ("feature_order", None, 0 if [c for c in df.columns if c in set(features)] == present else 1),
        ("target_absent", target, 0 if training or target not in df.columns else 1),
    ]
    parts = [
        spark.createDataFrame(
            [(c, col, "PASS" if n == 0 else "FAIL", n, "0", "critical") for c, col, n in rows], RESULT
        )
    ]
    one = _Pass(df)
    nulls = F.lit(0)
    for f in present:
        nulls = nulls + F.col(f).isNull().cast("int")
    one.add("null_features", None, F.sum(nulls), 0, "critical")
    if training and target in df.columns:
        one.add("binary_target", target, F.count_if(F.col(target).isNull() | ~F.col(target).isin(0, 1)), 0, "critical")
    parts.append(one.results())
    return union_all(*parts)


def check_calendar(
    df: DataFrame, date: str, start: str | None = None, end: str | None = None, by: str | Sequence[str] = ()
) -> DataFrame:
    """Per series: first and last day, repeated and missing days, and whether the bounds are met."""
    by = as_list(by)
    specs = [
        F.to_date(F.min(date)).alias("first_day"),
        F.to_date(F.max(date)).alias("last_day"),
        F.count(date).alias("rows"),
        F.countDistinct(date).alias("days"),
    ]
    seen = df.groupBy(*by).agg(*specs) if by else df.agg(*specs)
    seen = seen.withColumns(
        {
            "missing_days": days_between(F.col("first_day"), F.col("last_day")) + 1 - F.col("days"),
            "repeated_days": F.col("rows") - F.col("days"),
        }
    )
    ok = (F.col("missing_days") == 0) & (F.col("repeated_days") == 0)
    if start is not None:
        ok = ok & (F.col("first_day") == F.lit(start).cast("date"))
    if end is not None:
        ok = ok & (F.col("last_day") == F.lit(end).cast("date"))
    return seen.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def check_split_order(df: DataFrame, split: str, time: str, order: Sequence[str]) -> DataFrame:
    """Consecutive splits must not overlap in time: one row per pair of neighbours."""
    spans = {
        s: (F.max(F.when(F.col(split) == s, F.col(time))), F.min(F.when(F.col(split) == s, F.col(time)))) for s in order
    }
    row = df.agg(
        *[e.alias(f"{s}_{end}") for s, (last, first) in spans.items() for end, e in (("last", last), ("first", first))]
    )
    cells = {}
    for a, b in zip(order, order[1:]):
        late, early = F.col(f"{a}_last"), F.col(f"{b}_first")
        cells[f"{a} < {b}"] = {
            "earlier_last": late,
            "later_first": early,
            "status": F.when(late < early, "PASS").otherwise("FAIL"),
        }
    return unpivot_row(row, "pair", cells)


def audit_target(
    training: DataFrame, orders: DataFrame, key: str = "customer_unique_id", time: str = "order_purchase_timestamp",
    snapshot: str = "snapshot_timestamp", target: str = "repeat_purchase_90d", days: int = 90,
) -> DataFrame:
    """Label rebuilt from the orders: rows per snapshot and how many labels disagree.

    Labels and cutoffs followed by an order move as one list per customer, so a customer's key is shuffled once and not per snapshot.
    """
    cutoffs = training.select(F.col(snapshot).alias("cutoff_timestamp")).distinct()
    hits = listed_within(orders, cutoffs, key, time, days, "__hits")
    known = training.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(F.struct(snapshot, target)).alias("__labels"))
    rebuilt = known.join(hits, key, "left").select(F.inline("__labels"), "__hits").withColumn("__hit", F.array_contains("__hits", F.col(snapshot)).cast("int"))
    # rows without a key have no orders
    rest = training.filter(F.col(key).isNull()).select(snapshot, target, F.lit(0).alias("__hit"))
    return rebuilt.select(snapshot, target, "__hit").unionByName(rest).groupBy(snapshot).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(target) != F.coalesce("__hit", F.lit(0))).alias("mismatches"),
    )


def check_nonempty(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per object and whether there is any row."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("object"), "rows") for name, df in tables.items()
    ]
    return union_all(*counts).withColumn("status", F.when(F.col("rows") > 0, "PASS").otherwise("FAIL"))


def check_token_preserved(df: DataFrame, before: str, after: str, words: Sequence[str]) -> DataFrame:
    """Texts holding each word before and after a rewrite; the two counts have to agree."""
    row = df.agg(
        *[
            F.count_if(has_word(text, w)).alias(f"{side}{i}")
            for i, w in enumerate(words)
            for side, text in (("b", F.lower(F.col(before))), ("a", F.col(after)))
        ]
    )
    cells = {
        w: {
            "original_count": F.col(f"b{i}"),
            "normalized_count": F.col(f"a{i}"),
            "status": F.when(F.col(f"b{i}") == F.col(f"a{i}"), "PASS").otherwise("FAIL"),
        }
        for i, w in enumerate(words)
    }
    return unpivot_row(row, "word", cells)


