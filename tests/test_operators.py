import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketry.catalog.quality import CONTRACT
from basketry.operators import aggregates, joins, quality, topk
from basketry.plans import campaigns
from basketry.plans.silver import silver_orders
from basketry.session import scratch_path
from basketry.sources import tables as io


def test_checked_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (None, "z")], "k int, w string")
    assert joins.checked_join(left, right, "k").count() == 3
    with pytest.raises(ValueError):
        joins.checked_join(left, right.unionByName(right), "k")
    with pytest.raises(ValueError):
        joins.checked_join(left, right, "k", validate="1:1")


def test_join_preserving_counts_unmatched(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, None)], "k int, w string")
    assert joins.join_preserving(left, right, "k")[1] == 2
    with pytest.raises(ValueError):
        joins.join_preserving(left, right.unionByName(right), "k")


def test_fill_calendar(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 2), ("a", dt.date(2020, 1, 4), 1), ("b", dt.date(2020, 1, 2), 5)], "s string, d date, n int")
    out = joins.fill_calendar(df, "d", "n", "s")
    assert [(r.s, r.d.day, r.n) for r in out.orderBy("s", "d").collect()] == [("a", 1, 2), ("a", 2, 0), ("a", 3, 0), ("a", 4, 1), ("b", 2, 5)]
    assert joins.fill_calendar(df.limit(0), "d", "n").count() == 0


def test_nulls_in_groups(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    assert aggregates.aggregate(df, "k", {"n": F.count("v")}).count() == 2
    assert aggregates.aggregate(df, "k", {"n": F.count("v")}, keep_null_keys=False).count() == 1


def test_uniqueness_modes(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (None,), (None,), (2,)], "k int")
    assert quality.check_unique(df, "k").first().observed == 3
    assert quality.check_unique(df, "k", "groups").first().observed == 2
    with pytest.raises(ValueError):
        quality.check_unique(df, "k", "other")


ORDERS = [
    ("ci-order-001", "ci-customer-001", " Delivered ", "2018-01-01 10:00:00", "2018-01-01 10:30:00", "2018-01-02 09:00:00", "2018-01-05 12:00:00", "2018-01-06 00:00:00"),
    ("ci-order-002", "ci-customer-002", "shipped", "2018-01-02 11:00:00", "2018-01-02 11:30:00", None, None, "2018-01-10 00:00:00"),
]
NAMES = ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
         "order_delivered_customer_date", "order_estimated_delivery_date"]


def test_two_row_contract(spark):
    orders = silver_orders(spark.createDataFrame(ORDERS, ", ".join(f"{n} string" for n in NAMES)))
    assert [(r.order_status, r.delivery_delay_days, r.is_late_delivery) for r in orders.orderBy("order_id").collect()] == [
        ("delivered", -1, 0), ("shipped", None, 0)]
    results = quality.validate(orders, CONTRACT, skip_reconciliation=True)
    assert {r.status for r in results.collect()} == {"PASS", "SKIPPED"}
    summary = quality.summarize(results).first()
    assert (summary.failed, summary.status) == (0, "PASS")
    broken = orders.withColumn("order_status", F.lit("lost")).withColumn("order_id", F.lit("same"))
    failed = {(r.check, r.column) for r in quality.validate(broken, CONTRACT).collect() if r.status == "FAIL"}
    assert failed == {("unique", "order_id"), ("accepted_values", "order_status"), ("row_count", None)}


def test_late_flag_stays_null_on_request(spark):
    raw = spark.createDataFrame(ORDERS, ", ".join(f"{n} string" for n in NAMES))
    assert [r[0] for r in silver_orders(raw, null_late_as_zero=False).orderBy("order_id").select("is_late_delivery").collect()] == [0, None]


def test_sinks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = scratch_path(spark, "sink")
    assert io.write_table(df, path, mode="errorifexists", compression="zstd", reconcile=True) == 2
    with pytest.raises(Exception):
        io.write_table(df, path, mode="errorifexists")
    versions = scratch_path(spark, "versions")
    io.write_snapshot(df.limit(1), versions, 7)
    io.write_snapshot(df, versions, 3)
    assert [(r.snapshot_id, r.parent_id) for r in io.snapshot_history(spark, versions).collect()] == [(7, None), (3, 7)]
    assert io.read_as_of(spark, versions, 7).count() == 1 and io.read_as_of(spark, versions, 3).columns == ["k", "v"]
    with pytest.raises(Exception):
        io.write_snapshot(df, versions, 3)


def test_as_of_prunes_other_versions(spark):
    path = scratch_path(spark, "versions")
    io.write_snapshot(spark.range(3), path, 1)
    io.write_snapshot(spark.range(5), path, 2)
    plan = io.read_as_of(spark, path, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_id" in plan and "(snapshot_id" in plan


def test_top_n_per_group_cuts_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    plan = topk.top_n_per_group(df, "g", ["id"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_crosstab_margins(spark):
    df = spark.createDataFrame([("x", True), ("x", False), ("y", True), (None, True)], "a string, b boolean")
    out = {r.a: (r.no, r.yes, r.All) for r in aggregates.crosstab(df, "a", "b", [False, True], names=["no", "yes"]).collect()}
    assert out == {"x": (1, 1, 2), "y": (0, 1, 1), "All": (1, 2, 3)}


def test_smd_edges(spark):
    def of(rows):
        df = spark.createDataFrame([(1, g, float(v), v, v) for g, v in rows], "CAMPAIGN int, group_name string, sales double, baskets int, active_days int")
        return campaigns.smd(df).first().sales_smd

    assert of([("assigned", 1), ("comparison", 2), ("comparison", 3)]) is None
    assert of([("assigned", 1), ("assigned", 1), ("comparison", 2), ("comparison", 2)]) is None
    assert of([("assigned", 1), ("assigned", 3), ("comparison", 4), ("comparison", 6)]) == pytest.approx(3 / 2**0.5)
