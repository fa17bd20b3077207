import datetime as dt
import random

import pytest

from basketry.catalog.fixtures import Inputs
from basketry.operators.joins import as_of_history, happens_within
from basketry.operators.quality import audit_target
from basketry.plans import retention as r
from pyspark.sql import functions as F

DAY = dt.timedelta(days=1)


@pytest.fixture(scope="module")
def world(spark):
    """Few customers, one with most orders; uneven cutoffs, one of them far after the others."""
    rng = random.Random(3)
    start = dt.datetime(2020, 1, 1)
    cutoffs = [start + DAY * n for n in (20, 50, 80, 110, 400)]
    orders, items = [], []
    for i in range(160):
        who = rng.choice(["hot"] * 5 + ["a", "b", "c", None])
        when = start + DAY * rng.randint(0, 450) if i % 10 else rng.choice(cutoffs)
        spend = rng.choice([None, 1.0, 2.5, 4.0])
        orders.append((i, who, when, "delivered", spend, None if spend is None else 1, rng.choice([None, 2]), rng.choice([None, 1]), rng.choice([1.0, 4.0])))
        items += [(i, n, rng.randint(1, 4), rng.randint(1, 3), rng.choice([None, "x", "y"])) for n in range(rng.randint(0, 3))]
    orders = [(*o[:8], o[8] if o[7] else None, int(o[4] is not None), int(o[7] is not None), int(o[6] is not None)) for o in orders]
    table = spark.createDataFrame(
        orders,
        "order_id int, customer_unique_id string, order_purchase_timestamp timestamp_ntz, order_status string, payment_value double, payment_records int,"
        "order_item_count int, review_count int, average_review_score double, payment_observed int, review_observed int, item_observed int",
    ).repartition(4)
    lines = spark.createDataFrame(items, "order_id int, order_item_id int, product_id int, seller_id int, product_category_name string")
    cuts = spark.createDataFrame([(c,) for c in cutoffs], "cutoff_timestamp timestamp_ntz")
    return orders, items, cutoffs, table, lines, cuts


def brute(orders, items, cutoffs):
    out = {}
    by_order = {}
    for i in items:
        by_order.setdefault(i[0], []).append(i)
    for cut in cutoffs:
        for who in {o[1] for o in orders} - {None}:
            past = [o for o in orders if o[1] == who and o[2] <= cut]
            if not past:
                continue
            lines = [i for o in past for i in by_order.get(o[0], [])]
            scores = [o[8] for o in past if o[8] is not None]
            row = {
                "orders_to_date": len(past), "total_spend_to_date": sum(o[4] or 0 for o in past),
                "unique_products_to_date": len({i[2] for i in lines}), "unique_sellers_to_date": len({i[3] for i in lines}),
                "unique_categories_to_date": len({i[4] for i in lines} - {None}), "last_purchase_timestamp": max(o[2] for o in past),
                "average_review_score_to_date": sum(scores) / len(scores) if scores else None,
                "repeat_purchase_90d": int(any(o[1] == who and cut < o[2] <= cut + 90 * DAY for o in orders)),
            }
            for d in (30, 60, 90):
                recent = [o for o in past if o[2] > cut - d * DAY]
                row |= {f"orders_{d}d": len(recent), f"spend_{d}d": sum(o[4] or 0 for o in recent), f"items_{d}d": sum(o[6] or 0 for o in recent)}
            out[(who, cut)] = row
    return out


def test_point_in_time_matches_brute_force(world):
    orders, items, cutoffs, table, lines, cuts = world
    want = brute(orders, items, cutoffs)
    got = {(x.customer_unique_id, x.snapshot_timestamp): x.asDict() for x in r.point_in_time(table, lines, cuts).collect()}
    assert got.keys() == want.keys()
    for key, row in want.items():
        for name, value in row.items():
            assert got[key][name] == pytest.approx(value) if isinstance(value, float) else got[key][name] == value, (key, name)


def test_history_and_future_match_brute_force(world):
    orders, _, cutoffs, table, _, cuts = world
    want = brute(orders, [], cutoffs)
    history = as_of_history(table, cuts, "customer_unique_id", "order_purchase_timestamp", {"n": F.lit(1)})
    assert {(x.customer_unique_id, x.cutoff_timestamp): x.n for x in history.collect()} == {k: v["orders_to_date"] for k, v in want.items()}
    hits = happens_within(table, cuts, "customer_unique_id", "order_purchase_timestamp", 90).collect()
    expected = {(o[1], c) for o in orders for c in cutoffs if o[1] and c < o[2] <= c + 90 * DAY}
    assert {(x.customer_unique_id, x.cutoff_timestamp) for x in hits} == expected and len(hits) == len(expected)


def test_no_cutoffs_give_no_rows(world):
    _, _, _, table, lines, cuts = world
    assert r.point_in_time(table, lines, cuts.limit(0)).count() == 0


def test_split_is_complete(world):
    _, _, _, table, _, _ = world
    split = r.temporal_split(table, "order_purchase_timestamp", "2020-03-01", "2020-06-01")
    assert split.filter("split is null").count() == 0
    spans = {x.split: (x.a, x.b) for x in split.groupBy("split").agg(F.min("order_purchase_timestamp").alias("a"), F.max("order_purchase_timestamp").alias("b")).collect()}
    assert spans["train"][1] < spans["validation"][0] and spans["validation"][1] < spans["test"][0]


def test_audit_rebuilds_labels_without_moving_a_key_per_snapshot(spark, rows):
    """Null keys, repeated and wrong labels; customers and not (customer, snapshot) pairs are joined."""
    days = [dt.datetime(2020, 1, d) for d in (1, 11, 21)]
    labels = [("a", days[0], 1), ("a", days[0], 1), ("a", days[1], 1), ("a", days[2], 0), ("b", days[0], 1), ("b", None, 1), (None, days[1], 1), (None, days[1], 0), ("c", days[2], None)]
    training = spark.createDataFrame(labels, "customer_unique_id string, snapshot_timestamp timestamp, repeat_purchase_90d int")
    orders = spark.createDataFrame(
        [("a", dt.datetime(2020, 1, 5)), ("a", dt.datetime(2020, 1, 21)), ("b", dt.datetime(2020, 1, 1)), (None, dt.datetime(2020, 1, 2)), ("c", None)],
        "customer_unique_id string, order_purchase_timestamp timestamp",
    )
    report = audit_target(training, orders, days=10)
    assert rows(report) == sorted([(days[0], 3, 1), (days[1], 3, 1), (days[2], 2, 0), (None, 1, 1)], key=repr)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert joined and not any("snapshot_timestamp" in line for line in joined)


def test_training_table_is_stored_as_stretches(spark, tmp_path):
    """The stored table has a row per stretch of cutoffs, and spreading it shuffles nothing."""
    first = dt.datetime(2020, 1, 1)
    spark.createDataFrame([(1, 3, first), (2, 3, first + 40 * DAY), (3, 6, first + 200 * DAY), (4, 9, first + 900 * DAY)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").selectExpr(
        "*", "'F' AS o_orderstatus", "1.0D AS o_totalprice"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    tables = {
        "customer": "SELECT id AS c_custkey, 1 AS c_nationkey, 'A' AS c_mktsegment FROM range(20)",
        "nation": "SELECT 1 AS n_nationkey, 'N' AS n_name",
        "part": "SELECT id AS p_partkey, 'T' AS p_type, 'P' AS p_name, 1 AS p_size FROM range(5)",
        "lineitem": "SELECT 1 + id % 4 AS l_orderkey, id % 3 AS l_partkey, id % 2 AS l_suppkey, CAST(id AS INT) AS l_linenumber, 2.0D AS l_extendedprice, 0.0D AS l_discount, 0.0D AS l_tax, 'R' AS l_returnflag, TIMESTAMP_NTZ '2020-02-02' AS l_shipdate FROM range(9)",
        "documents": "SELECT id AS doc_id, 'text' AS text FROM range(3)",
        "labels": "SELECT id AS doc_id, 1 AS quality, 0 AS toxic FROM range(3)",
        "embeddings": "SELECT id AS vec_id, 1 AS label FROM range(3)",
    }
    for name, text in tables.items():
        spark.sql(text).write.parquet(f"{tmp_path}/{name}.parquet")
    inputs = Inputs(spark, str(tmp_path))
    stored = inputs.stored_training
    want = sorted(map(tuple, inputs.training.collect()))
    assert stored.columns == inputs.training.columns and stored.dtypes == inputs.training.dtypes
    assert sorted(map(tuple, stored.collect())) == want
    steps = sum(spark.read.parquet(f).count() for f in stored.inputFiles() if "retention-training" in f)
    assert 0 < steps < len(want) / 2
    assert "hashpartitioning" not in stored._jdf.queryExecution().executedPlan().toString()
