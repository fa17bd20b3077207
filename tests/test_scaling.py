"""Steps that have to stay cheap on many rows, and give what the plain form gives."""

import random

import pytest
from pyspark.sql import functions as F

from basketry.functions.dates import days_to_four_places, fractional_days
from basketry.functions.values import round_double
from basketry.operators.aggregates import correlation_matrix
from basketry.plans import retention as r


@pytest.mark.parametrize("digits", [2, 4, 6, 9])
def test_round_double_is_round(spark, digits):
    rng = random.Random(digits)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-8, 15) for _ in range(3000)]
    values += [k / 2000 for k in range(-3000, 3000)] + [0.0, -0.0, 1.00005, -2.5e-5, 1e300, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert df.filter(~round_double(F.col("x"), digits).eqNullSafe(F.round("x", digits))).collect() == []


def test_days_are_rounded_like_decimals(spark):
    # every second span ends on a half of the fourth place
    df = spark.range(20_000).select(F.timestamp_micros(F.col("id") * 4_320_000 + F.col("id") % 3 - 1).alias("b"), F.timestamp_micros(F.lit(-1)).alias("a"))
    assert df.filter(days_to_four_places(F.col("b"), F.col("a")) != F.round(fractional_days(F.col("b"), F.col("a")), 4)).collect() == []


def test_items_find_their_customer_without_the_joins_of_the_order_table(spark):
    at = "timestamp_ntz'2020-01-0{} 00:00:00'"
    orders = spark.sql(f"SELECT * FROM VALUES (1, 11, {at.format(1)}, 'd'), (2, 12, {at.format(2)}, 'd') AS t(order_id, customer_id, order_purchase_timestamp, order_status)")
    customers = spark.sql("SELECT * FROM VALUES (11, 'a'), (12, 'a') AS t(customer_id, customer_unique_id)")
    items = spark.sql("SELECT * FROM VALUES (1, 1, 5, 7), (2, 1, 5, 8) AS t(order_id, order_item_id, product_id, seller_id)")
    payments = spark.sql("SELECT * FROM VALUES (1, 1, 2.5D), (2, 1, 1.5D) AS t(order_id, payment_sequential, payment_value)")
    products = spark.sql("SELECT * FROM VALUES (5, 'x') AS t(product_id, product_category_name)")
    reviews = spark.sql(f"SELECT * FROM VALUES (1, 1, 4, {at.format(3)}) AS t(order_id, review_id, review_score, review_creation_date)")
    cutoffs = spark.sql(f"SELECT * FROM VALUES ({at.format(1)}), ({at.format(3)}), ({at.format(4)}) AS t(cutoff_timestamp)")
    tables = {"orders": orders, "customers": customers, "items": items, "payments": payments, "products": products, "reviews": reviews}
    df = r.training_table(tables, cutoffs)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert sum("LocalRelation" in line and "review" in line for line in plan.splitlines()) <= 1
    got = sorted((x.orders_to_date, x.unique_products_to_date, x.unique_sellers_to_date, x.total_spend_to_date, x.recency_days) for x in df.collect())
    assert got == [(1, 1, 1, 2.5, 0.0), (2, 1, 2, 4.0, 1.0), (2, 1, 2, 4.0, 2.0)]


def test_co_moments_match_spark_pair_by_pair(spark):
    rng = random.Random(3)
    cell = lambda m: None if rng.random() < 0.2 else m + rng.gauss(0, 1)
    df = spark.createDataFrame([(cell(1e6), cell(0), cell(-50), i % 7) for i in range(4000)], "a double, b double, c double, d int").repartition(5)
    got = {(x.feature_a, x.feature_b): x.correlation for x in correlation_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 6
    for (x, y), value in got.items():
        assert value == pytest.approx(df.agg(F.corr(x, y)).first()[0], abs=1e-9)
    assert {x.correlation for x in correlation_matrix(df.limit(0), ["a", "b"]).collect()} == {None}
    flat = df.withColumn("flat", F.lit(0.1))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        correlation_matrix(flat, ["d", "flat"]).collect()


def test_correlations_need_no_aggregate_too_long_to_compile(spark):
    df = spark.range(50).select(*[(F.col("id") * (k + 1) % 17).cast("double").alias(f"c{k}") for k in range(8)])
    plan = correlation_matrix(df, df.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "corr(" not in plan and "MapInArrow" in plan
