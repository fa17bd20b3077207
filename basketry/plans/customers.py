"""The customer 360 table and its audits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.dates import month_start, whole_days
from basketry.functions.values import count_when, first_value_by, pct, sum0
from basketry.operators.aggregates import frequency_table
from basketry.operators.joins import exists_flag, has_repeats, semi_filter
from basketry.operators.ordering import quantile_columns
from basketry.operators.topk import top_n

KEY = "customer_unique_id"


def order_owners(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders of known persistent customers: order columns plus the customer key."""
    identity = customers.filter(F.col(KEY).isNotNull()).select("customer_id", KEY)
    return orders.join(identity, "customer_id")


def customer_identity(customers: DataFrame) -> DataFrame:
    """Per customer: number of source records and the first known location."""
    return customers.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(
        F.countDistinct("customer_id").alias("customer_records"),
        *[
            first_value_by(c, "customer_id").alias(c)
            for c in ("customer_zip_code_prefix", "customer_city", "customer_state")
        ],
    )


def customer_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Per customer: orders, delivered and cancelled orders, first and last date."""
    return order_owners(customers, orders).groupBy(KEY).agg(
        F.countDistinct("order_id").alias("total_orders"),
        count_when(F.col("order_status") == "delivered").alias("delivered_orders"),
        count_when(F.col("order_status").isin("canceled", "unavailable")).alias("cancelled_orders"),
        F.min("order_purchase_timestamp").alias("first_order_date"),
        F.max("order_purchase_timestamp").alias("last_order_date"),
    )


def customer_payments(customers: DataFrame, orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Per customer: payment total and records. Payments are added up per order before the join."""
    per_order = payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("paid"), F.count("payment_sequential").alias("records")
    )
    owned = order_owners(customers, orders).select("order_id", KEY)
    return per_order.join(owned, "order_id").groupBy(KEY).agg(
        sum0("paid").cast("double").alias("total_payment_value"), F.sum("records").alias("total_payment_records")
    )


def customer_products(customers: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Per customer: items, distinct products, categories and sellers.

    Lines are reduced to (customer, product) and (customer, seller) pairs, so no
    row is repeated per distinct count; categories are looked up for the pairs only.
    """
    owned = order_owners(customers, orders).select("order_id", KEY)
    lines = items.select("order_id", "product_id", "seller_id").join(owned, "order_id")
    bought = lines.groupBy(KEY, "product_id").agg(F.count("product_id").alias("items"))
    known = bought.join(products.select("product_id", "product_category_name"), "product_id", "left").groupBy(KEY).agg(
        F.sum("items").alias("total_items"),
        F.count("product_id").alias("unique_products"),
        F.countDistinct("product_category_name").alias("unique_categories"),
    )
    sellers = lines.select(KEY, "seller_id").distinct().groupBy(KEY).agg(F.count("seller_id").alias("unique_sellers"))
    return known.join(sellers, KEY)


def customer_reviews(customers: DataFrame, orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per customer: distinct reviews, mean score, low scores."""
    owned = order_owners(customers, orders).select("order_id", KEY)
    return reviews.select("order_id", "review_id", "review_score").join(owned, "order_id").groupBy(KEY).agg(
        F.countDistinct("review_id").alias("review_count"),
        F.avg("review_score").alias("average_review_score"),
        count_when(F.col("review_score") <= 2).alias("low_review_count"),
    )


def customer_360(tables: Mapping[str, DataFrame], validate: bool = False) -> DataFrame:
    """One row per persistent customer: identity, order, payment, product and review blocks.

    What was not observed stays null and is named by a status. All blocks are
    grouped by the customer key, so putting them together needs no further shuffle.
    """
    customers, orders = tables["customers"], tables["orders"]
    blocks = [
        customer_orders(customers, orders),
        customer_payments(customers, orders, tables["payments"]),
        customer_products(customers, orders, tables["items"], tables["products"]),
        customer_reviews(customers, orders, tables["reviews"]),
    ]
    whole = customer_identity(customers)
    for block in blocks:
        whole = whole.join(block, KEY, "left")

    def status(col: str):
        return F.when(F.col(col).isNotNull(), "observed").otherwise("not_observed")

    whole = whole.withColumns(
        {
            "payment_observation_status": status("total_payment_value"),
            "product_observation_status": status("total_items"),
            "review_observation_status": status("review_count"),
            "is_repeat_customer": F.coalesce(F.col("total_orders") > 1, F.lit(False)),
            "customer_lifetime_days": whole_days(F.col("last_order_date"), F.col("first_order_date")),
            "average_order_value": F.try_divide(F.col("total_payment_value"), F.col("total_orders")),
        }
    )
    if validate:
        expected = customers.agg(F.countDistinct(KEY)).first()[0]
        if expected != whole.count() or has_repeats(whole, KEY):
            raise ValueError("customer identity reconciliation failed")
    return whole


def order_count_distribution(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers per number of orders."""
    counts = order_owners(customers, orders).groupBy(KEY).agg(F.countDistinct("order_id").alias("order_count"))
    return frequency_table(counts, "order_count", "customers")


def cohort_repeat_rate(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Per month of first purchase: customers and how many came back."""
    per_customer = order_owners(customers, orders).groupBy(KEY).agg(
        F.min("order_purchase_timestamp").alias("first_order_date"), F.countDistinct("order_id").alias("order_count")
    )
    return (
        per_customer.groupBy(month_start(F.col("first_order_date")).alias("cohort_month"))
        .agg(F.count(F.lit(1)).alias("customers"), count_when(F.col("order_count") > 1).alias("repeat_customers"))
        .withColumn("repeat_rate_pct", pct(F.col("repeat_customers"), F.col("customers")))
    )


def missing_block_evidence(tables: Mapping[str, DataFrame], table_360: DataFrame, block: str) -> DataFrame:
    """Orders of customers without item (or payment) metrics, and whether the source has a record for them."""
    col = {"items": "total_items", "payments": "total_payment_value"}[block]
    without = table_360.filter(F.col(col).isNull()).select(KEY)
    affected = semi_filter(order_owners(tables["customers"], tables["orders"]), without, KEY)
    flagged = exists_flag(affected.select("order_id", KEY, "order_status"), tables[block], "order_id", "has_source_record")
    return flagged


def top_customer_audit(tables: Mapping[str, DataFrame], table_360: DataFrame, n: int = 10) -> DataFrame:
    """The top customers by payment value, recounted from the source tables."""
    top = top_n(table_360.filter("total_payment_value is not null"), "total_payment_value", n, KEY).select(KEY)
    owned = semi_filter(order_owners(tables["customers"], tables["orders"]), top, KEY).select(
        KEY, "order_id", "order_purchase_timestamp"
    )
    dates = owned.groupBy(KEY).agg(
        F.countDistinct("order_id").alias("orders"),
        F.min("order_purchase_timestamp").alias("first_order"),
        F.max("order_purchase_timestamp").alias("last_order"),
    )
    paid = owned.join(tables["payments"], "order_id").groupBy(KEY).agg(F.sum("payment_value").alias("payment_value"))
    lines = owned.join(tables["items"], "order_id").groupBy(KEY).agg(F.count(F.lit(1)).alias("items"))
    return dates.join(paid, KEY, "left").join(lines, KEY, "left")


def repeat_comparison(table_360: DataFrame, **limits: int) -> DataFrame:
    """Repeat against one-time customers: count, median and mean value, median order value."""
    by = "is_repeat_customer"
    base = table_360.groupBy(by).agg(
        F.count(F.lit(1)).alias("customer_count"), F.avg("total_payment_value").alias("mean_customer_value")
    )
    medians = quantile_columns(
        table_360,
        {"median_customer_value": ("total_payment_value", 0.5), "median_aov": ("average_order_value", 0.5)},
        by,
        **limits,
    )
    return base.join(medians, by, "left")
