"""Delivery, product, cohort and executive marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.dates import days_between, dow_sunday0, month_start, months_between_int
from basketry.functions.values import count_when, ladder, pct, ratio
from basketry.operators.ordering import number_rows, previous


def enriched_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per order: persistent customer, purchase date parts, delivery duration and performance class."""
    bought = F.col("order_purchase_timestamp")
    identity = customers.select("customer_id", "customer_unique_id")
    performance = ladder(
        [
            (F.col("order_status") != "delivered", "not_delivered"),
            (F.col("order_delivered_customer_date").isNull(), "delivery_data_missing"),
            (F.col("is_late_delivery") == 1, "late"),
            (F.col("is_late_delivery") == 0, "on_time"),
        ],
        "unknown",
    )
    return orders.join(identity, "customer_id", "left").select(
        "order_id", "customer_id", "customer_unique_id", "order_status", "order_purchase_timestamp",
        F.to_date(bought).alias("purchase_date"),
        F.year(bought).alias("purchase_year"),
        F.month(bought).alias("purchase_month"),
        F.dayofmonth(bought).alias("purchase_day"),
        dow_sunday0(bought).alias("purchase_day_of_week"),
        F.hour(bought).alias("purchase_hour"),
        "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date",
        "order_estimated_delivery_date", "delivery_delay_days", "is_late_delivery",
        days_between(bought, F.col("order_delivered_customer_date")).alias("delivery_duration_days"),
        performance.alias("delivery_performance"),
    )


def order_performance(enriched: DataFrame) -> DataFrame:
    """Daily delivery mart."""
    is_class = {
        name: count_when(F.col("delivery_performance") == value)
        for name, value in {
            "late_orders": "late", "on_time_orders": "on_time", "not_delivered_orders": "not_delivered",
            "delivery_data_missing_orders": "delivery_data_missing",
        }.items()
    }
    delivered = count_when(F.col("order_status") == "delivered")
    duration = F.col("delivery_duration_days")
    daily = enriched.groupBy("purchase_date").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.countDistinct("customer_id").alias("unique_customers"),
        delivered.alias("delivered_orders"),
        *[value.alias(name) for name, value in is_class.items()],
        F.round(F.avg(F.when(duration >= 0, duration)), 2).alias("avg_delivery_duration_days"),
    )
    daily = daily.withColumn("late_delivery_rate_pct", pct(F.col("late_orders"), F.col("delivered_orders"), 2))
    return daily.select(
        "purchase_date", "total_orders", "unique_customers", "delivered_orders", "late_orders", "on_time_orders",
        "not_delivered_orders", "delivery_data_missing_orders", "late_delivery_rate_pct", "avg_delivery_duration_days",
    ).orderBy("purchase_date")


def product_kpis(
    items: DataFrame, orders: DataFrame, customers: DataFrame, products: DataFrame, translation: DataFrame
) -> DataFrame:
    """Per product: items, distinct orders, customers and sellers, with attributes and translated category.

    Items are reduced to (product, order) and (product, seller) pairs first; a pair
    is one distinct order or seller, and only customers are left to be counted distinctly.
    """
    owners = orders.select("order_id", "customer_id").join(
        customers.select("customer_id", "customer_unique_id"), "customer_id", "left"
    )
    sold = items.groupBy("product_id", "order_id").agg(F.count(F.lit(1)).alias("n"))
    reach = sold.join(owners, "order_id", "left").groupBy("product_id").agg(
        F.sum("n").alias("order_item_count"),
        F.count("order_id").alias("unique_orders"),
        F.countDistinct("customer_unique_id").alias("unique_customers"),
    )
    sellers = items.select("product_id", "seller_id").distinct().groupBy("product_id").agg(
        F.count("seller_id").alias("unique_sellers")
    )
    metrics = reach.join(sellers, "product_id")
    attributes = products.join(translation, "product_category_name", "left")
    return metrics.join(attributes, "product_id", "left").select(
        "product_id", "product_category_name", "product_category_name_english", "product_name_lenght",
        "product_description_lenght", "product_photos_qty", "order_item_count", "unique_orders",
        "unique_customers", "unique_sellers",
    )


def category_kpis(products: DataFrame) -> DataFrame:
    """Sums over products; the reach adds products up and does not count distinct customers."""
    return products.groupBy("product_category_name", "product_category_name_english").agg(
        F.count(F.lit(1)).alias("product_count"),
        F.sum("order_item_count").alias("order_item_count"),
        F.sum("unique_orders").alias("product_order_count"),
        F.sum("unique_customers").alias("product_customer_reach"),
        F.sum("unique_sellers").alias("seller_count"),
    )


def cohort_retention(enriched: DataFrame) -> DataFrame:
    """Per cohort month and activity month: cohort size, active customers, month offset, rate."""
    bought = enriched.filter(F.col("customer_unique_id").isNotNull() & F.col("purchase_date").isNotNull())
    # purchases are reduced to (customer, month) before anything is joined
    active = bought.select(
        "customer_unique_id", month_start(F.col("purchase_date")).alias("activity_month")
    ).distinct()
    first = active.groupBy("customer_unique_id").agg(F.min("activity_month").alias("cohort_month"))
    sizes = first.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))
    activity = (
        active.join(first, "customer_unique_id")
        .groupBy("cohort_month", "activity_month")
        .agg(F.count(F.lit(1)).alias("active_customers"))
    )
    offset = months_between_int(F.col("cohort_month"), F.col("activity_month"))
    return (
        activity.join(sizes, "cohort_month")
        .select(
            "cohort_month", "activity_month", offset.alias("retention_month"), "cohort_size", "active_customers",
            pct(F.col("active_customers"), F.col("cohort_size"), 2).alias("retention_rate_pct"),
        )
        .orderBy("cohort_month", "retention_month")
    )


def executive_kpis(performance: DataFrame, customer_360: DataFrame) -> DataFrame:
    """The one-row executive summary."""
    counts = [
        "total_orders", "delivered_orders", "late_orders", "on_time_orders", "not_delivered_orders",
        "delivery_data_missing_orders",
    ]
    o = performance.agg(
        *[F.sum(c).alias(c) for c in counts], F.avg("avg_delivery_duration_days").alias("avg_delivery_duration_days")
    )
    value_per_order = F.when(
        F.col("total_orders") > 0, F.try_divide(F.col("total_payment_value"), F.col("total_orders"))
    )
    c = customer_360.agg(
        F.count(F.lit(1)).alias("total_customers"),
        count_when(F.col("is_repeat_customer")).alias("repeat_customers"),
        F.sum("total_payment_value").alias("total_payment_value"),
        F.avg(value_per_order).alias("average_customer_order_value"),
    )
    return o.crossJoin(F.broadcast(c)).select(
        "total_orders", "delivered_orders", "total_customers", "repeat_customers",
        pct(F.col("repeat_customers"), F.col("total_customers"), 2).alias("repeat_customer_rate_pct"),
        "late_orders", "on_time_orders", "not_delivered_orders", "delivery_data_missing_orders",
        pct(F.col("late_orders"), F.col("delivered_orders"), 2).alias("overall_late_delivery_rate_pct"),
        pct(F.col("on_time_orders"), F.col("delivered_orders"), 2).alias("overall_on_time_delivery_rate_pct"),
        "total_payment_value",
        ratio(F.col("total_payment_value"), F.col("total_orders"), 2).alias("overall_average_order_value"),
        F.round("average_customer_order_value", 2).alias("average_customer_order_value"),
        F.round("avg_delivery_duration_days", 2).alias("avg_delivery_duration_days"),
    )


def joined_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with customer identity and location."""
    location = customers.select("customer_id", "customer_unique_id", "customer_city", "customer_state")
    return orders.join(location, "customer_id", "left").select(
        "order_id", "customer_id", "customer_unique_id", "customer_city", "customer_state", "order_status",
        "order_purchase_timestamp", "delivery_delay_days", "is_late_delivery",
    )


def customer_order_summary(joined: DataFrame) -> DataFrame:
    """Per customer: distinct, delivered and late orders, mean delay."""
    return joined.groupBy("customer_unique_id").agg(
        F.countDistinct("order_id").alias("total_orders"),
        count_when(F.col("order_status") == "delivered").alias("delivered_orders"),
        count_when(F.col("is_late_delivery") == 1).alias("late_orders"),
        F.avg("delivery_delay_days").alias("avg_delivery_delay_days"),
    )


def order_sequence(joined: DataFrame, **limits: int) -> DataFrame:
    """Each customer's orders numbered by time, with the date of the order before."""
    order = ["order_purchase_timestamp", "order_id"]
    numbered = number_rows(joined, "customer_unique_id", order, "customer_order_number", **limits)
    return previous(
        numbered, "order_purchase_timestamp", "customer_unique_id", order, "previous_order_date", **limits
    )


def state_summary(spark: SparkSession, view: str) -> DataFrame:
    """Customers, orders and late orders per state, in SQL over a registered view."""
    return spark.sql(
        f"""
        SELECT customer_state,
               count(DISTINCT customer_unique_id) AS unique_customers,
               count(DISTINCT order_id) AS total_orders,
               count_if(is_late_delivery = 1) AS late_orders
        FROM {view}
        GROUP BY customer_state
        ORDER BY total_orders DESC, customer_state
        """
    )
