"""Named DuckDB sub-queries shared by the oracle texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.catalog.fixtures import ADAPTERS, duckdb_text
from basketry.functions.values import round_double

CTES: dict[str, str] = {name: duckdb_text(name) for name in ADAPTERS}


# Sums of money have four decimals and compare exactly there. Their quotients may
# end on a half, so they compare at two decimals, moved off the halves.
def near(expr: str) -> str:
    return f"round({expr} + 0.0000031::DOUBLE, 2)"


def nearly(df: DataFrame, *cols: str) -> DataFrame:
    kinds = dict(df.dtypes)

    def moved(c: str) -> Column:
        value = F.col(c) + F.lit(0.0000031)
        return round_double(value, 2) if kinds[c] == "double" else F.round(value, 2)

    return df.withColumns({c: moved(c) for c in cols})


def cte(name: str, text: str) -> None:
    CTES[name] = text


def with_ctes(body: str) -> str:
    """Prefix the sub-queries a text mentions, in order of definition."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    if not parts:
        return body
    own = re.match(r"\s*WITH (RECURSIVE )?", body)
    if own is None:
        return "WITH " + ",\n".join(parts) + "\n" + body
    return f"WITH {own[1] or ''}" + ",\n".join(parts) + ",\n" + body[own.end() :]


cte("o_staged", """
    SELECT *, date_diff('day', order_estimated_delivery_date::DATE, order_delivered_customer_date::DATE)::INTEGER
        AS delivery_delay_days,
      CASE WHEN order_delivered_customer_date IS NOT NULL AND order_estimated_delivery_date IS NOT NULL
        THEN CASE WHEN order_delivered_customer_date::DATE > order_estimated_delivery_date::DATE THEN 1 ELSE 0 END END
        AS is_late_delivery
    FROM x_orders""")

cte("o_enriched", """
    SELECT s.order_id, s.customer_id, c.customer_unique_id, s.order_status, s.order_purchase_timestamp,
      s.order_purchase_timestamp::DATE AS purchase_date,
      year(s.order_purchase_timestamp)::INTEGER AS purchase_year, month(s.order_purchase_timestamp)::INTEGER AS purchase_month,
      day(s.order_purchase_timestamp)::INTEGER AS purchase_day, dayofweek(s.order_purchase_timestamp)::INTEGER AS purchase_day_of_week,
      hour(s.order_purchase_timestamp)::INTEGER AS purchase_hour,
      s.order_approved_at, s.order_delivered_carrier_date, s.order_delivered_customer_date, s.order_estimated_delivery_date,
      s.delivery_delay_days, s.is_late_delivery,
      date_diff('day', s.order_purchase_timestamp::DATE, s.order_delivered_customer_date::DATE)::INTEGER AS delivery_duration_days,
      CASE WHEN s.order_status <> 'delivered' THEN 'not_delivered'
           WHEN s.order_delivered_customer_date IS NULL THEN 'delivery_data_missing'
           WHEN s.is_late_delivery = 1 THEN 'late' WHEN s.is_late_delivery = 0 THEN 'on_time' ELSE 'unknown' END
        AS delivery_performance
    FROM o_staged s LEFT JOIN x_customers c USING (customer_id)""")

cte("o_performance", """
    SELECT purchase_date, count(*) AS total_orders, count(DISTINCT customer_id) AS unique_customers,
      count(*) FILTER (order_status = 'delivered') AS delivered_orders,
      count(*) FILTER (delivery_performance = 'late') AS late_orders,
      count(*) FILTER (delivery_performance = 'on_time') AS on_time_orders,
      count(*) FILTER (delivery_performance = 'not_delivered') AS not_delivered_orders,
      count(*) FILTER (delivery_performance = 'delivery_data_missing') AS delivery_data_missing_orders,
      round(100.0::DOUBLE * count(*) FILTER (delivery_performance = 'late')
        / nullif(count(*) FILTER (order_status = 'delivered'), 0), 2) AS late_delivery_rate_pct,
      round(avg(delivery_duration_days) FILTER (delivery_duration_days >= 0), 2) AS avg_delivery_duration_days
    FROM o_enriched GROUP BY purchase_date""")

cte("o_product_kpis", """
    SELECT i.product_id, any_value(p.product_category_name) AS product_category_name,
      any_value(t.product_category_name_english) AS product_category_name_english,
      any_value(p.product_name_lenght)::INTEGER AS product_name_lenght,
      any_value(p.product_description_lenght)::INTEGER AS product_description_lenght,
      any_value(p.product_photos_qty)::INTEGER AS product_photos_qty,
      count(*) AS order_item_count, count(DISTINCT i.order_id) AS unique_orders,
      count(DISTINCT c.customer_unique_id) AS unique_customers, count(DISTINCT i.seller_id) AS unique_sellers
    FROM x_order_items i
    LEFT JOIN x_orders o ON i.order_id = o.order_id LEFT JOIN x_customers c ON o.customer_id = c.customer_id
    LEFT JOIN x_products p ON i.product_id = p.product_id
    LEFT JOIN x_category_translation t ON p.product_category_name = t.product_category_name
    GROUP BY i.product_id""")

cte("o_owned", """
    SELECT o.*, c.customer_unique_id FROM x_orders o JOIN x_customers c USING (customer_id)
    WHERE c.customer_unique_id IS NOT NULL""")

cte("o_identity", """
    SELECT customer_unique_id, count(DISTINCT customer_id) AS customer_records,
      arg_min(customer_zip_code_prefix, customer_id) AS customer_zip_code_prefix,
      arg_min(customer_city, customer_id) AS customer_city, arg_min(customer_state, customer_id) AS customer_state
    FROM x_customers WHERE customer_unique_id IS NOT NULL GROUP BY 1""")
cte("o_customer_orders", """
    SELECT customer_unique_id, count(DISTINCT order_id) AS total_orders,
      count(*) FILTER (order_status = 'delivered') AS delivered_orders,
      count(*) FILTER (order_status IN ('canceled', 'unavailable')) AS cancelled_orders,
      min(order_purchase_timestamp) AS first_order_date, max(order_purchase_timestamp) AS last_order_date
    FROM o_owned GROUP BY 1""")
cte("o_customer_payments", """
    SELECT customer_unique_id, round(coalesce(sum(payment_value), 0), 4) AS total_payment_value,
      count(payment_sequential) AS total_payment_records
    FROM x_order_payments JOIN o_owned USING (order_id) GROUP BY 1""")
cte("o_customer_products", """
    SELECT customer_unique_id, count(i.product_id) AS total_items, count(DISTINCT i.product_id) AS unique_products,
      count(DISTINCT product_category_name) AS unique_categories, count(DISTINCT seller_id) AS unique_sellers
    FROM x_order_items i JOIN o_owned USING (order_id) LEFT JOIN x_products p ON p.product_id = i.product_id GROUP BY 1""")
cte("o_customer_reviews", """
    SELECT customer_unique_id, count(DISTINCT review_id) AS review_count, avg(review_score) AS average_review_score,
      count(*) FILTER (review_score <= 2) AS low_review_count
    FROM x_reviews JOIN o_owned USING (order_id) GROUP BY 1""")
cte("o_360", """
    SELECT *, CASE WHEN total_payment_value IS NULL THEN 'not_observed' ELSE 'observed' END AS payment_observation_status,
      CASE WHEN total_items IS NULL THEN 'not_observed' ELSE 'observed' END AS product_observation_status,
      CASE WHEN review_count IS NULL THEN 'not_observed' ELSE 'observed' END AS review_observation_status,
      coalesce(total_orders > 1, false) AS is_repeat_customer,
      floor(epoch(last_order_date - first_order_date) / 86400)::BIGINT AS customer_lifetime_days,
      total_payment_value / total_orders AS average_order_value
    FROM o_identity LEFT JOIN o_customer_orders USING (customer_unique_id)
    LEFT JOIN o_customer_payments USING (customer_unique_id) LEFT JOIN o_customer_products USING (customer_unique_id)
    LEFT JOIN o_customer_reviews USING (customer_unique_id)""")
cte("o_rfm", """
    SELECT customer_unique_id, first_order_date, last_order_date, total_orders, total_payment_value,
      average_order_value, is_repeat_customer, payment_observation_status,
      max(last_order_date) OVER () AS analysis_cutoff_timestamp,
      floor(epoch(max(last_order_date) OVER () - last_order_date) / 86400)::BIGINT AS recency_days,
      total_orders AS frequency, total_payment_value AS monetary
    FROM o_360""")

cte("o_cutoffs", """
    SELECT m::TIMESTAMP AS cutoff_timestamp FROM (
      SELECT last_day(d::DATE) AS m, a, b FROM (
        SELECT unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS d, a, b FROM (
          SELECT min(order_purchase_timestamp)::DATE + 90 AS a, max(order_purchase_timestamp)::DATE - 90 AS b FROM x_orders)))
    WHERE m BETWEEN a AND b""")
cte("o_order_level", """
    SELECT o.order_id, c.customer_unique_id, o.order_purchase_timestamp, o.order_status,
      p.payment_value, p.payment_records, i.order_item_count, i.unique_products, i.unique_categories, i.unique_sellers,
      r.review_count, r.average_review_score,
      CASE WHEN p.order_id IS NULL THEN 0 ELSE 1 END AS payment_observed,
      CASE WHEN r.order_id IS NULL THEN 0 ELSE 1 END AS review_observed,
      CASE WHEN i.order_id IS NULL THEN 0 ELSE 1 END AS item_observed
    FROM x_orders o LEFT JOIN x_customers c USING (customer_id)
    LEFT JOIN (SELECT order_id, sum(payment_value) AS payment_value, count(payment_sequential) AS payment_records
               FROM x_order_payments GROUP BY 1) p ON o.order_id = p.order_id
    LEFT JOIN (SELECT order_id, count(order_item_id) AS order_item_count, count(DISTINCT product_id) AS unique_products,
                 count(DISTINCT product_category_name) AS unique_categories, count(DISTINCT seller_id) AS unique_sellers
               FROM x_order_items LEFT JOIN x_products USING (product_id) GROUP BY 1) i ON o.order_id = i.order_id
    LEFT JOIN (SELECT order_id, count(review_id) AS review_count, avg(review_score) AS average_review_score
               FROM x_reviews GROUP BY 1) r ON o.order_id = r.order_id""")
cte("o_history", """
    SELECT t.*, k.cutoff_timestamp FROM o_order_level t JOIN o_cutoffs k ON t.order_purchase_timestamp <= k.cutoff_timestamp
    WHERE t.customer_unique_id IS NOT NULL""")
cte("o_future", """
    SELECT DISTINCT t.customer_unique_id, k.cutoff_timestamp FROM o_order_level t JOIN o_cutoffs k
      ON t.order_purchase_timestamp > k.cutoff_timestamp AND t.order_purchase_timestamp <= k.cutoff_timestamp + INTERVAL 90 DAY
    WHERE t.customer_unique_id IS NOT NULL""")
cte("o_training", """
    SELECT h.customer_unique_id, h.cutoff_timestamp AS snapshot_timestamp,
      count(*) AS orders_to_date, coalesce(sum(payment_value), 0) AS total_spend_to_date,
      coalesce(sum(order_item_count), 0)::BIGINT AS total_order_items_to_date,
      coalesce(any_value(d.products), 0) AS unique_products_to_date,
      coalesce(any_value(d.categories), 0) AS unique_categories_to_date,
      coalesce(any_value(d.sellers), 0) AS unique_sellers_to_date,
      coalesce(sum(payment_records), 0)::BIGINT AS total_payment_records_to_date,
      sum(payment_observed)::BIGINT AS payment_observations_to_date, sum(review_observed)::BIGINT AS review_observations_to_date,
      coalesce(sum(review_count), 0)::BIGINT AS total_review_count_to_date,
      coalesce(avg(average_review_score), 0) AS average_review_score_to_date,
      max(order_purchase_timestamp) AS last_purchase_timestamp,
      round(epoch(h.cutoff_timestamp - max(order_purchase_timestamp)) / 86400, 4) AS recency_days,
      coalesce(sum(payment_value), 0) / count(*) AS average_order_value,
      coalesce(sum(order_item_count), 0)::DOUBLE / count(*) AS average_items_per_order,
      count(*) FILTER (order_purchase_timestamp > h.cutoff_timestamp - INTERVAL 30 DAY) AS orders_30d,
      coalesce(sum(payment_value) FILTER (order_purchase_timestamp > h.cutoff_timestamp - INTERVAL 30 DAY), 0) AS spend_30d,
      coalesce(sum(order_item_count) FILTER (order_purchase_timestamp > h.cutoff_timestamp - INTERVAL 30 DAY), 0)::BIGINT AS items_30d,
      count(*) FILTER (order_purchase_timestamp > h.cutoff_timestamp - INTERVAL 60 DAY) AS orders_60d,
      coalesce(sum(payment_value) FILTER (order_purchase_timestamp > h.cutoff_timestamp - INTERVAL 60 DAY), 0) AS spend_60d,
      coalesce(sum(order_item_count) FILTER (order_purchase_timestamp > h.cutoff_timestamp - INTERVAL 60 DAY), 0)::BIGINT AS items_60d,
      count(*) FILTER (order_purchase_timestamp > h.cutoff_timestamp - INTERVAL 90 DAY) AS orders_90d,
      coalesce(sum(payment_value) FILTER (order_purchase_timestamp > h.cutoff_timestamp - INTERVAL 90 DAY), 0) AS spend_90d,
      coalesce(sum(order_item_count) FILTER (order_purchase_timestamp > h.cutoff_timestamp - INTERVAL 90 DAY), 0)::BIGINT AS items_90d,
      CASE WHEN any_value(f.customer_unique_id) IS NULL THEN 0 ELSE 1 END AS repeat_purchase_90d,
      CASE WHEN sum(payment_observed) > 0 THEN 1 ELSE 0 END AS payment_observation_available,
      CASE WHEN sum(review_observed) > 0 THEN 1 ELSE 0 END AS review_observation_available,
      CASE WHEN coalesce(sum(order_item_count), 0) > 0 THEN 1 ELSE 0 END AS item_observation_available
    FROM o_history h
    LEFT JOIN (
      SELECT g.customer_unique_id, g.cutoff_timestamp, count(DISTINCT product_id) AS products,
        count(DISTINCT product_category_name) AS categories, count(DISTINCT seller_id) AS sellers
      FROM o_history g JOIN x_order_items USING (order_id) LEFT JOIN x_products USING (product_id) GROUP BY 1, 2
    ) d ON d.customer_unique_id = h.customer_unique_id AND d.cutoff_timestamp = h.cutoff_timestamp
    LEFT JOIN o_future f ON f.customer_unique_id = h.customer_unique_id AND f.cutoff_timestamp = h.cutoff_timestamp
    GROUP BY h.customer_unique_id, h.cutoff_timestamp""")

cte("o_daily", """
    SELECT d::DATE AS date, count(DISTINCT order_id) AS order_count FROM (
      SELECT unnest(generate_series(min(order_purchase_timestamp::DATE)::TIMESTAMP, max(order_purchase_timestamp::DATE)::TIMESTAMP,
        INTERVAL 1 DAY)) AS d FROM x_orders)
    LEFT JOIN x_orders ON order_purchase_timestamp::DATE = d::DATE GROUP BY 1""")
