"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.catalog import query
from basketry.operators import joins, sets
from basketry.plans import campaigns


@query("left_join", "C1", """
    SELECT order_id, order_status, customer_unique_id FROM x_orders LEFT JOIN x_customers USING (customer_id)""")
def left_join(x):
    return joins.left_join(x["x_orders"], x["x_customers"], "customer_id").select("order_id", "order_status", "customer_unique_id")


@query("checked_join", "C2", """
    SELECT order_id, order_item_id, product_category_name FROM x_order_items LEFT JOIN x_products USING (product_id)""")
def checked_join(x):
    joined = joins.checked_join(x["x_order_items"], x["x_products"], "product_id", "left", "m:1")
    return joined.select("order_id", "order_item_id", "product_category_name")


@query("join_preserving", "C3", """
    SELECT customer_state, count(*) AS orders, (SELECT count(*) FROM x_orders WHERE customer_id NOT IN (SELECT customer_id FROM x_customers)) AS unmatched
    FROM x_orders LEFT JOIN x_customers USING (customer_id) GROUP BY 1""")
def join_preserving(x):
    joined, unmatched = joins.join_preserving(x["x_orders"], x["x_customers"], "customer_id")
    return joined.groupBy("customer_state").agg(F.count(F.lit(1)).alias("orders"), F.lit(unmatched).cast("long").alias("unmatched"))


@query("inner_join", "C4", """
    SELECT customer_state, count(*) AS items FROM x_order_items JOIN x_orders USING (order_id) JOIN x_customers USING (customer_id) GROUP BY 1""")
def inner_join(x):
    per_order = x["x_order_items"].groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    owned = joins.inner_join(joins.inner_join(per_order, x["x_orders"], "order_id"), x["x_customers"], "customer_id")
    return owned.groupBy("customer_state").agg(F.sum("n").alias("items"))


@query("cross_one_row", "C5", """
    SELECT (SELECT count(*) FROM x_orders) AS orders, (SELECT count(*) FROM x_customers) AS customers""")
def cross_one_row(x):
    return joins.cross_one_row(
        x["x_orders"].agg(F.count(F.lit(1)).alias("orders")), x["x_customers"].agg(F.count(F.lit(1)).alias("customers"))
    )


@query("orphan_keys", "C6 G3", "SELECT customer_id FROM x_orders EXCEPT SELECT customer_id FROM x_customers")
def orphan_keys(x):
    return joins.orphans(x["x_orders"], "customer_id", x["x_customers"], "customer_id")


@query("without_overlap", "C7", """
    SELECT DISTINCT a.household_key, a.CAMPAIGN::BIGINT AS CAMPAIGN FROM x_assignments a JOIN x_campaigns t ON t.CAMPAIGN = a.CAMPAIGN
    WHERE a.CAMPAIGN IN (3, 8, 13) AND NOT EXISTS (
      SELECT 1 FROM x_assignments b JOIN x_campaigns w ON w.CAMPAIGN = b.CAMPAIGN
      WHERE b.household_key = a.household_key AND b.CAMPAIGN <> a.CAMPAIGN AND w.START_DAY <= t.END_DAY AND w.END_DAY >= t.START_DAY)""")
def without_overlap(x):
    assigned, windows = x["x_assignments"], x["x_campaigns"]
    members = assigned.filter(F.col("CAMPAIGN").isin(3, 8, 13)).select("household_key", "CAMPAIGN").distinct()
    targets = windows.filter(F.col("CAMPAIGN").isin(3, 8, 13))
    free = joins.without_overlap(members, assigned, windows, "household_key", targets, "CAMPAIGN", "START_DAY", "END_DAY")
    return free.select("household_key", F.col("CAMPAIGN").cast("long").alias("CAMPAIGN"))


@query("semi_filter", "C8", """
    SELECT order_id FROM x_orders WHERE customer_id IN (SELECT customer_id FROM x_customers WHERE customer_state = 'NATION_3')""")
def semi_filter(x):
    ids = x["x_customers"].filter(F.col("customer_state") == "NATION_3").select("customer_id")
    return joins.semi_filter(x["x_orders"], ids, "customer_id").select("order_id")


@query("exists_flag", "C8", """
    SELECT order_id, order_id IN (SELECT order_id FROM x_order_items) AS has_item FROM x_orders""")
def exists_flag(x):
    return joins.exists_flag(x["x_orders"].select("order_id"), x["x_order_items"], "order_id", "has_item")


@query("window_totals", "C9", """
    SELECT c_custkey AS household_key, round(coalesce(sum(SALES_VALUE), 0), 4) AS sales, count(DISTINCT BASKET_ID) AS baskets
    FROM customer LEFT JOIN x_transactions ON household_key = c_custkey AND DAY BETWEEN 400 AND 700 GROUP BY 1""")
def window_totals(x):
    entities = x["customer"].select(F.col("c_custkey").alias("household_key"))
    totals = joins.window_totals(
        entities, campaigns.daily_baskets(x["x_transactions"]), "household_key", "DAY", F.lit(400), F.lit(700),
        {"sales": F.coalesce(F.sum("value"), F.lit(0.0)), "baskets": F.countDistinct("BASKET_ID")},
    )
    return totals.withColumn("sales", F.round("sales", 4))


@query("as_of_history", "C10", """
    SELECT customer_unique_id, cutoff_timestamp, count(*) AS orders, round(sum(coalesce(payment_value, 0)), 4) AS spend
    FROM o_history GROUP BY 1, 2""")
def as_of_history(x):
    from basketry.plans.retention import order_level

    t = x.tables
    facts = order_level(t["orders"], t["items"], t["payments"], t["reviews"], t["products"], t["customers"])
    table = joins.as_of_history(
        facts, x.cutoffs, "customer_unique_id", "order_purchase_timestamp",
        {"orders": F.lit(1), "spend": F.coalesce("payment_value", F.lit(0.0))},
    )
    return table.withColumn("spend", F.round("spend", 4))


@query("happens_within", "C11", "SELECT customer_unique_id, cutoff_timestamp FROM o_future")
def happens_within(x):
    owned = x["x_orders"].join(x["x_customers"], "customer_id")
    return joins.happens_within(owned, x.cutoffs, "customer_unique_id", "order_purchase_timestamp", 90)


@query("fill_calendar", "C12", """
    SELECT s.order_status, d::DATE AS date, count(order_id) AS orders FROM (
      SELECT order_status, unnest(generate_series(min(order_purchase_timestamp::DATE)::TIMESTAMP, max(order_purchase_timestamp::DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS d
      FROM x_orders GROUP BY 1) s
    LEFT JOIN x_orders o ON o.order_status = s.order_status AND order_purchase_timestamp::DATE = d::DATE GROUP BY 1, 2""")
def fill_calendar(x):
    counts = x["x_orders"].groupBy("order_status", F.to_date("order_purchase_timestamp").alias("date")).agg(F.count(F.lit(1)).alias("orders"))
    return joins.fill_calendar(counts, "date", "orders", "order_status")


@query("match_coverage", "C13", """
    SELECT c_nationkey, count(*) AS total, count(*) FILTER (c_custkey % 3 = 0) AS matched,
      100.0::DOUBLE * count(*) FILTER (c_custkey % 3 = 0) / count(*) AS coverage_pct FROM customer GROUP BY 1""")
def match_coverage(x):
    members = x["customer"].select("c_nationkey", F.col("c_custkey").alias("household_key"))
    return joins.match_coverage(members, x["x_demographics"], "household_key", "c_nationkey")


@query("union_all", "G1", """
    SELECT order_id, 'order' AS kind FROM x_orders UNION ALL SELECT order_id, 'item' FROM x_order_items""")
def union_all(x):
    return sets.union_all(
        x["x_orders"].select("order_id", F.lit("order").alias("kind")), x["x_order_items"].select("order_id", F.lit("item").alias("kind"))
    )


@query("common_ids", "G2", "SELECT order_id FROM x_order_items INTERSECT SELECT order_id FROM x_reviews")
def common_ids(x):
    return sets.common_ids(x["x_order_items"], x["x_reviews"], "order_id")


@query("missing_ids", "G3", "SELECT order_id FROM x_orders EXCEPT SELECT order_id FROM x_order_items")
def missing_ids(x):
    return sets.missing_ids(x["x_orders"], x["x_order_items"], "order_id")


@query("id_overlap", "G4", """
    SELECT (SELECT count(*) FROM (SELECT order_id FROM x_order_items INTERSECT SELECT order_id FROM x_reviews)) AS common,
      (SELECT count(*) FROM (SELECT order_id FROM x_order_items UNION SELECT order_id FROM x_reviews)) AS "union",
      (SELECT count(*) FROM (SELECT order_id FROM x_order_items INTERSECT SELECT order_id FROM x_reviews))::DOUBLE
      / (SELECT count(*) FROM (SELECT order_id FROM x_order_items UNION SELECT order_id FROM x_reviews)) AS jaccard""")
def id_overlap(x):
    return sets.overlap(x["x_order_items"], x["x_reviews"], "order_id")
