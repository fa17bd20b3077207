"""Delivery, product, cohort, executive and customer marts; RFM."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.catalog import query
from basketry.catalog.oracle import near, nearly
from basketry.functions.values import band
from basketry.plans import customers, marts, rfm
from basketry.sources.tables import register


def _round(df, digits=6, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("staged_orders", "J2", "SELECT * FROM o_staged")
def staged_orders(x):
    return x.staged_orders


@query("enriched_orders", "J3", "SELECT * FROM o_enriched")
def enriched_orders(x):
    return x.enriched


@query("order_performance", "J4", "SELECT * FROM o_performance")
def order_performance(x):
    return marts.order_performance(x.enriched)


def _product_kpis(x):
    return marts.product_kpis(x["x_order_items"], x["x_orders"], x["x_customers"], x["x_products"], x["x_category_translation"])


@query("product_kpis", "J5", "SELECT * FROM o_product_kpis")
def product_kpis(x):
    return _product_kpis(x)


@query("category_kpis", "J6", """
    SELECT product_category_name, product_category_name_english, count(*) AS product_count, sum(order_item_count)::BIGINT AS order_item_count,
      sum(unique_orders)::BIGINT AS product_order_count, sum(unique_customers)::BIGINT AS product_customer_reach, sum(unique_sellers)::BIGINT AS seller_count
    FROM o_product_kpis GROUP BY 1, 2""")
def category_kpis(x):
    return marts.category_kpis(_product_kpis(x))


@query("cohort_retention", "J7", """
    SELECT a.cohort_month, a.activity_month, date_diff('month', a.cohort_month, a.activity_month)::INTEGER AS retention_month, s.cohort_size,
      a.active_customers, round(100.0::DOUBLE * a.active_customers / s.cohort_size, 2) AS retention_rate_pct FROM (
      SELECT f.cohort_month, date_trunc('month', e.purchase_date)::DATE AS activity_month, count(DISTINCT e.customer_unique_id) AS active_customers
      FROM o_enriched e JOIN (SELECT customer_unique_id, date_trunc('month', min(purchase_date))::DATE AS cohort_month FROM o_enriched GROUP BY 1) f
        ON e.customer_unique_id = f.customer_unique_id GROUP BY 1, 2) a
    JOIN (SELECT cohort_month, count(*) AS cohort_size FROM (SELECT customer_unique_id, date_trunc('month', min(purchase_date))::DATE AS cohort_month
      FROM o_enriched WHERE customer_unique_id IS NOT NULL GROUP BY 1) GROUP BY 1) s ON s.cohort_month = a.cohort_month""")
def cohort_retention(x):
    return marts.cohort_retention(x.enriched)


@query("executive_kpis", "J8", """
    SELECT o.total_orders, o.delivered_orders, c.total_customers, c.repeat_customers, round(100.0::DOUBLE * c.repeat_customers / c.total_customers, 2) AS repeat_customer_rate_pct,
      o.late_orders, o.on_time_orders, o.not_delivered_orders, o.delivery_data_missing_orders,
      round(100.0::DOUBLE * o.late_orders / o.delivered_orders, 2) AS overall_late_delivery_rate_pct,
      round(100.0::DOUBLE * o.on_time_orders / o.delivered_orders, 2) AS overall_on_time_delivery_rate_pct,
      round(c.total_payment_value, 2) AS total_payment_value, round(c.total_payment_value / o.total_orders, 2) AS overall_average_order_value,
      round(c.average_customer_order_value, 2) AS average_customer_order_value, round(o.avg_delivery_duration_days, 2) AS avg_delivery_duration_days
    FROM (SELECT sum(total_orders)::BIGINT AS total_orders, sum(delivered_orders)::BIGINT AS delivered_orders, sum(late_orders)::BIGINT AS late_orders,
        sum(on_time_orders)::BIGINT AS on_time_orders, sum(not_delivered_orders)::BIGINT AS not_delivered_orders,
        sum(delivery_data_missing_orders)::BIGINT AS delivery_data_missing_orders, avg(avg_delivery_duration_days) AS avg_delivery_duration_days FROM o_performance) o
    CROSS JOIN (SELECT count(*) AS total_customers, count(*) FILTER (is_repeat_customer) AS repeat_customers, sum(total_payment_value) AS total_payment_value,
        avg(total_payment_value / total_orders) FILTER (total_orders > 0) AS average_customer_order_value FROM o_360) c""")
def executive_kpis(x):
    return _round(marts.executive_kpis(marts.order_performance(x.enriched), x.customer_360), 2, "total_payment_value")


@query("customer_identity", "J9 D10", "SELECT * FROM o_identity")
def customer_identity(x):
    return customers.customer_identity(x["x_customers"])


@query("customer_orders", "J10", "SELECT * FROM o_customer_orders")
def customer_orders(x):
    return customers.customer_orders(x["x_customers"], x["x_orders"])


@query("customer_payments", "J11", "SELECT * FROM o_customer_payments")
def customer_payments(x):
    return _round(customers.customer_payments(x["x_customers"], x["x_orders"], x["x_order_payments"]), 4, "total_payment_value")


@query("customer_products", "J12", "SELECT * FROM o_customer_products")
def customer_products(x):
    return customers.customer_products(x["x_customers"], x["x_orders"], x["x_order_items"], x["x_products"])


@query("customer_reviews", "J13", "SELECT * FROM o_customer_reviews")
def customer_reviews(x):
    return customers.customer_reviews(x["x_customers"], x["x_orders"], x["x_reviews"])


@query("customer_360", "J14 B15", f"SELECT * EXCLUDE (average_order_value), {near('average_order_value')} AS average_order_value FROM o_360")
def customer_360(x):
    return nearly(_round(x.customer_360, 4, "total_payment_value"), "average_order_value")


@query("rfm", "J15 H9 D16", f"SELECT * EXCLUDE (average_order_value), {near('average_order_value')} AS average_order_value FROM o_rfm")
def rfm_table(x):
    return nearly(_round(x.rfm, 4, "total_payment_value", "monetary"), "average_order_value")


@query("rfm_summary", "J16 D8", """
    SELECT 'recency_days' AS "column", count(recency_days) AS count, round(avg(recency_days), 6) AS mean, round(stddev_samp(recency_days), 6) AS std, min(recency_days)::DOUBLE AS min,
      round(quantile_cont(recency_days, 0.5), 4) AS p50, round(quantile_cont(recency_days, 0.99), 4) AS p99, max(recency_days)::DOUBLE AS max FROM o_rfm
    UNION ALL SELECT 'monetary', count(monetary), round(avg(monetary), 6), round(stddev_samp(monetary), 6), round(min(monetary), 4),
      round(quantile_cont(monetary, 0.5), 4), round(quantile_cont(monetary, 0.99), 4), round(max(monetary), 4) FROM o_rfm""")
def rfm_summary(x):
    df = rfm.rfm_summary(_round(x.stored_rfm, 4, "monetary")).select("column", "count", "mean", "std", "min", "p50", "p99", "max")
    return _round(_round(df, 6, "mean", "std"), 4, "min", "p50", "p99", "max")


@query("rfm_frequency", "J16 D9", """
    SELECT frequency, count(*) AS customers, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM o_rfm) AS percentage FROM o_rfm GROUP BY 1""")
def rfm_frequency(x):
    return rfm.frequency_distribution(x.stored_rfm)


@query("rfm_repeat_profile", "J16", """
    SELECT is_repeat_customer, count(customer_unique_id) AS customers, median(recency_days) AS median_recency, median(frequency) AS median_frequency,
      round(median(monetary), 4) AS median_monetary, round(avg(monetary), 4) AS mean_monetary, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM o_rfm) AS percentage
    FROM o_rfm GROUP BY 1""")
def rfm_repeat_profile(x):
    return _round(rfm.repeat_profile(x.stored_rfm), 4, "median_monetary", "mean_monetary")


@query("monetary_concentration", "J16", """
    SELECT p, round(threshold, 4) AS threshold, count(*) AS customers_above, round(100.0 * sum(monetary) / (SELECT sum(monetary) FROM o_rfm), 6) AS value_share_pct
    FROM o_rfm CROSS JOIN (SELECT unnest([0.9, 0.95, 0.99])::DOUBLE AS p, unnest(quantile_cont(monetary, [0.9, 0.95, 0.99])) AS threshold FROM o_rfm)
    WHERE monetary >= threshold GROUP BY 1, 2""")
def monetary_concentration(x):
    df = rfm.monetary_concentration(_round(x.stored_rfm, 4, "monetary"))
    return _round(_round(df, 4, "threshold"), 6, "value_share_pct")


@query("rfm_ties", "J16", """
    SELECT 'recency_days' AS "column", count(DISTINCT recency_days) AS unique_values FROM o_rfm UNION ALL
    SELECT 'frequency', count(DISTINCT frequency) FROM o_rfm UNION ALL SELECT 'monetary', count(DISTINCT monetary) FROM o_rfm""")
def rfm_ties(x):
    return rfm.rfm_ties(_round(x.stored_rfm, 4, "monetary"))


@query("rfm_correlation", "J16 D13", """
    SELECT 'recency_days' AS feature_a, 'frequency' AS feature_b, round(corr(recency_days, frequency), 6) AS correlation FROM o_rfm UNION ALL
    SELECT 'recency_days', 'monetary', round(corr(recency_days, monetary), 6) FROM o_rfm UNION ALL
    SELECT 'frequency', 'monetary', round(corr(frequency, monetary), 6) FROM o_rfm""")
def rfm_correlation(x):
    return _round(rfm.rfm_correlation(x.stored_rfm), 6, "correlation")


CASES = {
    "frequency_class": "CASE WHEN frequency <= 1 THEN '1 order' WHEN frequency <= 2 THEN '2 orders' WHEN frequency <= 3 THEN '3 orders' ELSE '4+ orders' END",
    "recency_band": "CASE WHEN recency_days <= 90 THEN '0-90 days' WHEN recency_days <= 180 THEN '91-180 days' WHEN recency_days <= 365 THEN '181-365 days' WHEN recency_days <= 545 THEN '366-545 days' ELSE '546+ days' END",
    "monetary_band": "CASE WHEN monetary <= 50 THEN '<= R$50' WHEN monetary <= 100 THEN 'R$50-R$100' WHEN monetary <= 250 THEN 'R$100-R$250' WHEN monetary <= 500 THEN 'R$250-R$500' WHEN monetary <= 1000 THEN 'R$500-R$1,000' WHEN monetary > 1000 THEN '> R$1,000' END",
}


def _band_sql(name: str) -> str:
    labels = ", ".join(f"('{label}')" for label in rfm.BANDS[name][2])
    return f"""
    SELECT v.{name}, count(customer_unique_id) AS customers, round(coalesce(sum(monetary), 0), 4) AS total_monetary, round(avg(monetary), 4) AS mean_monetary,
      median(recency_days) AS median_recency, median(frequency) AS median_frequency, round(median(monetary), 4) AS median_monetary,
      100.0::DOUBLE * count(customer_unique_id) / (SELECT count(*) FROM o_rfm) AS customer_pct,
      round(100.0 * coalesce(sum(monetary), 0) / (SELECT sum(monetary) FROM o_rfm), 6) AS value_pct
    FROM (VALUES {labels}) v({name}) LEFT JOIN (SELECT *, {CASES[name]} AS b FROM o_rfm) r ON r.b = v.{name} GROUP BY 1"""


def _cross_sql(name: str) -> str:
    return f"""
    SELECT coalesce(b, 'All') AS {name}, count(*) FILTER (NOT is_repeat_customer) AS one_time, count(*) FILTER (is_repeat_customer) AS repeat, count(*) AS "All"
    FROM (SELECT *, {CASES[name]} AS b FROM o_rfm) WHERE b IS NOT NULL GROUP BY ROLLUP (b)"""


def _bands(name: str):
    @query(f"rfm_{name}", "J17 H11", _band_sql(name))
    def summary(x):
        df = rfm.band_summary(_round(x.stored_rfm, 4, "monetary"), name)
        return _round(_round(df, 4, "total_monetary", "mean_monetary", "median_monetary"), 6, "value_pct")


for _name in rfm.BANDS:
    _bands(_name)


@query("rfm_recency_crosstab", "J18 D12", _cross_sql("recency_band"))
def rfm_recency_crosstab(x):
    return rfm.band_crosstab(x.stored_rfm, "recency_band")


@query("rfm_monetary_crosstab", "J18 D12", _cross_sql("monetary_band"))
def rfm_monetary_crosstab(x):
    return rfm.band_crosstab(_round(x.stored_rfm, 4, "monetary"), "monetary_band")


SEGMENT = """CASE WHEN monetary IS NULL THEN 'Payment data unavailable'
      WHEN frequency = 1 AND recency_days <= 180 THEN CASE WHEN monetary >= 250 THEN 'Recent high-value one-time' ELSE 'Recent one-time' END
      WHEN frequency = 1 THEN CASE WHEN recency_days > 365 AND monetary >= 250 THEN 'Older high-value one-time' ELSE 'Older one-time' END
      WHEN recency_days <= 180 THEN CASE WHEN frequency >= 3 THEN 'Recent frequent repeat' ELSE 'Recent repeat' END
      WHEN recency_days > 365 THEN 'Lapsed repeat' ELSE 'Established repeat' END"""


@query("rule_segments", "J19 P1", f"SELECT customer_unique_id, {SEGMENT} AS baseline_segment FROM o_rfm")
def rule_segments(x):
    return rfm.rule_segments(x.stored_rfm).select("customer_unique_id", "baseline_segment")


@query("segment_summary", "J19", f"""
    SELECT {SEGMENT} AS baseline_segment, count(*) AS customers, round(coalesce(sum(monetary), 0), 4) AS total_monetary, round(avg(monetary), 4) AS mean_monetary,
      median(recency_days) AS median_recency, median(frequency) AS median_frequency, round(median(monetary), 4) AS median_monetary,
      100.0::DOUBLE * count(*) / (SELECT count(*) FROM o_rfm) AS customer_pct, round(100.0 * coalesce(sum(monetary), 0) / (SELECT sum(monetary) FROM o_rfm), 6) AS value_pct
    FROM o_rfm GROUP BY 1""")
def segment_summary(x):
    df = rfm.segment_summary(rfm.rule_segments(_round(x.stored_rfm, 4, "monetary")))
    return _round(_round(df, 4, "total_monetary", "mean_monetary", "median_monetary"), 6, "value_pct")


@query("repeat_comparison", "J20", f"""
    SELECT is_repeat_customer, count(*) AS customer_count, round(avg(total_payment_value), 4) AS mean_customer_value,
      round(median(total_payment_value), 4) AS median_customer_value, {near('median(average_order_value)')} AS median_aov FROM o_360 GROUP BY 1""")
def repeat_comparison(x):
    df = _round(customers.repeat_comparison(x.stored_360), 4, "mean_customer_value", "median_customer_value")
    return nearly(df, "median_aov")


@query("cohort_repeat_rate", "J21", """
    SELECT cohort_month, count(*) AS customers, count(*) FILTER (n > 1) AS repeat_customers, 100.0::DOUBLE * count(*) FILTER (n > 1) / count(*) AS repeat_rate_pct
    FROM (SELECT date_trunc('month', min(order_purchase_timestamp))::DATE AS cohort_month, count(DISTINCT order_id) AS n FROM o_owned GROUP BY customer_unique_id) GROUP BY 1""")
def cohort_repeat_rate(x):
    return customers.cohort_repeat_rate(x["x_orders"], x["x_customers"])


@query("order_count_distribution", "J22", """
    SELECT order_count, count(*) AS customers, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS percentage
    FROM (SELECT count(DISTINCT order_id) AS order_count FROM o_owned GROUP BY customer_unique_id) GROUP BY 1""")
def order_count_distribution(x):
    return customers.order_count_distribution(x["x_customers"], x["x_orders"])


@query("missing_item_evidence", "J22 C8", """
    SELECT order_id, customer_unique_id, order_status, order_id IN (SELECT order_id FROM x_order_items) AS has_source_record FROM o_owned
    WHERE customer_unique_id IN (SELECT customer_unique_id FROM o_360 WHERE total_items IS NULL)""")
def missing_item_evidence(x):
    return customers.missing_block_evidence(x.tables, x.stored_360, "items")


@query("missing_payment_evidence", "J22 C8", """
    SELECT order_id, customer_unique_id, order_status, order_id IN (SELECT order_id FROM x_order_payments) AS has_source_record FROM o_owned
    WHERE customer_unique_id IN (SELECT customer_unique_id FROM o_360 WHERE total_payment_value IS NULL)""")
def missing_payment_evidence(x):
    return customers.missing_block_evidence(x.tables, x.stored_360, "payments")


@query("top_customer_audit", "J22 F2", """
    WITH top AS (SELECT customer_unique_id FROM o_360 WHERE total_payment_value IS NOT NULL ORDER BY total_payment_value DESC, customer_unique_id LIMIT 10)
    SELECT customer_unique_id, count(DISTINCT order_id) AS orders, min(order_purchase_timestamp) AS first_order, max(order_purchase_timestamp) AS last_order,
      round((SELECT sum(payment_value) FROM x_order_payments JOIN o_owned w USING (order_id) WHERE w.customer_unique_id = o.customer_unique_id), 4) AS payment_value,
      (SELECT count(*) FROM x_order_items JOIN o_owned w USING (order_id) WHERE w.customer_unique_id = o.customer_unique_id) AS items
    FROM o_owned o WHERE customer_unique_id IN (FROM top) GROUP BY 1""")
def top_customer_audit(x):
    return _round(customers.top_customer_audit(x.tables, x.stored_360), 4, "payment_value")


@query("customer_order_summary", "J23", """
    SELECT customer_unique_id, count(DISTINCT order_id) AS total_orders, count(*) FILTER (order_status = 'delivered') AS delivered_orders,
      count(*) FILTER (is_late_delivery = 1) AS late_orders, avg(delivery_delay_days) AS avg_delivery_delay_days FROM o_enriched GROUP BY 1""")
def customer_order_summary(x):
    return marts.customer_order_summary(marts.joined_orders(x.staged_orders, x["x_customers"]))


@query("state_summary", "J24 A10", """
    SELECT customer_state, count(DISTINCT c.customer_unique_id) AS unique_customers, count(DISTINCT order_id) AS total_orders,
      count(*) FILTER (is_late_delivery = 1) AS late_orders FROM o_staged LEFT JOIN x_customers c USING (customer_id) GROUP BY 1""")
def state_summary(x):
    register(marts.joined_orders(x.staged_orders, x["x_customers"]), "basketry_customer_orders")
    return marts.state_summary(x.spark, "basketry_customer_orders")


# --- clusters: the label of the embedding table stands in for a fitted cluster ---


CLUSTERED_SQL = """
    SELECT r.customer_unique_id, recency_days, frequency, monetary, is_repeat_customer, (r.customer_unique_id % 10)::INTEGER % 4 AS cluster_id
    FROM o_rfm r WHERE payment_observation_status = 'observed'"""


def _clustered(x):
    base = rfm.clustering_input(_round(x.stored_rfm, 4, "monetary"))
    return base.withColumn("cluster_id", (F.col("customer_unique_id") % 10).cast("int") % 4)


@query("clustering_input", "M2", """
    SELECT customer_unique_id, recency_days, frequency, monetary, round(ln(1 + monetary), 8) AS log_monetary, is_repeat_customer FROM o_rfm
    WHERE payment_observation_status = 'observed'""")
def clustering_input(x):
    return _round(_round(rfm.clustering_input(x.stored_rfm, validate=True), 4, "monetary"), 8, "log_monetary")


@query("cluster_profile", "M5", f"""
    SELECT cluster_id, count(*) AS customers, median(recency_days) AS median_recency, avg(recency_days) AS mean_recency, median(frequency) AS median_frequency,
      avg(frequency) AS mean_frequency, round(median(monetary), 4) AS median_monetary, round(avg(monetary), 4) AS mean_monetary, round(sum(monetary), 4) AS total_monetary,
      count(*) FILTER (is_repeat_customer) AS repeat_customers, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS customer_pct,
      round(100.0 * sum(monetary) / sum(sum(monetary)) OVER (), 6) AS value_pct, 100.0::DOUBLE * count(*) FILTER (is_repeat_customer) / count(*) AS repeat_rate_pct
    FROM ({CLUSTERED_SQL}) GROUP BY 1""")
def cluster_profile(x):
    df = rfm.cluster_profile(_clustered(x), "cluster_id")
    return _round(_round(df, 4, "median_monetary", "mean_monetary", "total_monetary"), 6, "value_pct")


@query("named_clusters", "M6 B12", f"""
    WITH c AS ({CLUSTERED_SQL}),
    p AS (SELECT cluster_id, median(recency_days) AS r, median(frequency) AS f, median(monetary) AS m FROM c GROUP BY 1),
    rep AS (SELECT cluster_id FROM p ORDER BY f DESC, cluster_id LIMIT 1),
    val AS (SELECT cluster_id FROM p WHERE cluster_id NOT IN (FROM rep) ORDER BY m DESC, cluster_id LIMIT 1),
    rest AS (SELECT * FROM p WHERE cluster_id NOT IN (FROM rep) AND cluster_id NOT IN (FROM val)),
    old AS (SELECT cluster_id FROM rest ORDER BY r DESC, cluster_id LIMIT 1)
    SELECT customer_unique_id, recency_days, frequency, monetary, cluster_id,
      CASE WHEN cluster_id IN (FROM rep) THEN 'Repeat Customers' WHEN cluster_id IN (FROM val) THEN 'High-Value One-Time'
           WHEN cluster_id IN (FROM old) THEN 'Older One-Time' ELSE 'Recent One-Time' END AS segment_name,
      'KMeans' AS segmentation_model, 'v1.0' AS segmentation_version, 'recency_days,frequency,monetary' AS segmentation_features,
      'StandardScaler' AS scaling_method, 4 AS n_clusters, 42 AS random_state FROM c""")
def named_clusters(x):
    return rfm.customer_segments(_clustered(x))


@query("distribution_bands", "H11", """
    SELECT customer_unique_id, CASE WHEN monetary < -0.01 THEN NULL WHEN monetary <= 100000 THEN 'low' WHEN monetary > 100000 THEN 'high' END AS b FROM o_rfm""")
def distribution_bands(x):
    b = band(F.col("monetary"), [-0.01, 100000, float("inf")], ["low", "high"], include_lowest=True)
    return _round(x.stored_rfm, 4, "monetary").select("customer_unique_id", b.alias("b"))
