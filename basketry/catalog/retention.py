"""Point-in-time retention features."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.catalog import query
from basketry.catalog.oracle import near, nearly
from basketry.functions.values import round_double
from basketry.operators.aggregates import correlated_pairs
from basketry.plans import retention as r

SUMS = ["total_spend_to_date", "spend_30d", "spend_60d", "spend_90d"]
MEANS = ["average_review_score_to_date", "average_items_per_order", "recency_days"]


def _rounded(df, digits=4, cols=None):
    kinds = dict(df.dtypes)
    return df.withColumns(
        {c: round_double(F.col(c), digits) if kinds[c] == "double" else F.round(c, digits) for c in (cols or [*SUMS, *MEANS]) if c in kinds}
    )


def _training_sql() -> str:
    rounded = ", ".join([f"round({c}, 4) AS {c}" for c in [*SUMS, *MEANS]] + [f"{near('average_order_value')} AS average_order_value"])
    return f"SELECT * EXCLUDE ({', '.join([*SUMS, *MEANS, 'average_order_value'])}), {rounded} FROM o_training"


@query("temporal_coverage", "K1", """
    SELECT h::INTEGER AS horizon_days, count(*) FILTER (floor(epoch(e - last) / 86400) >= h) AS eligible_customers,
      100.0::DOUBLE * count(*) FILTER (floor(epoch(e - last) / 86400) >= h) / count(*) AS eligible_pct
    FROM (SELECT max(order_purchase_timestamp) AS last FROM o_owned GROUP BY customer_unique_id)
    CROSS JOIN (SELECT max(order_purchase_timestamp) AS e FROM x_orders) CROSS JOIN (SELECT unnest([30, 60, 90, 120, 180, 270, 365]) AS h) GROUP BY 1""")
def temporal_coverage(x):
    return r.temporal_coverage(x["x_orders"], x["x_customers"])


@query("last_purchase_months", "K1", """
    SELECT strftime(last, '%Y-%m') AS last_purchase_month, count(*) AS customers
    FROM (SELECT max(order_purchase_timestamp) AS last FROM o_owned GROUP BY customer_unique_id) GROUP BY 1""")
def last_purchase_months(x):
    return r.last_purchase_months(x["x_orders"], x["x_customers"])


@query("snapshot_design", "K2 H7", """
    SELECT k.cutoff_timestamp, k.cutoff_timestamp + INTERVAL 90 DAY AS future_window_end, count(DISTINCT h.customer_unique_id) AS customers_with_history,
      count(DISTINCT f.customer_unique_id) AS customers_with_future_purchase,
      coalesce(100.0::DOUBLE * count(DISTINCT f.customer_unique_id) / nullif(count(DISTINCT h.customer_unique_id), 0), 0) AS repeat_purchase_90d_rate
    FROM o_cutoffs k LEFT JOIN o_history h ON h.cutoff_timestamp = k.cutoff_timestamp
    LEFT JOIN o_future f ON f.cutoff_timestamp = k.cutoff_timestamp AND f.customer_unique_id = h.customer_unique_id GROUP BY 1""")
def snapshot_design(x):
    return r.snapshot_design(x["x_orders"], x["x_customers"])


@query("order_level", "K3", "SELECT * EXCLUDE (payment_value), round(payment_value, 4) AS payment_value FROM o_order_level")
def order_level(x):
    t = x.tables
    df = r.order_level(t["orders"], t["items"], t["payments"], t["reviews"], t["products"], t["customers"])
    return _rounded(df, 4, ["payment_value"])


@query("training_table", "K4 K5 K6 K7 C10 C11", _training_sql())
def training_table(x):
    return nearly(_rounded(x.training), "average_order_value")


@query("strict_asof_reviews", "K4", """
    WITH seen AS (
      SELECT h.customer_unique_id, h.cutoff_timestamp, h.order_id, count(v.review_id) AS n, avg(v.review_score) AS mean
      FROM o_history h JOIN x_reviews v ON v.order_id = h.order_id AND v.review_creation_date <= h.cutoff_timestamp GROUP BY 1, 2, 3)
    SELECT customer_unique_id, snapshot_timestamp, coalesce(any_value(s.obs), 0)::BIGINT AS review_observations_to_date,
      coalesce(any_value(s.n), 0)::BIGINT AS total_review_count_to_date, round(coalesce(any_value(s.score), 0), 6) AS average_review_score_to_date
    FROM o_training t LEFT JOIN (SELECT customer_unique_id AS c, cutoff_timestamp AS k, count(*) AS obs, sum(n) AS n, avg(mean) AS score FROM seen GROUP BY 1, 2) s
      ON s.c = t.customer_unique_id AND s.k = t.snapshot_timestamp GROUP BY 1, 2""")
def strict_asof_reviews(x):
    df = r.training_table(x.tables, x.cutoffs, strict_asof=True)
    keep = ["review_observations_to_date", "total_review_count_to_date", "average_review_score_to_date"]
    return _rounded(df.select("customer_unique_id", "snapshot_timestamp", *keep), 6)


@query("forward_label", "K6", "SELECT customer_unique_id, snapshot_timestamp AS cutoff_timestamp, repeat_purchase_90d FROM o_training")
def forward_label(x):
    t = x.tables
    df = r.order_level(t["orders"], t["items"], t["payments"], t["reviews"], t["products"], t["customers"])
    return r.forward_label(df, x.cutoffs)


SHARES = ", ".join(
    f"round(CASE WHEN orders_to_date > 0 THEN orders_{d}d / orders_to_date::DOUBLE ELSE 0 END, 6) AS orders_{d}d_share, "
    f"round(CASE WHEN total_spend_to_date > 0 THEN spend_{d}d / total_spend_to_date ELSE 0 END, 6) AS spend_{d}d_share, "
    f"round(orders_{d}d / {d}.0::DOUBLE, 6) AS orders_{d}d_velocity, {near(f'spend_{d}d / {d}.0::DOUBLE')} AS spend_{d}d_velocity"
    for d in (30, 60, 90)
)
PER_ITEM = "CASE WHEN total_order_items_to_date > 0 THEN total_spend_to_date / total_order_items_to_date ELSE 0 END"


@query("ratio_features", "K8 D5", f"""
    SELECT customer_unique_id, snapshot_timestamp, {SHARES}, {near(PER_ITEM)} AS spend_per_order_item,
      CASE WHEN orders_90d > 0 THEN 1 ELSE 0 END AS recent_activity_90d FROM o_training""")
def ratio_features(x):
    df = r.ratio_features(x.stored_training)
    shares = [c for c in df.columns if c.endswith("_share") or c.endswith("d_velocity") and c.startswith("orders")]
    money = [c for c in df.columns if c.startswith("spend") and c.endswith("_velocity")] + ["spend_per_order_item"]
    df = df.select("customer_unique_id", "snapshot_timestamp", *shares, *money, "recent_activity_90d")
    return nearly(_rounded(df, 6, shares), *money)


@query("reduced_features", "K9", f"""
    SELECT customer_unique_id, snapshot_timestamp, repeat_purchase_90d, orders_to_date, round(total_spend_to_date, 4) AS total_spend_to_date, unique_products_to_date,
      unique_categories_to_date, unique_sellers_to_date, round(recency_days, 4) AS recency_days, round(average_review_score_to_date, 4) AS average_review_score_to_date,
      orders_90d, round(spend_90d, 4) AS spend_90d, round(CASE WHEN orders_to_date > 0 THEN orders_90d / orders_to_date::DOUBLE ELSE 0 END, 6) AS orders_90d_share,
      {near("spend_90d / 90.0::DOUBLE")} AS spend_90d_velocity, {near(PER_ITEM)} AS spend_per_order_item FROM o_training""")
def reduced_features(x):
    df = r.reduced_features(r.ratio_features(x.stored_training), validate=True)
    df = _rounded(_rounded(df), 6, ["orders_90d_share"])
    return nearly(df, "spend_90d_velocity", "spend_per_order_item")


@query("temporal_split", "K10", """
    SELECT CASE WHEN snapshot_timestamp <= TIMESTAMP '1999-12-31' THEN 'train' WHEN snapshot_timestamp <= TIMESTAMP '2000-09-30' THEN 'validation' ELSE 'test' END AS split,
      min(snapshot_timestamp) AS first_snapshot, max(snapshot_timestamp) AS last_snapshot, count(*) AS rows, count(DISTINCT customer_unique_id) AS unique_customers,
      sum(repeat_purchase_90d)::BIGINT AS positives, 100.0::DOUBLE * sum(repeat_purchase_90d) / count(*) AS positive_rate_pct FROM o_training GROUP BY 1""")
def temporal_split(x):
    return r.split_summary(r.temporal_split(x.stored_training, "snapshot_timestamp", "1999-12-31", "2000-09-30"))


@query("target_by_snapshot", "K11", """
    SELECT snapshot_timestamp, count(*) AS customers, sum(repeat_purchase_90d)::BIGINT AS positive_targets, 100.0::DOUBLE * sum(repeat_purchase_90d) / count(*) AS positive_rate_pct
    FROM o_training GROUP BY 1""")
def target_by_snapshot(x):
    return r.target_by_snapshot(x.stored_training)


@query("class_balance", "K11", """
    SELECT count(*) FILTER (repeat_purchase_90d = 1) AS positives, count(*) FILTER (repeat_purchase_90d = 0) AS negatives,
      100.0::DOUBLE * count(*) FILTER (repeat_purchase_90d = 1) / count(*) AS positive_rate_pct,
      count(*) FILTER (repeat_purchase_90d = 0)::DOUBLE / count(*) FILTER (repeat_purchase_90d = 1) AS negatives_per_positive FROM o_training""")
def class_balance(x):
    return r.class_balance(x.stored_training)


CORRELATED = ["orders_to_date", "total_spend_to_date", "total_order_items_to_date", "unique_products_to_date", "unique_sellers_to_date", "orders_90d", "spend_90d", "items_90d"]


@query("correlated_features", "D13", "SELECT feature_a, feature_b, correlation FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS correlation FROM o_training"
    for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1 :]) + ") WHERE abs(correlation) >= 0.8")
def correlated_features(x):
    return correlated_pairs(x.stored_training, CORRELATED).withColumn("correlation", F.round("correlation", 6))
