"""Decisions and campaign readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.catalog import query
from basketry.catalog.modelling import ID, P, T, Y, _splits
from basketry.plans import campaigns as c
from basketry.plans import decisions as d
from basketry.plans import models
from basketry.plans.retention import FEATURES

RANKED = """SELECT *, row_number() OVER (PARTITION BY snapshot_timestamp ORDER BY repeat_purchase_probability DESC, customer_unique_id) AS decision_rank,
    count(*) OVER (PARTITION BY snapshot_timestamp) AS n FROM x_scored"""


@query("prioritize", "O1 E7 F5", f"""
    SELECT customer_unique_id, snapshot_timestamp, repeat_purchase_probability, repeat_purchase_90d, decision_rank,
      CASE WHEN decision_rank <= greatest(1, floor(n * 0.1::DOUBLE)) THEN 'prioritize' ELSE 'standard' END AS priority, 0.1::DOUBLE AS capacity_fraction,
      greatest(1, floor(n * 0.1::DOUBLE))::BIGINT AS target_population_size FROM ({RANKED})""")
def prioritize(x):
    return d.prioritize(x["x_scored"], 0.10, ID, P, by=T)


@query("prioritize_population", "O1 E7", """
    SELECT customer_unique_id, row_number() OVER (ORDER BY repeat_purchase_probability DESC, customer_unique_id) AS decision_rank,
      CASE WHEN row_number() OVER (ORDER BY repeat_purchase_probability DESC, customer_unique_id) <= greatest(1, floor(count(*) OVER () * 0.05::DOUBLE)) THEN 'prioritize' ELSE 'standard' END AS priority
    FROM x_scored""")
def prioritize_population(x):
    """One population ranked as a whole, without a window over all of it."""
    return d.prioritize(x["x_scored"], 0.05, ID, P, group_rows=1).select(ID, "decision_rank", "priority")


@query("threshold_policy", "O2 P1", f"""
    SELECT customer_unique_id, CASE WHEN repeat_purchase_probability >= 0.1 THEN 'prioritize' WHEN repeat_purchase_probability >= 0.01 THEN 'standard' ELSE 'deprioritize' END AS decision,
      CASE WHEN repeat_purchase_probability >= 0.1 THEN '{d.REASONS["prioritize"]}' WHEN repeat_purchase_probability >= 0.01 THEN '{d.REASONS["standard"]}'
        ELSE '{d.REASONS["deprioritize"]}' END AS reason FROM x_scored""")
def threshold_policy(x):
    return d.threshold_policy(x["x_scored"]).select(ID, "decision", "reason")


EVALUATION = f"""
    SELECT *, total_positive::DOUBLE / population_size AS baseline_positive_rate, captured_positive::DOUBLE / targeted_count AS precision,
      captured_positive::DOUBLE / total_positive AS recall, (captured_positive::DOUBLE / targeted_count) / (total_positive::DOUBLE / population_size) AS lift FROM (
      SELECT snapshot_timestamp, f AS capacity_fraction, count(*) AS population_size, count(*) FILTER (decision_rank <= greatest(1, floor(n * f))) AS targeted_count,
        sum(repeat_purchase_90d)::BIGINT AS total_positive, count(*) FILTER (decision_rank <= greatest(1, floor(n * f)) AND repeat_purchase_90d = 1) AS captured_positive
      FROM ({RANKED}) CROSS JOIN (SELECT unnest([0.01, 0.05, 0.1, 0.2])::DOUBLE AS f) GROUP BY 1, 2)"""


@query("capacity_decisions", "O3", f"""
    SELECT customer_unique_id, snapshot_timestamp, repeat_purchase_probability, decision_rank, CASE WHEN decision_rank <= greatest(1, floor(n * f)) THEN 'prioritize' ELSE 'standard' END AS priority,
      f AS capacity_fraction, greatest(1, floor(n * f))::BIGINT AS target_population_size, repeat_purchase_90d
    FROM ({RANKED}) CROSS JOIN (SELECT unnest([0.01, 0.05, 0.1, 0.2])::DOUBLE AS f)""")
def capacity_decisions(x):
    return d.capacity_decisions(x["x_scored"])


@query("capacity_evaluation", "O3", EVALUATION)
def capacity_evaluation(x):
    return d.evaluate_capacity(x["x_scored"])


@query("capacity_summary", "O3", f"""
    SELECT capacity_fraction, count(*) AS snapshots, avg(population_size) AS mean_population_size, avg(targeted_count) AS mean_targeted_count,
      sum(captured_positive)::BIGINT AS total_captured_positive, round(avg(baseline_positive_rate), 9) AS mean_baseline_positive_rate, round(avg(precision), 9) AS mean_precision,
      round(avg(recall), 9) AS mean_recall, round(avg(lift), 9) AS mean_lift FROM ({EVALUATION}) GROUP BY 1""")
def capacity_summary(x):
    df = d.capacity_summary(d.evaluate_capacity(x["x_scored"]))
    return df.withColumns({n: F.round(n, 9) for n in ("mean_baseline_positive_rate", "mean_precision", "mean_recall", "mean_lift")})


@query("batch_decision", "O4 M21")
def batch_decision(x):
    train, _, test = _splits(x)
    model = models.fit_logistic(train, FEATURES, Y)
    last = test.agg(F.max(T).alias("last"))
    requests = test.join(F.broadcast(last), F.col(T) == F.col("last")).withColumnRenamed(ID, "customer_id").drop("last")
    return d.decide_batch(model, requests, 0.20)


IDS = [3, 8, 13, 20]
LISTED = ", ".join(map(str, IDS))
COHORT = f"""
    SELECT t.CAMPAIGN, t.START_DAY, t.END_DAY, g.group_name, g.household_key FROM x_campaigns t JOIN (
      SELECT DISTINCT household_key, CAMPAIGN, 'assigned' AS group_name FROM x_assignments UNION ALL
      SELECT h.household_key, k.CAMPAIGN, 'comparison' FROM (SELECT DISTINCT household_key FROM x_transactions) h CROSS JOIN x_campaigns k
      WHERE NOT EXISTS (SELECT 1 FROM x_assignments a WHERE a.household_key = h.household_key AND a.CAMPAIGN = k.CAMPAIGN)) g ON g.CAMPAIGN = t.CAMPAIGN
    WHERE t.CAMPAIGN IN ({LISTED}) AND NOT EXISTS (
      SELECT 1 FROM x_assignments b JOIN x_campaigns w ON w.CAMPAIGN = b.CAMPAIGN
      WHERE b.household_key = g.household_key AND b.CAMPAIGN <> t.CAMPAIGN AND w.START_DAY <= t.END_DAY AND w.END_DAY >= t.START_DAY)"""


def _metrics(lo: str, hi: str) -> str:
    return f"""
    SELECT c.CAMPAIGN, c.START_DAY, c.END_DAY, c.group_name, c.household_key, coalesce(sum(SALES_VALUE), 0) AS sales, count(DISTINCT BASKET_ID) AS baskets, count(DISTINCT DAY) AS active_days
    FROM ({COHORT}) c LEFT JOIN x_transactions x ON x.household_key = c.household_key AND x.DAY BETWEEN {lo} AND {hi} GROUP BY 1, 2, 3, 4, 5"""


def _cohort(x):
    return c.eligible_cohort(x["x_assignments"], x["x_campaigns"], x["x_transactions"], IDS)


@query("eligible_cohort", "O5 C7 G1", COHORT)
def eligible_cohort(x):
    return _cohort(x)


@query("household_metrics", "O6 C9", f"SELECT * EXCLUDE (sales), round(sales, 4) AS sales FROM ({_metrics('c.START_DAY - 28', 'c.START_DAY - 1')})")
def household_metrics(x):
    return c.pre_period_metrics(_cohort(x), x["x_transactions"]).withColumn("sales", F.round("sales", 4))


def _smd(col: str) -> str:
    a, b = f"avg({col}) FILTER (group_name = 'assigned')", f"avg({col}) FILTER (group_name = 'comparison')"
    v = f"((var_samp({col}) FILTER (group_name = 'assigned') + var_samp({col}) FILTER (group_name = 'comparison')) / 2)"
    return f"round(CASE WHEN count(*) FILTER (group_name = 'assigned') >= 2 AND count(*) FILTER (group_name = 'comparison') >= 2 AND {v} > 0 THEN abs({a} - {b}) / sqrt({v}) END, 8) AS {col}_smd"


@query("balance_smd", "O7", f"""
    SELECT CAMPAIGN, count(*) FILTER (group_name = 'assigned') AS assigned_n, count(*) FILTER (group_name = 'comparison') AS comparison_n, {_smd("sales")}, {_smd("baskets")}, {_smd("active_days")}
    FROM ({_metrics('c.START_DAY - 28', 'c.START_DAY - 1')}) GROUP BY 1""")
def balance_smd(x):
    df = c.smd(c.pre_period_metrics(_cohort(x), x["x_transactions"]))
    return df.withColumns({f"{m}_smd": F.round(f"{m}_smd", 8) for m in c.METRICS})


@query("weekly_trend", "O8 D14 F3 C9", f"""
    WITH w AS (SELECT WEEK_NO FROM x_transactions GROUP BY 1 HAVING min(DAY) < max(DAY) AND count(DISTINCT DAY) = 7 AND max(DAY) < 820 ORDER BY 1 DESC LIMIT 8),
    k AS (SELECT group_name, household_key FROM ({COHORT}) WHERE CAMPAIGN = 8)
    SELECT 8 AS CAMPAIGN, group_name, WEEK_NO, round(avg(sales), 6) AS mean_sales FROM (
      SELECT k.group_name, k.household_key, w.WEEK_NO, coalesce(sum(SALES_VALUE), 0) AS sales FROM k CROSS JOIN w
      LEFT JOIN x_transactions t ON t.household_key = k.household_key AND t.WEEK_NO = w.WEEK_NO AND t.DAY < 820 GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""")
def weekly_trend(x):
    cohort = c.eligible_cohort(x["x_assignments"], x["x_campaigns"], x["x_transactions"], 8)
    return c.weekly_trend(cohort, x["x_transactions"], 820).withColumn("mean_sales", F.round("mean_sales", 6))


ALL_COHORT = COHORT.replace(f"t.CAMPAIGN IN ({LISTED}) AND ", "")


@query("eligible_cohort_all", "O5 C7", f"SELECT CAMPAIGN, group_name, count(*) AS households, sum(household_key)::BIGINT AS key_sum FROM ({ALL_COHORT}) GROUP BY 1, 2")
def eligible_cohort_all(x):
    cohort = c.eligible_cohort(x["x_assignments"], x["x_campaigns"], x["x_transactions"])
    return cohort.groupBy("CAMPAIGN", "group_name").agg(F.count(F.lit(1)).alias("households"), F.sum("household_key").cast("long").alias("key_sum"))


@query("weekly_trend_campaigns", "O8", f"""
    WITH full_weeks AS (SELECT WEEK_NO, max(DAY) AS last FROM x_transactions GROUP BY 1 HAVING min(DAY) < max(DAY) AND count(DISTINCT DAY) = 7),
    k AS ({COHORT}),
    w AS (SELECT CAMPAIGN, WEEK_NO FROM (SELECT DISTINCT CAMPAIGN, START_DAY FROM k) c JOIN full_weeks f ON f.last < c.START_DAY
      QUALIFY row_number() OVER (PARTITION BY CAMPAIGN ORDER BY WEEK_NO DESC) <= 8)
    SELECT CAMPAIGN, group_name, WEEK_NO, round(avg(sales), 6) AS mean_sales FROM (
      SELECT k.CAMPAIGN, k.group_name, k.household_key, w.WEEK_NO, coalesce(sum(SALES_VALUE), 0) AS sales FROM k JOIN w USING (CAMPAIGN)
      LEFT JOIN x_transactions t ON t.household_key = k.household_key AND t.WEEK_NO = w.WEEK_NO GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def weekly_trend_campaigns(x):
    return c.weekly_trend(_cohort(x), x["x_transactions"]).withColumn("mean_sales", F.round("mean_sales", 6))


def _change(name: str, lo: str, hi: str) -> str:
    return f"""SELECT CAMPAIGN, group_name, count(*) AS households, avg(sales) AS sales, avg(baskets) AS baskets, avg(active_days) AS active_days, '{name}' AS phase FROM ({_metrics(lo, hi)}) GROUP BY 1, 2"""


@query("before_during", "O9", " UNION ALL ".join(f"""
    SELECT b.CAMPAIGN, b.group_name, b.households, '{m}' AS metric, round(b.{m}, 6) AS "before", round(u.{m}, 6) AS during, round(u.{m} - b.{m}, 6) AS change
    FROM ({_change("before", "c.START_DAY - (c.END_DAY - c.START_DAY + 1)", "c.START_DAY - 1")}) b JOIN ({_change("during", "c.START_DAY", "c.END_DAY")}) u USING (CAMPAIGN, group_name)"""
    for m in c.METRICS))
def before_during(x):
    df = c.before_during(_cohort(x), x["x_transactions"])
    return df.withColumns({n: F.round(n, 6) for n in ("before", "during", "change")})


@query("demographic_coverage", "O9 C13", f"""
    SELECT CAMPAIGN, group_name, count(*) AS total, count(d.household_key) AS matched, 100.0::DOUBLE * count(d.household_key) / count(*) AS coverage_pct
    FROM ({COHORT}) c LEFT JOIN x_demographics d USING (household_key) GROUP BY 1, 2""")
def demographic_coverage(x):
    return c.demographic_coverage(_cohort(x), x["x_demographics"])
