"""Data-quality checks and reconciliations."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.catalog import query
from basketry.catalog.marts import _product_kpis
from basketry.operators import quality as q
from basketry.plans import customers, demand, marts, retention, silver
from basketry.plans.silver import silver_orders

CONTRACT = {
    "schema": [
        {"name": "order_id", "nullable": False, "unique": True},
        {"name": "customer_id", "nullable": False},
        {"name": "order_status", "nullable": False, "accepted_values": [
            "delivered", "shipped", "canceled", "unavailable", "invoiced", "processing", "created", "approved"]},
        {"name": "order_purchase_timestamp", "nullable": False},
        {"name": "is_late_delivery", "nullable": False, "accepted_values": [0, 1]},
    ],
    "quality_rules": [
        {"id": "ORD-001", "severity": "critical"},
        {"id": "ORD-007", "severity": "warning"},
        {"id": "ORD-008", "severity": "warning"},
    ],
    "reconciliation": {"expected_order_population": 15000},
}


def check_sql(check: str, column: str | None, observed: str, source: str, expected: str | None = "0", severity: str = "critical") -> str:
    name = f"'{column}'" if column else "NULL"
    verdict = "'PASS'" if expected is None else f"CASE WHEN ({observed}) = {expected} THEN 'PASS' ELSE 'FAIL' END"
    shown = "tracked explicitly" if expected is None else expected
    return (
        f"""SELECT '{check}' AS "check", {name} AS "column", {verdict} AS status, ({observed})::BIGINT AS observed, """
        f"""'{shown}' AS expected, '{severity}' AS severity FROM {source}"""
    )


def nulls(column: str, source: str) -> str:
    return check_sql("not_null", column, f"count(*) FILTER ({column} IS NULL)", source)


def repeats(columns: str, source: str, check: str = "unique") -> str:
    keys = f"(SELECT count(*) AS n FROM {source} GROUP BY {columns})"
    return check_sql(check, columns.replace(", ", ","), "coalesce(sum(n - 1), 0)", keys)


@query("check_not_null", "I1", " UNION ALL ".join(nulls(c, "x_orders") for c in ("order_id", "order_delivered_customer_date")))
def check_not_null(x):
    return q.check_not_null(x["x_orders"], ["order_id", "order_delivered_customer_date"])


@query("check_unique_modes", "I2", f"""
    {repeats("order_id, order_item_id", "x_order_items")} UNION ALL
    {check_sql("unique", "order_id,order_item_id", "count(*) FILTER (n > 1)", "(SELECT count(*) AS n FROM x_order_items GROUP BY order_id, order_item_id)")} UNION ALL
    {repeats("order_id", "x_orders")}""")
def check_unique_modes(x):
    items = x["x_order_items"]
    one = q.check_unique(items, ["order_id", "order_item_id"], "beyond_first")
    return one.unionByName(q.check_unique(items, ["order_id", "order_item_id"], "groups")).unionByName(q.check_unique(x["x_orders"], "order_id"))


@query("check_accepted_values", "I3", check_sql(
    "accepted_values", "product_category_name", "count(*) FILTER (product_category_name NOT IN ('promo', 'small'))", "x_products"))
def check_accepted_values(x):
    return q.check_accepted_values(x["x_products"], "product_category_name", ["promo", "small"])


@query("check_row_count", "I4", check_sql("row_count", None, "count(*)", "x_orders", "15000"))
def check_row_count(x):
    return q.check_row_count(x["x_orders"], 15000)


@query("check_temporal_rule", "I5", check_sql(
    "ORD-007", "order_delivered_customer_date", "count(*) FILTER (order_delivered_customer_date < order_purchase_timestamp)", "x_orders"))
def check_temporal_rule(x):
    column, predicate, _ = q.RULES["ORD-007"]
    return q.check_rule(x["x_orders"], predicate, "ORD-007", column)


@query("observe_missing_delivery", "I6", check_sql(
    "ORD-008", "order_delivered_customer_date", "count(*) FILTER (order_status = 'delivered' AND order_delivered_customer_date IS NULL)",
    "x_orders", None, "warning"))
def observe_missing_delivery(x):
    column, predicate, _ = q.RULES["ORD-008"]
    return q.observe_rule(x["x_orders"], predicate, "ORD-008", column)


SILVER = "(SELECT *, coalesce(is_late_delivery, 0) AS late FROM o_staged)"
CONTRACT_SQL = " UNION ALL ".join(
    [nulls(c, SILVER) for c in ("order_id", "customer_id", "order_status", "order_purchase_timestamp")]
    + [
        check_sql("not_null", "is_late_delivery", "count(*) FILTER (late IS NULL)", SILVER),
        repeats("order_id", "o_staged"),
        check_sql("accepted_values", "order_status", "count(*) FILTER (order_status NOT IN ('delivered', 'shipped', 'canceled'))", SILVER),
        check_sql("accepted_values", "is_late_delivery", "count(*) FILTER (late NOT IN (0, 1))", SILVER),
        check_sql("row_count", None, "count(*)", SILVER, "15000"),
        check_sql("ORD-007", "order_delivered_customer_date", "count(*) FILTER (order_delivered_customer_date < order_purchase_timestamp)", SILVER, "0", "warning"),
        check_sql("ORD-008", "order_delivered_customer_date", "count(*) FILTER (order_status = 'delivered' AND order_delivered_customer_date IS NULL)", SILVER, None, "warning"),
        """SELECT 'ORD-001', NULL, 'SKIPPED', NULL, 'no registered rule', 'critical'""",
    ]
)


@query("contract_validation", "I7 P5", CONTRACT_SQL)
def contract_validation(x):
    return q.validate(silver_orders(x["x_orders"]), CONTRACT)


@query("contract_summary", "I8", f"""
    SELECT count(*) FILTER (status <> 'SKIPPED') AS total_checks, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed,
      CASE WHEN count(*) FILTER (status = 'FAIL') = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({CONTRACT_SQL})""")
def contract_summary(x):
    return q.summarize(q.validate(silver_orders(x["x_orders"]), CONTRACT))


@query("silver_gate", "I1 I2 B7", " UNION ALL ".join(
    [nulls(c, "x_order_items") for c in ("order_id", "order_item_id", "product_id", "seller_id")] + [repeats("order_id, order_item_id", "x_order_items")]))
def silver_gate(x):
    return silver.silver_checks(x["x_order_items"], "order_items")


@query("household_gate", "I1 I2 B8", " UNION ALL ".join(
    [nulls(c, "x_assignments") for c in ("household_key", "CAMPAIGN")]
    + [check_sql("unique", "household_key,CAMPAIGN", "count(*) FILTER (n > 1)", "(SELECT count(*) AS n FROM x_assignments GROUP BY household_key, CAMPAIGN)")]))
def household_gate(x):
    return silver.household_checks(x["x_assignments"], "campaign_table")


def _fk(child: str, c: str, parent: str, p: str) -> str:
    return check_sql(
        "foreign_key", f"{c} -> {p}", "count(*)", f"(SELECT DISTINCT {c} FROM {child} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {p} FROM {parent}))")


@query("referential_integrity", "I9 C6", " UNION ALL ".join(
    [_fk("x_orders", "customer_id", "x_customers", "customer_id"), _fk("x_order_items", "order_id", "x_orders", "order_id"),
     _fk("x_order_items", "product_id", "x_products", "product_id"), _fk("x_reviews", "order_id", "x_orders", "order_id")]))
def referential_integrity(x):
    checks = [
        q.check_fk(x["x_orders"], "customer_id", x["x_customers"], "customer_id"), q.check_fk(x["x_order_items"], "order_id", x["x_orders"], "order_id"),
        q.check_fk(x["x_order_items"], "product_id", x["x_products"], "product_id"), q.check_fk(x["x_reviews"], "order_id", x["x_orders"], "order_id"),
    ]
    return q.union_all(*checks)


@query("source_reconciliation", "I10", " UNION ALL ".join(
    [check_sql("row_count", None, "count(*)", "x_assignments", "(SELECT count(*) FROM x_assignments)").replace("'(SELECT count(*) FROM x_assignments)'", "(SELECT count(*) FROM x_assignments)::VARCHAR"),
     check_sql("column_order", None, "0", "(SELECT 1)"),
     check_sql("candidate_key_null_rows", "household_key,CAMPAIGN", "count(*) FILTER (household_key IS NULL OR CAMPAIGN IS NULL)", "x_assignments"),
     check_sql("candidate_key_duplicate_groups", "household_key,CAMPAIGN", "count(*) FILTER (n > 1)", "(SELECT count(*) AS n FROM x_assignments GROUP BY household_key, CAMPAIGN)")]))
def source_reconciliation(x):
    stored = x.stored(x["x_assignments"], "assignments")
    return q.reconcile(x["x_assignments"], stored, ["household_key", "CAMPAIGN"])


@query("table_profile", "I11", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS data_type, (SELECT count(*) FROM x_products) AS rows, count(*) FILTER ({c} IS NULL) AS null_count,
      round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct, count(DISTINCT {c}) AS distinct_count,
      (SELECT count(*) FROM x_products) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x_products)) AS duplicate_rows FROM x_products"""
    for c, t in (("product_id", "bigint"), ("product_category_name", "string"), ("product_name_lenght", "int"), ("product_description_lenght", "int"), ("product_photos_qty", "int"))))
def table_profile(x):
    return q.profile(x["x_products"])


@query("missingness_report", "I12", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS missing_count, 100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*) AS missing_pct FROM o_360"""
    for c in ("customer_unique_id", "total_orders", "total_payment_value", "total_items", "review_count", "average_review_score")))
def missingness_report(x):
    return q.missingness(x.customer_360, ["customer_unique_id", "total_orders", "total_payment_value", "total_items", "review_count", "average_review_score"])


@query("negative_values", "I12", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < 0) AS negative_count FROM customer""" for c in ("c_acctbal", "c_custkey")))
def negative_values(x):
    return q.negatives(x["customer"], ["c_acctbal", "c_custkey"])


def _kpis(x):
    return marts.executive_kpis(marts.order_performance(x.enriched), x.stored_360)


@query("gold_rules", "I13", " UNION ALL ".join(
    [check_sql(rule, None, "count(*)", source) for rule, source in {
        "executive_kpi_reconciliation": "(SELECT 1 FROM o_performance WHERE delivered_orders <> late_orders + on_time_orders + delivery_data_missing_orders)",
        "product_kpi_reconciliation": "(SELECT 1 FROM (SELECT sum(order_item_count) AS a, count(*) AS b FROM o_product_kpis) WHERE a <> (SELECT count(*) FROM x_order_items) OR b <> (SELECT count(DISTINCT product_id) FROM x_order_items))",
        "product_kpi_customer_linkage": "(SELECT 1 FROM x_order_items i LEFT JOIN x_orders o USING (order_id) LEFT JOIN x_customers c USING (customer_id) WHERE c.customer_unique_id IS NULL)",
        "customer_360_observed_payment_value": "(SELECT 1 FROM o_360 WHERE payment_observation_status = 'observed' AND total_payment_value IS NULL)",
        "is_late_delivery_present_when_dates_available": "(SELECT 1 FROM o_staged WHERE order_delivered_customer_date IS NOT NULL AND order_estimated_delivery_date IS NOT NULL AND is_late_delivery IS NULL)",
    }.items()]))
def gold_rules(x):
    return q.gold_checks(x.staged_orders, x["x_customers"], x["x_order_items"], _product_kpis(x), _kpis(x), x.stored_360)


@query("unlinked_items", "I13 C6", """
    SELECT order_id, order_item_id FROM x_order_items LEFT JOIN x_orders USING (order_id) LEFT JOIN x_customers c USING (customer_id) WHERE c.customer_unique_id IS NULL""")
def unlinked_items(x):
    return q.unlinked_items(x["x_order_items"], x["x_orders"], x["x_customers"])


@query("population_preserved", "I14", check_sql("population", "total_orders", "(SELECT count(*) FROM x_orders) - sum(total_orders)",
    "(SELECT count(DISTINCT order_id) AS total_orders FROM x_orders LEFT JOIN x_customers c USING (customer_id) GROUP BY c.customer_unique_id)"))
def population_preserved(x):
    joined = marts.joined_orders(x.staged_orders, x["x_customers"])
    return q.check_population(joined, marts.customer_order_summary(joined), "total_orders")


@query("payment_reconciliation", "I15", """
    SELECT round(a, 2) AS source_total, round(b, 2) AS target_total, round(b - a, 2) AS difference, CASE WHEN abs(b - a) <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (SELECT (SELECT sum(payment_value) FROM x_order_payments) AS a, (SELECT sum(total_payment_value) FROM o_360) AS b)""")
def payment_reconciliation(x):
    df = q.reconcile_totals(x["x_order_payments"], "payment_value", x.customer_360, "total_payment_value")
    return df.withColumns({c: F.round(c, 2) for c in ("source_total", "target_total", "difference")})


@query("order_count_differences", "I15", """
    SELECT c.customer_unique_id, n AS expected, total_orders AS observed FROM (
      SELECT customer_unique_id, count(*) AS n FROM x_customers GROUP BY 1) c FULL JOIN o_customer_orders o ON o.customer_unique_id = c.customer_unique_id
    WHERE n IS DISTINCT FROM total_orders""")
def order_count_differences(x):
    counted = x["x_customers"].groupBy("customer_unique_id").agg(F.count(F.lit(1)).alias("total_orders"))
    return q.count_differences(counted, customers.customer_orders(x["x_customers"], x["x_orders"]), "customer_unique_id", "total_orders")


def _plain(check: str, column: str | None, observed: int) -> str:
    return check_sql(check, column, str(observed), "(SELECT 1)")


@query("feature_contract", "I16", " UNION ALL ".join(
    [_plain("missing_features", None, 0), _plain("unexpected_features", "repeat_purchase_90d", 1), _plain("feature_order", None, 0),
     _plain("target_absent", "repeat_purchase_90d", 1), check_sql("null_features", None, "count(*) FILTER (orders_to_date IS NULL)", "o_training")]))
def feature_contract(x):
    """A serving table that still carries its target: the contract names it."""
    table = x.stored_training.select(*retention.FEATURES, retention.TARGET)
    return q.check_feature_contract(table, retention.FEATURES, retention.TARGET)


@query("training_contract", "I16", " UNION ALL ".join(
    [_plain("missing_features", None, 0), _plain("feature_order", None, 0), _plain("target_absent", "repeat_purchase_90d", 0),
     check_sql("null_features", None, "count(*) FILTER (orders_to_date IS NULL)", "o_training"),
     check_sql("binary_target", "repeat_purchase_90d", "count(*) FILTER (repeat_purchase_90d NOT IN (0, 1))", "o_training")]))
def training_contract(x):
    table = x.stored_training.select("customer_unique_id", *retention.FEATURES, retention.TARGET)
    report = q.check_feature_contract(table, retention.FEATURES, retention.TARGET, training=True)
    return report.filter(F.col("check") != "unexpected_features")


@query("calendar_check", "I17", """
    SELECT order_status, min(d) AS first_day, max(d) AS last_day, count(*) AS rows, count(DISTINCT d) AS days, (max(d) - min(d) + 1 - count(DISTINCT d))::BIGINT AS missing_days,
      count(*) - count(DISTINCT d) AS repeated_days, CASE WHEN max(d) - min(d) + 1 = count(DISTINCT d) AND count(*) = count(DISTINCT d) THEN 'PASS' ELSE 'FAIL' END AS status
    FROM (SELECT order_status, order_purchase_timestamp::DATE AS d FROM x_orders) GROUP BY 1""")
def calendar_check(x):
    return q.check_calendar(x["x_orders"].withColumn("date", F.to_date("order_purchase_timestamp")), "date", by="order_status")


@query("split_order_check", "I17", """
    SELECT 'train < validation' AS pair, max(date) FILTER (date <= DATE '1999-12-31') AS earlier_last, min(date) FILTER (date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31') AS later_first, 'PASS' AS status FROM o_daily
    UNION ALL SELECT 'validation < test', max(date) FILTER (date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'), min(date) FILTER (date >= DATE '2001-01-01'), 'PASS' FROM o_daily""")
def split_order_check(x):
    bounds = {"train": ("1995-01-01", "1999-12-31"), "validation": ("2000-01-01", "2000-12-31"), "test": ("2001-01-01", "2002-12-31")}
    return q.check_split_order(demand.date_split(x.daily, bounds), "split", "date", list(bounds))


@query("target_audit", "I18 C11", "SELECT snapshot_timestamp, count(*) AS rows, 0::BIGINT AS mismatches FROM o_training GROUP BY 1")
def target_audit(x):
    owned = x["x_orders"].join(x["x_customers"], "customer_id")
    return q.audit_target(x.stored_training, owned)


@query("objects_nonempty", "I19", """
    SELECT 'orders' AS object, count(*) AS rows, CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM x_orders UNION ALL
    SELECT 'order_performance', count(*), CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END FROM o_performance UNION ALL
    SELECT 'customer_360', count(*), CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END FROM o_360""")
def objects_nonempty(x):
    return q.check_nonempty({"orders": x["x_orders"], "order_performance": marts.order_performance(x.enriched), "customer_360": x.customer_360})
