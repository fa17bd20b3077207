"""Aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.catalog import query
from basketry.functions import values
from basketry.operators import aggregates as agg
from basketry.operators.ordering import quantile_columns, quantiles


@query("grouped_aggregates", "D1", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 6) AS price,
      min(l_shipdate) AS first_ship, max(l_discount) AS most FROM lineitem GROUP BY 1, 2""")
def grouped_aggregates(x):
    return agg.aggregate(
        x["lineitem"], ["l_returnflag", "l_linestatus"],
        {
            "n": F.count(F.lit(1)), "qty": F.round(F.sum("l_quantity"), 2), "price": F.round(F.avg("l_extendedprice"), 6),
            "first_ship": F.min("l_shipdate"), "most": F.max("l_discount"),
        },
    )


@query("conditional_counts", "D2", """
    SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 200000) AS large FROM orders GROUP BY 1""")
def conditional_counts(x):
    return agg.aggregate(
        x["orders"], "o_orderpriority",
        {"finished": values.count_when(F.col("o_orderstatus") == "F"), "large": values.count_when(F.col("o_totalprice") > 200000)},
    )


@query("distinct_count", "D3", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def distinct_count(x):
    return agg.aggregate(x["lineitem"], "l_suppkey", {"parts": values.count_distinct("l_partkey")})


@query("distinct_rows", "D4", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem")
def distinct_rows(x):
    return agg.distinct_rows(x["lineitem"], ["l_orderkey", "l_suppkey"])


@query("guarded_ratios", "D5", """
    SELECT o_orderkey, o_totalprice / nullif(o_custkey % 3, 0) AS as_null,
      CASE WHEN o_custkey % 3 = 0 THEN 0.0 ELSE o_totalprice / (o_custkey % 3) END AS as_zero FROM orders""")
def guarded_ratios(x):
    d = F.col("o_custkey") % 3
    return x["orders"].select(
        "o_orderkey", values.ratio(F.col("o_totalprice"), d).alias("as_null"), values.ratio(F.col("o_totalprice"), d, on_zero=0.0).alias("as_zero")
    )


@query("exact_quantiles", "D6", """
    SELECT o_orderpriority, unnest([0.05, 0.5, 0.99])::DOUBLE AS p, round(unnest(quantile_cont(o_totalprice, [0.05, 0.5, 0.99])), 6) AS value
    FROM orders GROUP BY 1""")
def exact_quantiles(x):
    return quantiles(x["orders"], "o_totalprice", [0.05, 0.5, 0.99], "o_orderpriority").withColumn("value", F.round("value", 6))


@query("medians", "D6", """
    SELECT l_returnflag, round(median(l_extendedprice), 6) AS price, median(l_quantity) AS quantity FROM lineitem GROUP BY 1""")
def medians(x):
    q = quantile_columns(x["lineitem"], {"price": ("l_extendedprice", 0.5), "quantity": ("l_quantity", 0.5)}, "l_returnflag")
    return q.withColumn("price", F.round("price", 6))


@query("sample_deviation", "D7", "SELECT c_mktsegment, round(stddev_samp(c_acctbal), 6) AS std FROM customer GROUP BY 1")
def sample_deviation(x):
    return agg.aggregate(x["customer"], "c_mktsegment", {"std": F.round(values.std("c_acctbal"), 6)})


def _describe(c: str, table: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min,
      round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c})::DOUBLE AS max FROM {table}"""


@query("describe_columns", "D8", " UNION ALL ".join(_describe(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe_columns(x):
    table = agg.describe_long(x["lineitem"], ["l_quantity", "l_extendedprice", "l_discount"])
    return table.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query("frequency_table", "D9", """
    SELECT order_status, count(*) AS rows, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM x_orders) AS percentage FROM x_orders GROUP BY 1""")
def frequency_table(x):
    return agg.frequency_table(x["x_orders"], "order_status")


@query("first_known_value", "D10", """
    SELECT customer_id % 50 AS bucket, arg_min(order_delivered_customer_date, order_id) FILTER (order_delivered_customer_date IS NOT NULL) AS first_delivery
    FROM x_orders GROUP BY 1""")
def first_known_value(x):
    keyed = x["x_orders"].withColumn("bucket", F.col("customer_id") % 50)
    return agg.aggregate(keyed, "bucket", {"first_delivery": values.first_value_by("order_delivered_customer_date", "order_id")})


@query("joined_sets", "D11", """
    SELECT order_id, string_agg(DISTINCT product_category_name, ' | ' ORDER BY product_category_name) AS categories
    FROM x_order_items JOIN x_products USING (product_id) WHERE product_category_name IS NOT NULL GROUP BY 1""")
def joined_sets(x):
    named = x["x_order_items"].join(x["x_products"], "product_id").filter("product_category_name is not null")
    return agg.aggregate(named, "order_id", {"categories": values.joined_set(F.col("product_category_name"))})


@query("crosstab_with_margins", "D12", """
    SELECT coalesce(o_orderpriority, 'All') AS o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o,
      count(*) FILTER (o_orderstatus = 'P') AS p, count(*) AS "All" FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def crosstab_with_margins(x):
    return agg.crosstab(x["orders"], "o_orderpriority", "o_orderstatus", ["F", "O", "P"], names=["f", "o", "p"])


def _corr(table: str, cols: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    return " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS correlation FROM {table}" for a, b in pairs)


@query("correlation_matrix", "D13", _corr("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def correlation_matrix(x):
    table = agg.correlation_matrix(x["lineitem"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return table.withColumn("correlation", F.round("correlation", 6))


@query("having_filter", "D14", """
    SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1 HAVING count(*) >= 12""")
def having_filter(x):
    return agg.having(x["orders"], "o_custkey", {"orders": F.count(F.lit(1))}, F.col("orders") >= 12)


@query("summary_row", "D15", """
    SELECT count(*) AS orders, sum(coalesce(is_late_delivery, 0))::BIGINT AS late_orders, round(avg(delivery_delay_days), 9) AS mean_delay_days FROM o_staged""")
def summary_row(x):
    return agg.summary_row(
        x.staged_orders,
        {
            "orders": F.count(F.lit(1)), "late_orders": F.sum(values.coalesce0(F.col("is_late_delivery"))),
            "mean_delay_days": F.round(F.avg("delivery_delay_days"), 9),
        },
    )


@query("global_value", "D16", """
    SELECT o_orderkey, date_diff('day', o_orderdate::DATE, max(o_orderdate::DATE) OVER ())::INTEGER AS age FROM orders""")
def global_value(x):
    df = agg.with_global(x["orders"], "last", F.max("o_orderdate"))
    return df.select("o_orderkey", F.datediff("last", "o_orderdate").alias("age"))


@query("null_key_groups", "D17", """
    SELECT product_category_name, count(*) AS kept, CASE WHEN product_category_name IS NOT NULL THEN count(*) END AS dropped FROM x_products GROUP BY 1""")
def null_key_groups(x):
    count = {"n": F.count(F.lit(1))}
    kept = agg.aggregate(x["x_products"], "product_category_name", count).withColumnRenamed("n", "kept")
    dropped = agg.aggregate(x["x_products"], "product_category_name", count, keep_null_keys=False).withColumnRenamed("n", "dropped")
    return kept.join(dropped, "product_category_name", "left")
