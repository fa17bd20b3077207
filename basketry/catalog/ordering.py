"""Windows, ranks, sorting and top-n."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.catalog import query
from basketry.operators import aggregates as agg
from basketry.operators import topk, windows
from basketry.functions.values import target_count
from basketry.operators.ordering import with_group_total
from basketry.plans import marts


@query("order_sequence", "E1 E2", """
    SELECT order_id, customer_unique_id, row_number() OVER w AS customer_order_number, lag(order_purchase_timestamp) OVER w AS previous_order_date
    FROM x_orders LEFT JOIN x_customers USING (customer_id)
    WINDOW w AS (PARTITION BY customer_unique_id ORDER BY order_purchase_timestamp, order_id)""")
def order_sequence(x):
    joined = marts.joined_orders(x.staged_orders, x["x_customers"])
    return marts.order_sequence(joined).select("order_id", "customer_unique_id", "customer_order_number", "previous_order_date")


@query("order_sequence_ranged", "E1 E2", """
    SELECT order_id, customer_unique_id, row_number() OVER w AS customer_order_number, lag(order_purchase_timestamp) OVER w AS previous_order_date
    FROM x_orders LEFT JOIN x_customers USING (customer_id)
    WINDOW w AS (PARTITION BY customer_unique_id ORDER BY order_purchase_timestamp, order_id)""")
def order_sequence_ranged(x):
    """The same result the way a hot customer needs it: no group is brought into one task."""
    joined = marts.joined_orders(x.staged_orders, x["x_customers"])
    table = marts.order_sequence(joined, group_rows=1)
    return table.select("order_id", "customer_unique_id", "customer_order_number", "previous_order_date")


LAGS = ", ".join(f"lag(order_count, {k}) OVER w AS lag_{k}" for k in (1, 2, 3, 7, 14, 21, 28))


@query("series_lags", "E3", f"SELECT date, {LAGS} FROM o_daily WINDOW w AS (ORDER BY date)")
def series_lags(x):
    return windows.add_lags(x.daily, "order_count", [1, 2, 3, 7, 14, 21, 28]).drop("order_count")


def _trailing(w: int, value: str, min_periods: int) -> str:
    return ", ".join(
        f"CASE WHEN count({value}) OVER w{w} >= {min_periods} THEN {expr} END AS rolling_{stat}_{w}"
        for stat, expr in (
            ("mean", f"round(avg({value}) OVER w{w}, 6)"), ("std", f"round(stddev_samp({value}) OVER w{w}, 6)"),
            ("min", f"min({value}) OVER w{w}"), ("max", f"max({value}) OVER w{w}"),
        )
    )


def _rounded(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("series_trailing", "E4", f"""
    SELECT date, {", ".join(_trailing(w, "order_count", w) for w in (7, 14, 28))} FROM o_daily
    WINDOW {", ".join(f"w{w} AS (ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in (7, 14, 28))}""")
def series_trailing(x):
    df = windows.add_trailing(x.daily, "order_count", [7, 14, 28], ["mean", "std", "min", "max"]).drop("order_count")
    return _rounded(df, [f"rolling_{s}_{w}" for s in ("mean", "std") for w in (7, 14, 28)])


@query("series_trailing_partial", "E5", f"""
    SELECT theme_name, period, {_trailing(6, "n", 3)} FROM (SELECT theme_name, period, count(*) AS n FROM x_theme_events GROUP BY 1, 2)
    WINDOW w6 AS (PARTITION BY theme_name ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def series_trailing_partial(x):
    counts = x["x_theme_events"].groupBy("theme_name", "period").agg(F.count(F.lit(1)).alias("n"))
    df = windows.add_trailing(counts, "n", [6], ["mean", "std", "min", "max"], "theme_name", "period", min_periods=3)
    return _rounded(df.drop("n"), ["rolling_mean_6", "rolling_std_6"])


@query("period_change", "E6", """
    SELECT theme_name, period, n - lag(n) OVER (PARTITION BY theme_name ORDER BY period) AS change
    FROM (SELECT theme_name, period, count(*) AS n FROM x_theme_events GROUP BY 1, 2)""")
def period_change(x):
    counts = x["x_theme_events"].groupBy("theme_name", "period").agg(F.count(F.lit(1)).alias("n"))
    return windows.period_change(counts, "n", "theme_name", "period", "change").drop("n")


RANKED = """
    SELECT customer_unique_id, snapshot_timestamp,
      row_number() OVER (PARTITION BY snapshot_timestamp ORDER BY repeat_purchase_probability DESC, customer_unique_id) AS decision_rank FROM x_scored"""


@query("rank_by_score", "E7", RANKED)
def rank_by_score(x):
    df = windows.rank_by_score(x["x_scored"], "repeat_purchase_probability", "customer_unique_id", "snapshot_timestamp")
    return df.select("customer_unique_id", "snapshot_timestamp", "decision_rank")


@query("rank_by_score_ranged", "E7", RANKED)
def rank_by_score_ranged(x):
    """The same ranks without a window over a whole population."""
    df = windows.rank_by_score(x["x_scored"], "repeat_purchase_probability", "customer_unique_id", "snapshot_timestamp", group_rows=1)
    return df.select("customer_unique_id", "snapshot_timestamp", "decision_rank")


@query("rank_first", "E8", """
    SELECT customer_unique_id, row_number() OVER (ORDER BY repeat_purchase_probability DESC, customer_unique_id) AS score_rank FROM x_scored""")
def rank_first(x):
    return windows.rank_first(x["x_scored"], "repeat_purchase_probability", "customer_unique_id", "score_rank").select(
        "customer_unique_id", "score_rank"
    )


@query("rank_percentile", "E9", """
    SELECT customer_unique_id, row_number() OVER (ORDER BY repeat_purchase_probability DESC, customer_unique_id)::DOUBLE / count(*) OVER () AS rank_percentile FROM x_scored""")
def rank_percentile(x):
    ranked = windows.rank_first(x["x_scored"], "repeat_purchase_probability", "customer_unique_id", "rank")
    return windows.rank_percentile(ranked, "rank").select("customer_unique_id", "rank_percentile")


@query("time_index", "E10", "SELECT date, (row_number() OVER (ORDER BY date) - 1)::INTEGER AS time_index FROM o_daily")
def time_index(x):
    return windows.time_index(x.daily, "date").select("date", "time_index")


@query("share_of_total", "E11", """
    SELECT theme_name, period, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY period) AS share FROM x_theme_events GROUP BY 1, 2""")
def share_of_total(x):
    counts = x["x_theme_events"].groupBy("theme_name", "period").agg(F.count(F.lit(1)).alias("n"))
    return agg.share_of_total(counts, "n", "period").drop("n")


@query("mixed_sort", "F1", """
    SELECT theme_name, period, n, row_number() OVER (ORDER BY period ASC, n DESC, theme_name ASC) AS at
    FROM (SELECT theme_name, period, count(*) AS n FROM x_theme_events GROUP BY 1, 2)""")
def mixed_sort(x):
    counts = x["x_theme_events"].groupBy("theme_name", "period").agg(F.count(F.lit(1)).alias("n"))
    ordered = topk.sort(counts, [("period", "asc"), ("n", "desc"), ("theme_name", "asc")])
    numbered = windows.number_rows(ordered, None, [F.col("period").asc(), F.col("n").desc(), F.col("theme_name").asc()], "at")
    return numbered.select("theme_name", "period", "n", "at")


@query("top_n", "F2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n(x):
    return topk.top_n(x["orders"].select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


@query("bottom_n", "F2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def bottom_n(x):
    return topk.top_n(x["orders"].select("o_orderkey", "o_totalprice"), "o_totalprice", 10, "o_orderkey", ascending=True)


@query("latest_complete_weeks", "F3", """
    SELECT WEEK_NO FROM x_transactions GROUP BY 1 HAVING min(DAY) < max(DAY) AND count(DISTINCT DAY) = 7 AND max(DAY) < 1200 ORDER BY 1 DESC LIMIT 8""")
def latest_complete_weeks(x):
    return topk.latest_complete_weeks(x["x_transactions"], 1200, 8)


@query("top_n_per_group", "F4", """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem)
    WHERE rank <= 5""")
def top_n_per_group(x):
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return topk.top_n_per_group(x["lineitem"], "l_suppkey", order, 5).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("target_counts", "F5", """
    SELECT snapshot_timestamp, f AS fraction, greatest(1, floor(count(*) * f))::BIGINT AS target_count
    FROM x_scored CROSS JOIN (SELECT unnest([0.01, 0.05, 0.29, 0.5])::DOUBLE AS f) GROUP BY 1, 2""")
def target_counts(x):
    sized = x["x_scored"].groupBy("snapshot_timestamp").agg(F.count(F.lit(1)).alias("n"))
    spread = sized.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in (0.01, 0.05, 0.29, 0.5)])))
    return spread.select("snapshot_timestamp", "fraction", target_count(F.col("n"), F.col("fraction")).alias("target_count"))


@query("group_totals", "D16 E11", """
    SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS customer_orders, max(o_totalprice) OVER (PARTITION BY o_custkey) AS largest FROM orders""")
def group_totals(x):
    df = with_group_total(x["orders"], "o_custkey", {"customer_orders": F.count(F.lit(1)), "largest": F.max("o_totalprice")})
    return df.select("o_orderkey", "customer_orders", "largest")
