"""Typing, cleaning, projection, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.catalog import query
from basketry.functions import dates, text, values
from basketry.operators import columns
from basketry.operators.sets import union_all
from basketry.plans import silver
from basketry.session import scratch_path
from basketry.sources.tables import read_table

# The raw form of a table: text columns with stray white space, mixed case and unreadable values.
RAW_CUSTOMERS = """
    SELECT c_custkey::VARCHAR AS customer_id, c_name AS customer_unique_id, (c_custkey % 100)::VARCHAR AS customer_zip_code_prefix,
      lower(c_mktsegment) AS customer_city, upper('x' || c_nationkey::VARCHAR) AS customer_state FROM customer"""
SPACE = r"[\s\x1c-\x1f\x0b\x85\p{Z}]+"


@query("clean_text", "B1", rf"""
    SELECT doc_id, regexp_replace(regexp_replace(text, '{SPACE}', ' ', 'g'), '^ | $', '', 'g') AS cleaned FROM documents""")
def clean_text(x):
    return x["documents"].select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("standard_case", "B2", """
    SELECT c_custkey, lower(c_mktsegment) AS segment, upper(n_name) AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def standard_case(x):
    named = x["customer"].join(x["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    padded = named.select("c_custkey", F.concat(F.lit(" "), "c_mktsegment", F.lit("\t")).alias("s"), F.concat("n_name", F.lit("  ")).alias("n"))
    return padded.select("c_custkey", text.lower_text(F.col("s")).alias("segment"), text.upper_text(F.col("n")).alias("nation"))


@query("coerced_timestamp", "B3", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS parsed FROM orders""")
def coerced_timestamp(x):
    raw = F.when(F.col("o_orderkey") % 7 == 0, F.lit("not a date")).otherwise(F.col("o_orderdate").cast("string"))
    return x["orders"].select("o_orderkey", text.to_ts(raw).cast("timestamp_ntz").alias("parsed"))


@query("coerced_number", "B4", """
    SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price FROM part""")
def coerced_number(x):
    raw = F.when(F.col("p_partkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string"))
    return x["part"].select("p_partkey", text.to_num(raw).alias("price"))


@query("strict_projection", "B5 B6", """
    SELECT s_suppkey::BIGINT AS supplier, trim(s_name) AS name, s_nationkey::BIGINT AS nation, s_acctbal::DOUBLE AS balance FROM supplier""")
def strict_projection(x):
    raw = x["supplier"].select(
        F.col("s_suppkey").cast("string").alias("supplier"), F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("name"),
        F.col("s_nationkey").cast("string").alias("nation"), F.col("s_acctbal").cast("string").alias("balance"),
    )
    return columns.project(raw, {"supplier": "bigint", "name": F.trim("name"), "nation": "bigint", "balance": "double"})


@query("silver_customers", "B7", RAW_CUSTOMERS.replace("(c_custkey % 100)::VARCHAR", "(c_custkey % 100)::BIGINT"))
def silver_customers(x):
    c = x["customer"]
    raw = c.select(
        F.col("c_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("customer_unique_id"),
        F.concat(F.col("c_custkey") % 100, F.lit(" ")).alias("customer_zip_code_prefix"),
        F.concat(F.lit(" \t"), F.lower("c_mktsegment"), F.lit("\n")).alias("customer_city"),
        F.concat(F.lit("x"), "c_nationkey", F.lit(" ")).alias("customer_state"),
    )
    return silver.silver_customers(raw)


@query("silver_order_items", "B7", """
    SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
      l_shipdate AS shipping_limit_date, l_extendedprice AS price,
      CASE WHEN l_linenumber <> 3 THEN l_tax END AS freight_value FROM lineitem""")
def silver_order_items(x):
    raw = x["lineitem"].select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("string").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").cast("string").alias("shipping_limit_date"), F.col("l_extendedprice").cast("string").alias("price"),
        F.when(F.col("l_linenumber") == 3, "?").otherwise(F.col("l_tax").cast("string")).alias("freight_value"),
    )
    out = silver.silver_order_items(raw)
    return out.withColumn("shipping_limit_date", F.col("shipping_limit_date").cast("timestamp_ntz"))


@query("silver_payments", "B7", """
    SELECT order_id, payment_sequential::BIGINT AS payment_sequential, payment_type,
      payment_installments::BIGINT AS payment_installments, payment_value FROM x_order_payments""")
def silver_payments(x):
    raw = x["x_order_payments"].withColumn("payment_type", F.concat(F.lit(" "), F.upper("payment_type")))
    return silver.silver_payments(raw)


@query("silver_reviews", "B7", rf"""
    SELECT review_id, order_id, review_score::BIGINT AS review_score,
      regexp_replace(regexp_replace(review_comment_message, '{SPACE}', ' ', 'g'), '^ | $', '', 'g') AS review_comment_message,
      review_creation_date FROM x_reviews""")
def silver_reviews(x):
    raw = x["x_reviews"].select("review_id", "order_id", "review_score", "review_comment_message", "review_creation_date")
    return silver.silver_reviews(raw).withColumn("review_creation_date", F.col("review_creation_date").cast("timestamp_ntz"))


@query("silver_products", "B7", """
    SELECT product_id, product_category_name, product_name_lenght::DOUBLE AS product_name_lenght,
      product_description_lenght::DOUBLE AS product_description_lenght, product_photos_qty::DOUBLE AS product_photos_qty FROM x_products""")
def silver_products(x):
    return silver.silver_products(x["x_products"].withColumn("product_category_name", F.concat("product_category_name", F.lit("  "))))


@query("silver_sellers", "B7", """
    SELECT seller_id, seller_zip_code_prefix::BIGINT AS seller_zip_code_prefix, seller_city, upper(seller_state) AS seller_state FROM x_sellers""")
def silver_sellers(x):
    return silver.silver_sellers(x["x_sellers"].withColumn("seller_state", F.concat(F.lit("\t"), F.lower("seller_state"))))


@query("silver_geolocation", "B7", """
    SELECT (c_custkey % 100)::BIGINT AS geolocation_zip_code_prefix, c_acctbal AS geolocation_lat, c_acctbal / 2 AS geolocation_lng,
      lower(c_mktsegment) AS geolocation_city, upper(n_name) AS geolocation_state
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def silver_geolocation(x):
    named = x["customer"].join(x["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    raw = named.select(
        (F.col("c_custkey") % 100).cast("string").alias("geolocation_zip_code_prefix"),
        F.col("c_acctbal").cast("string").alias("geolocation_lat"), (F.col("c_acctbal") / 2).cast("string").alias("geolocation_lng"),
        F.lower("c_mktsegment").alias("geolocation_city"), F.lower("n_name").alias("geolocation_state"),
    )
    return silver.silver_geolocation(raw)


@query("silver_category_translation", "B7", "SELECT * FROM x_category_translation")
def silver_category_translation(x):
    return silver.silver_category_translation(x["x_category_translation"])


@query("silver_orders_job", "B2 B3 B7 J1", """
    SELECT *, CASE WHEN coalesce(delivery_delay_days, 0) > 0 THEN 1 ELSE 0 END AS is_late_delivery FROM (
      SELECT *, date_diff('day', order_estimated_delivery_date::DATE, order_delivered_customer_date::DATE)::INTEGER AS delivery_delay_days
      FROM x_orders)""")
def silver_orders_job(x):
    orders = x["x_orders"]
    stamps = [c for c, kind in orders.dtypes if kind == "timestamp_ntz"]
    raw = orders.withColumns({**{c: F.col(c).cast("string") for c in stamps}, "order_status": F.concat(F.lit(" "), F.upper("order_status"))})
    return silver.silver_orders(raw).withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


HOUSEHOLD_TABLES: dict[str, tuple] = {}


def _household(name: str, sql: str, table: str, make):
    HOUSEHOLD_TABLES[table] = (sql, make)

    @query(name, "B5 B6 B8", sql)
    def run(x, table=table, make=make):
        return silver.silver_household(make(x), table)


def _text(df, cols):
    return df.withColumns({c: F.concat(F.lit(" "), F.col(c), F.lit(" ")) for c in cols})


_household(
    "household_campaign_desc", "SELECT 'Type' || (CAMPAIGN % 3)::VARCHAR AS DESCRIPTION, CAMPAIGN::BIGINT AS CAMPAIGN, START_DAY::BIGINT AS START_DAY, END_DAY::BIGINT AS END_DAY FROM x_campaigns",
    "campaign_desc", lambda x: x["x_campaigns"].withColumn("DESCRIPTION", F.concat(F.lit(" Type"), F.col("CAMPAIGN") % 3, F.lit(" "))),
)
_household(
    "household_campaign_table", "SELECT 'Type' || (CAMPAIGN % 3)::VARCHAR AS DESCRIPTION, household_key, CAMPAIGN::BIGINT AS CAMPAIGN FROM x_assignments",
    "campaign_table", lambda x: x["x_assignments"].withColumn("DESCRIPTION", F.concat(F.lit("Type"), F.col("CAMPAIGN") % 3, F.lit(" "))),
)
_household(
    "household_causal_data", """
    SELECT l_partkey AS PRODUCT_ID, l_suppkey AS STORE_ID, l_linenumber::BIGINT AS WEEK_NO, l_returnflag AS display, l_linestatus AS mailer FROM lineitem""",
    "causal_data", lambda x: _text(x["lineitem"].select(F.col("l_partkey").alias("PRODUCT_ID"), F.col("l_suppkey").alias("STORE_ID"), F.col("l_linenumber").alias("WEEK_NO"), F.col("l_returnflag").alias("display"), F.col("l_linestatus").alias("mailer")), ["display", "mailer"]),
)
_household(
    "household_coupon", "SELECT l_orderkey AS COUPON_UPC, l_partkey AS PRODUCT_ID, l_linenumber::BIGINT AS CAMPAIGN FROM lineitem",
    "coupon", lambda x: x["lineitem"].select(F.col("l_orderkey").alias("COUPON_UPC"), F.col("l_partkey").alias("PRODUCT_ID"), F.col("l_linenumber").cast("string").alias("CAMPAIGN")),
)
_household(
    "household_coupon_redempt", "SELECT household_key, DAY::BIGINT AS DAY, BASKET_ID AS COUPON_UPC, WEEK_NO::BIGINT AS CAMPAIGN FROM x_transactions",
    "coupon_redempt", lambda x: x["x_transactions"].select("household_key", "DAY", F.col("BASKET_ID").alias("COUPON_UPC"), F.col("WEEK_NO").alias("CAMPAIGN")),
)
_household(
    "household_demographic", """
    SELECT c_mktsegment AS AGE_DESC, 'M' AS MARITAL_STATUS_CODE, c_mktsegment AS INCOME_DESC, c_name AS HOMEOWNER_DESC, 'a' AS HH_COMP_DESC,
      '2' AS HOUSEHOLD_SIZE_DESC, 'None' AS KID_CATEGORY_DESC, c_custkey AS household_key FROM customer""",
    "hh_demographic", lambda x: x["customer"].select(F.concat(F.lit("  "), "c_mktsegment").alias("AGE_DESC"), F.lit("M ").alias("MARITAL_STATUS_CODE"), F.col("c_mktsegment").alias("INCOME_DESC"), F.concat("c_name", F.lit(" ")).alias("HOMEOWNER_DESC"), F.lit("a").alias("HH_COMP_DESC"), F.lit("2").alias("HOUSEHOLD_SIZE_DESC"), F.lit("None").alias("KID_CATEGORY_DESC"), F.col("c_custkey").alias("household_key")),
)
_household(
    "household_product", """
    SELECT p_partkey AS PRODUCT_ID, p_size::BIGINT AS MANUFACTURER, p_type AS DEPARTMENT, p_brand AS BRAND, p_name AS COMMODITY_DESC,
      p_type AS SUB_COMMODITY_DESC, p_size::VARCHAR AS CURR_SIZE_OF_PRODUCT FROM part""",
    "product", lambda x: _text(x["part"].select(F.col("p_partkey").alias("PRODUCT_ID"), F.col("p_size").alias("MANUFACTURER"), F.col("p_type").alias("DEPARTMENT"), F.col("p_brand").alias("BRAND"), F.col("p_name").alias("COMMODITY_DESC"), F.col("p_type").alias("SUB_COMMODITY_DESC"), F.col("p_size").cast("string").alias("CURR_SIZE_OF_PRODUCT")), ["DEPARTMENT", "BRAND", "CURR_SIZE_OF_PRODUCT"]),
)
_household(
    "household_transaction_data", """
    SELECT t.household_key, BASKET_ID, DAY::BIGINT AS DAY, l_partkey AS PRODUCT_ID, l_quantity::BIGINT AS QUANTITY, l_extendedprice AS SALES_VALUE,
      l_suppkey AS STORE_ID, -l_discount AS RETAIL_DISC, '1200' AS TRANS_TIME, WEEK_NO::BIGINT AS WEEK_NO, l_tax AS COUPON_DISC, 0::DOUBLE AS COUPON_MATCH_DISC
    FROM x_transactions t JOIN lineitem ON BASKET_ID = l_orderkey""",
    "transaction_data", lambda x: x["x_transactions"].drop("SALES_VALUE").join(x["lineitem"], F.col("BASKET_ID") == F.col("l_orderkey")).select("household_key", "BASKET_ID", "DAY", F.col("l_partkey").alias("PRODUCT_ID"), F.col("l_quantity").alias("QUANTITY"), F.col("l_extendedprice").cast("string").alias("SALES_VALUE"), F.col("l_suppkey").alias("STORE_ID"), (-F.col("l_discount")).alias("RETAIL_DISC"), F.lit(" 1200").alias("TRANS_TIME"), "WEEK_NO", F.col("l_tax").alias("COUPON_DISC"), F.lit(0).alias("COUPON_MATCH_DISC")),
)


@query("household_silver_files", "A6 B8", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows_written, count(*) AS rows_read, {len(silver.HOUSEHOLD[t])}::INTEGER AS columns FROM ({sql})" for t, (sql, _) in HOUSEHOLD_TABLES.items()))
def household_silver_files(x):
    """All eight tables cleaned, written once each and reconciled with what went into the write."""
    folder = scratch_path(x.spark, "household-silver")
    written = silver.write_household({t: make(x) for t, (_, make) in HOUSEHOLD_TABLES.items()}, folder)
    parts = [
        read_table(x.spark, f"{folder}/{t}").agg(
            F.lit(t).alias("table"), F.lit(rows).cast("long").alias("rows_written"), F.count(F.lit(1)).alias("rows_read"), F.lit(len(silver.HOUSEHOLD[t])).alias("columns")
        )
        for t, rows in written.items()
    ]
    return union_all(*parts).select("table", "rows_written", "rows_read", "columns")


@query("select_available", "B9", "SELECT p_partkey, p_brand FROM part")
def select_available(x):
    return columns.select_available(x["part"], ["p_partkey", "not_there", "p_brand"])


@query("row_filters", "B10", """
    SELECT review_observation_id, review_score FROM x_reviews
    WHERE review_score IN (1, 2, 5) AND review_creation_date BETWEEN TIMESTAMP '2000-02-01' AND TIMESTAMP '2000-09-30'
      AND review_comment_message IS NOT NULL AND trim(review_comment_message) <> ''""")
def row_filters(x):
    df = columns.with_text(x["x_reviews"], "review_comment_message")
    inside = F.col("review_creation_date").between(F.lit("2000-02-01").cast("timestamp_ntz"), F.lit("2000-09-30").cast("timestamp_ntz"))
    return df.filter(F.col("review_score").isin(1, 2, 5) & inside).select("review_observation_id", "review_score")


@query("static_labels", "B11", """
    SELECT vec_id, CASE label WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'other' END AS name FROM embeddings""")
def static_labels(x):
    return x["embeddings"].select("vec_id", values.map_labels(F.col("label"), {0: "zero", 1: "one"}, "other").alias("name"))


@query("literal_columns", "B12", "SELECT c_custkey, 'KMeans' AS model, 'v1.0' AS version, 4 AS n_clusters FROM customer")
def literal_columns(x):
    return columns.with_literals(x["customer"].select("c_custkey"), {"model": "KMeans", "version": "v1.0", "n_clusters": 4})


@query("observation_id", "B13", """
    SELECT doc_id, row_number() OVER (ORDER BY lang, n_chars, doc_id) AS review_observation_id FROM documents""")
def observation_id(x):
    return columns.add_observation_id(x["documents"].select("doc_id", "lang", "n_chars"), ["lang", "n_chars", "doc_id"]).select(
        "doc_id", "review_observation_id"
    )


@query("drop_incomplete", "B14", """
    SELECT order_id, order_delivered_customer_date FROM x_orders
    WHERE order_delivered_customer_date IS NOT NULL AND order_delivered_carrier_date IS NOT NULL""")
def drop_incomplete(x):
    df = columns.drop_incomplete(x["x_orders"], ["order_delivered_customer_date", "order_delivered_carrier_date"])
    return df.select("order_id", "order_delivered_customer_date")


@query("staged_customers", "B15", "SELECT customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state FROM x_customers")
def staged_customers(x):
    return columns.staged(x["x_customers"], "customers")


@query("staged_order_items", "B15", "SELECT order_id, order_item_id, product_id, seller_id, shipping_limit_date FROM x_order_items")
def staged_order_items(x):
    return columns.staged(x["x_order_items"], "order_items")


@query("staged_products", "B15", """
    SELECT product_id, product_category_name, product_name_lenght::INTEGER AS product_name_lenght, product_description_lenght, product_photos_qty FROM x_products""")
def staged_products(x):
    return columns.staged(x["x_products"], "products")


@query("staged_category_translation", "B15", "SELECT product_category_name, product_category_name_english FROM x_category_translation")
def staged_category_translation(x):
    return columns.staged(x["x_category_translation"], "category_translation")


@query("date_parts", "H1 H2", """
    SELECT order_id, year(t)::INTEGER AS y, month(t)::INTEGER AS m, day(t)::INTEGER AS d, hour(t)::INTEGER AS h, dayofweek(t)::INTEGER AS sunday0,
      (isodow(t) - 1)::INTEGER AS monday0 FROM (SELECT order_id, order_purchase_timestamp AS t FROM x_orders)""")
def date_parts(x):
    t = F.col("order_purchase_timestamp")
    return x["x_orders"].select(
        "order_id", F.year(t).alias("y"), F.month(t).alias("m"), F.dayofmonth(t).alias("d"), F.hour(t).alias("h"),
        dates.dow_sunday0(t).alias("sunday0"), dates.dow_monday0(t).alias("monday0"),
    )


@query("calendar_features", "H3", """
    SELECT DISTINCT o_orderdate::DATE AS date, (isodow(o_orderdate) - 1)::INTEGER AS day_of_week, day(o_orderdate)::INTEGER AS day_of_month,
      month(o_orderdate)::INTEGER AS month, quarter(o_orderdate)::INTEGER AS quarter, week(o_orderdate)::INTEGER AS week_of_year,
      CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM orders""")
def calendar_features(x):
    days = x["orders"].select(F.to_date("o_orderdate").alias("date")).distinct()
    return dates.calendar_features(days, "date")


@query("date_labels", "H4", """
    SELECT order_id, dayname(order_purchase_timestamp) AS weekday, strftime(order_purchase_timestamp, '%Y-%m') AS month FROM x_orders""")
def date_labels(x):
    t = F.col("order_purchase_timestamp")
    return x["x_orders"].select("order_id", dates.weekday_name(t).alias("weekday"), dates.month_label(t).alias("month"))


@query("day_differences", "H5 H8 H9", """
    SELECT order_id, date_diff('day', a::DATE, b::DATE)::INTEGER AS midnights, epoch(b - a) / 86400 AS days,
      floor(epoch(b - a) / 86400)::BIGINT AS whole
    FROM (SELECT order_id, order_purchase_timestamp AS a, order_delivered_customer_date AS b FROM x_orders)""")
def day_differences(x):
    a, b = F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    return x["x_orders"].select(
        "order_id", dates.days_between(a, b).alias("midnights"), dates.fractional_days(b, a).alias("days"), dates.whole_days(b, a).alias("whole")
    )


@query("month_differences", "H6 H7", """
    SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month_start,
      date_diff('month', o_orderdate::DATE, l_shipdate::DATE)::INTEGER AS months
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def month_differences(x):
    both = x["orders"].join(x["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select(
        "o_orderkey", dates.month_start(F.col("o_orderdate")).alias("month_start"),
        dates.months_between_int(F.col("o_orderdate"), F.col("l_shipdate")).alias("months"),
    )


@query("month_end_series", "H7", """
    SELECT last_day(d::DATE) AS month_end FROM (
      SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS d, max(o_orderdate) AS hi FROM orders)
    WHERE last_day(d::DATE) <= hi::DATE""")
def month_end_series(x):
    bounds = x["orders"].agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return bounds.select(F.explode(dates.month_end_list(F.col("a"), F.col("b"))).alias("month_end"))


@query("numeric_functions", "H10", """
    SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 9) AS log1p, abs(c_acctbal) AS abs, round(sqrt(abs(c_acctbal)), 9) AS sqrt,
      round(pow(c_acctbal / 1000, 2), 6) AS squared, least(greatest(c_acctbal, 0), 5000) AS clipped FROM customer""")
def numeric_functions(x):
    v = F.col("c_acctbal")
    return x["customer"].select(
        "c_custkey", F.round(F.log1p(F.greatest(v, F.lit(0.0))), 9).alias("log1p"), F.abs(v).alias("abs"),
        F.round(F.sqrt(F.abs(v)), 9).alias("sqrt"), F.round(F.pow(v / 1000, 2), 6).alias("squared"), values.clip(v, 0.0, 5000.0).alias("clipped"),
    )


@query("labelled_bands", "H11", """
    SELECT c_custkey, CASE WHEN c_acctbal <= -1000 THEN NULL WHEN c_acctbal <= 0 THEN 'debt' WHEN c_acctbal <= 2500 THEN 'low'
      WHEN c_acctbal <= 7500 THEN 'mid' ELSE 'high' END AS band FROM customer""")
def labelled_bands(x):
    b = values.band(F.col("c_acctbal"), [-1000, 0, 2500, 7500, float("inf")], ["debt", "low", "mid", "high"])
    return x["customer"].select("c_custkey", b.alias("band"))


@query("text_measures", "H12", rf"""
    SELECT doc_id, lang || ':' || source AS tag, length(text) AS chars,
      len(list_filter(string_split_regex(text, '{SPACE}'), lambda w: w <> '')) AS words,
      regexp_matches(lower(text), '(^|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])the($|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])') AS has_the,
      (length(text) - length(replace(text, '.', '')))::INTEGER AS dots FROM documents""")
def text_measures(x):
    t = F.col("text")
    return x["documents"].select(
        "doc_id", F.concat_ws(":", "lang", "source").alias("tag"), text.text_length(t).alias("chars"), text.word_count(t).alias("words"),
        text.has_word(F.lower(t), "the").alias("has_the"), F.regexp_count(t, F.lit(r"\.")).alias("dots"),
    )


@query("null_handling", "H13", """
    SELECT order_id, coalesce(date_diff('day', order_purchase_timestamp::DATE, order_delivered_customer_date::DATE), 0)::INTEGER AS days0,
      nullif(order_status, 'shipped') AS status,
      CASE WHEN order_delivered_customer_date IS NULL THEN 'open' WHEN order_status = 'delivered' THEN 'done' ELSE 'odd' END AS state FROM x_orders""")
def null_handling(x):
    done = F.col("order_delivered_customer_date")
    return x["x_orders"].select(
        "order_id", values.coalesce0(dates.days_between(F.col("order_purchase_timestamp"), done)).alias("days0"),
        F.nullif("order_status", F.lit("shipped")).alias("status"),
        values.ladder([(done.isNull(), "open"), (F.col("order_status") == "delivered", "done")], "odd").alias("state"),
    )


@query("record_ids", "H15", """
    SELECT DISTINCT 'VOC-' || strftime(ts, '%Y-%m') || '-CLUSTER-' || event_type AS decision_id FROM events""")
def record_ids(x):
    return x["events"].select(values.record_id("VOC-%s-CLUSTER-%s", F.date_format("ts", "yyyy-MM"), F.col("event_type")).alias("decision_id")).distinct()
