"""Sources and sinks. Files are written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.catalog import query
from basketry.operators.ordering import as_list
from basketry.session import scratch_path
from basketry.sources import tables as io

CSV_ORDERS = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("order_status", T.StringType()),
        T.StructField("order_purchase_timestamp", T.TimestampNTZType()),
        T.StructField("order_delivered_customer_date", T.TimestampNTZType()),
    ]
)
CSV_COLUMNS = "order_id, customer_id, order_status, order_purchase_timestamp, order_delivered_customer_date"


def _csv(x) -> str:
    path = scratch_path(x.spark, "orders-csv")
    x["x_orders"].select(*CSV_ORDERS.fieldNames()).write.option("header", True).csv(path)
    return path


@query("csv_explicit_schema", "A1", f"SELECT {CSV_COLUMNS} FROM x_orders")
def csv_explicit_schema(x):
    return io.read_csv(x.spark, _csv(x), CSV_ORDERS)


@query("csv_sampled_types", "A2", """
    SELECT order_status, count(*) AS orders, min(order_id)::BIGINT AS first_id, max(order_id)::BIGINT AS last_id,
      max(order_purchase_timestamp) AS last_purchase
    FROM x_orders GROUP BY 1""")
def csv_sampled_types(x):
    df = io.read_csv(x.spark, _csv(x), sampling_ratio=0.5)
    return df.groupBy("order_status").agg(
        F.count(F.lit(1)).alias("orders"), F.min("order_id").cast("long").alias("first_id"),
        F.max("order_id").cast("long").alias("last_id"),
        F.max("order_purchase_timestamp").cast("timestamp_ntz").alias("last_purchase"),
    )


@query("parquet_scan", "A3", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
def parquet_scan(x):
    schema = "o_orderkey bigint, o_orderstatus string, o_totalprice double"
    df = io.read_table(x.spark, f"{x.folder}/orders.parquet", schema)
    return df.filter("o_totalprice > 250000 AND o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("parquet_sink", "A4", "SELECT * FROM x_order_payments")
def parquet_sink(x):
    path = scratch_path(x.spark, "payments")
    io.write_table(x["x_order_payments"], path)
    return io.read_table(x.spark, path)


@query("parquet_partitioned_sink", "A5 A7", """
    SELECT order_id, order_status FROM x_orders WHERE order_status = 'delivered'""")
def parquet_partitioned_sink(x):
    path = scratch_path(x.spark, "orders-by-status")
    keyed = io.repartition_by(x["x_orders"].select("order_id", "order_status"), 8, ["order_status"])
    io.write_table(keyed, path, partition_by=["order_status"])
    return io.read_table(x.spark, path).filter(F.col("order_status") == "delivered").select("order_id", "order_status")


@query("compressed_reconciled_sink", "A6", """
    SELECT (SELECT count(*) FROM x_transactions) AS rows_written, household_key, count(*) AS baskets
    FROM x_transactions GROUP BY household_key""")
def compressed_reconciled_sink(x):
    path = scratch_path(x.spark, "transactions")
    rows = io.write_table(x["x_transactions"], path, mode="errorifexists", compression="zstd", reconcile=True)
    back = io.read_table(x.spark, path)
    return back.groupBy("household_key").agg(F.lit(rows).cast("long").alias("rows_written"), F.count(F.lit(1)).alias("baskets"))


@query("repartition_by_key", "A7", """
    SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT customer_state FROM x_customers)) AS keys,
      1 AS partitions_per_key FROM x_customers""")
def repartition_by_key(x):
    placed = io.repartition_by(x["x_customers"], 8, ["customer_state"]).withColumn("p", F.spark_partition_id())
    per_key = placed.groupBy("customer_state").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p").alias("p"))
    return per_key.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.max("p").cast("int").alias("partitions_per_key")
    )


@query("json_record_sink", "A8", """
    SELECT order_id, count(*)::INTEGER AS n_lines,
      '[' || string_agg('{"order_item_id":' || order_item_id || ',"product_id":' || product_id || ',"price":' || price::DOUBLE || '}', ',' ORDER BY order_item_id, product_id, price) || ']' AS lines
    FROM x_order_items GROUP BY 1""")
def json_record_sink(x):
    path = scratch_path(x.spark, "order-records")
    lines = x["x_order_items"].groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct("order_item_id", "product_id", "price"))).alias("lines")
    )
    io.write_records(lines, path)
    schema = "order_id bigint, lines array<struct<order_item_id:int,product_id:bigint,price:double>>"
    return x.spark.read.schema(schema).json(path).select("order_id", F.size("lines").alias("n_lines"), F.to_json("lines").alias("lines"))


def _versions(x) -> str:
    """Version 1: every order but the cancelled. Version 2: all orders."""
    path = scratch_path(x.spark, "order-versions")
    orders = x["x_orders"].select("order_id", "order_status")
    io.write_snapshot(orders.filter("order_status <> 'canceled'"), path, 1)
    io.write_snapshot(orders, path, 2)
    return path


@query("snapshot_history", "A9", """
    SELECT 1 AS snapshot_id, NULL::INTEGER AS parent_id, count(*) FILTER (order_status <> 'canceled') AS rows FROM x_orders
    UNION ALL SELECT 2, 1, count(*) FROM x_orders""")
def snapshot_history(x):
    return io.snapshot_history(x.spark, _versions(x)).select("snapshot_id", "parent_id", "rows")


@query("snapshot_as_of", "A9", "SELECT order_id, order_status FROM x_orders WHERE order_status <> 'canceled'")
def snapshot_as_of(x):
    return io.read_as_of(x.spark, _versions(x), 1)


@query("snapshot_compare", "A9", """
    SELECT count(*) FILTER (order_status <> 'canceled') AS rows_a, count(*) AS rows_b,
      count(*) FILTER (order_status = 'canceled') AS row_difference,
      count(*) FILTER (order_status = 'canceled') AS keys_added, 0::BIGINT AS keys_removed FROM x_orders""")
def snapshot_compare(x):
    path = _versions(x)
    return io.compare_snapshots(io.read_as_of(x.spark, path, 1), io.read_as_of(x.spark, path, 2), as_list("order_id"))


@query("temp_view_sql", "A10", """
    SELECT order_status, count(*) AS orders, count(order_delivered_customer_date) AS delivered FROM x_orders GROUP BY 1""")
def temp_view_sql(x):
    io.register(x["x_orders"], "basketry_orders")
    return x.spark.sql(
        "SELECT order_status, count(*) AS orders, count(order_delivered_customer_date) AS delivered "
        "FROM basketry_orders GROUP BY order_status"
    )
