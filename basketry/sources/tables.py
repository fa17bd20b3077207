"""CSV and Parquet scans, Parquet and JSON sinks, versioned table snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, sampling_ratio: float = 0.1
) -> DataFrame:
    """CSV with a header; an explicit schema needs no extra pass, otherwise types come from a sample."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).option("samplingRatio", sampling_ratio).csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet with the schema of the files, or an imposed one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    compression: str | None = None,
    reconcile: bool = False,
) -> int | None:
    """Parquet sink; `mode="errorifexists"` refuses to overwrite.

    With `reconcile` the rows on disk, counted from the files' footers, have to be those of the input, which is
    counted by itself. The count is returned; a difference raises.

    Rows are dealt out by the partition columns first, so that a value has few files; a value with very many rows is split over as many
    tasks as its size asks for (adaptive rebalancing).
    """
    rows = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    writer = rows.write.mode(mode)
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if not reconcile:
        return None
    written, expected = df.sparkSession.read.parquet(path).count(), df.count()
    if written != expected:
        raise ValueError(f"row-count mismatch: source={expected}, written={written}")
    return written


def repartition_by(df: DataFrame, n: int, cols: Sequence[str]) -> DataFrame:
    """Hash-partition rows by key, for example before a partitioned write."""
    return df.repartition(n, *cols)


def partition_sizes(df: DataFrame) -> DataFrame:
    """Rows per physical partition."""
    return df.groupBy(F.spark_partition_id().alias("partition_id")).agg(F.count(F.lit(1)).alias("rows"))


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row, nested structs and arrays included."""
    df.write.mode(mode).json(path)


def register(df: DataFrame, name: str) -> DataFrame:
    """Expose a DataFrame to SQL under `name`."""
    df.createOrReplaceTempView(name)
    return df


def write_snapshot(df: DataFrame, path: str, snapshot_id: int) -> None:
    """Add version `snapshot_id` of a table; an existing version is never rewritten.

    A table folder is a set of Parquet folders `data/snapshot_id=<id>` and one-row records `commits/snapshot_id=<id>` with the time and the number of
    rows, counted from the files' footers. With a table catalog at hand the same calls map to `writeTo(...).overwritePartitions()` and
    `VERSION AS OF`.
    """
    version = f"snapshot_id={int(snapshot_id)}"
    df.write.mode("errorifexists").parquet(f"{path}/data/{version}")
    rows = df.sparkSession.read.parquet(f"{path}/data/{version}").count()
    commit = df.sparkSession.range(1).select(F.current_timestamp().alias("committed_at"), F.lit(rows).cast("long").alias("rows"))
    commit.write.mode("errorifexists").parquet(f"{path}/commits/{version}")


def snapshot_history(spark: SparkSession, path: str) -> DataFrame:
    """Committed versions by time, with their parent version and row count; reads the commit records alone."""
    versions = spark.read.parquet(f"{path}/commits")
    # one row per version: the window sees the short version list, never table rows
    from pyspark.sql import Window

    return versions.withColumn(
        "parent_id", F.lag("snapshot_id").over(Window.orderBy("committed_at", "snapshot_id"))
    ).orderBy("committed_at", "snapshot_id")


def read_as_of(spark: SparkSession, path: str, snapshot_id: int) -> DataFrame:
    """The table as of one version; only that version's folder is scanned."""
    return spark.read.parquet(f"{path}/data").filter(F.col("snapshot_id") == F.lit(int(snapshot_id))).drop("snapshot_id")


def compare_snapshots(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Row counts of two versions, their difference, and keys added or removed between them."""
    left = a.groupBy(*key).agg(F.count(F.lit(1)).alias("rows_a"))
    right = b.groupBy(*key).agg(F.count(F.lit(1)).alias("rows_b"))
    both = left.join(right, list(key), "full_outer")
    return both.agg(
        F.coalesce(F.sum("rows_a"), F.lit(0)).alias("rows_a"),
        F.coalesce(F.sum("rows_b"), F.lit(0)).alias("rows_b"),
        (F.coalesce(F.sum("rows_b"), F.lit(0)) - F.coalesce(F.sum("rows_a"), F.lit(0))).alias("row_difference"),
        F.count_if(F.col("rows_a").isNull()).alias("keys_added"),
        F.count_if(F.col("rows_b").isNull()).alias("keys_removed"),
    )
