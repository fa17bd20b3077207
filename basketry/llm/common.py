"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import release, scratch_path  # noqa: F401

#: One run of these characters separates words (fixed by the contract of the word-based operators).
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame, name: str, **options: int) -> DataFrame:
    """`df` written once to the shared folder and read back: what follows never runs its plan again, whatever executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a `stored` table that no later step reads."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def bucketed(df: DataFrame, name: str, keys: list[str], parts: int) -> DataFrame:
    """`df` written once as a table of `parts` buckets by `keys`: joins with rows dealt to as many parts by these keys don't move it again.

    The session's catalog is asked for the writing only; the files go as those of `stored` do.
    """
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    writer = df.repartition(parts, *keys).write.format("parquet").options(compression="zstd", path=path)
    writer.bucketBy(parts, *keys).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its files are external and stay
    out._stored_at = path
    return out


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != F.lit(""))


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as bytes: `bytes.split` knows just the six ASCII spaces, `bytes.lower` just A-Z."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def batches(rows: Iterable[dict], schema: pa.Schema, limit: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of at most `limit` rows."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def spread(total: int, each: int) -> int:
    """Number of parts that hold about `each` units of `total`."""
    return max(1, -(-total // each))
