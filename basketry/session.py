"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "basketry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; `conf` wins over them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot join key even where that costs one more shuffle
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in `spark.checkpoint.dir`. Where that is unset, as in tests, the session's warehouse is used: on a local master any
    folder will do; on a cluster it has to lie in a shared file system, since every executor would write to its own disk otherwise.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    scheme = spark._jvm.org.apache.hadoop.fs.Path(warehouse).toUri().getScheme() or "file"
    if scheme == "file" and not local:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place.getParent())
    _at_exit(spark, files, place)
    return path


@contextmanager
def shuffle_partitions(spark: SparkSession, least: int) -> Iterator[None]:
    """At least that many shuffle partitions for the actions inside, for aggregates whose size is known; adaptive execution still joins small ones."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(int(before), least)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def stored(df: DataFrame, name: str, **options: int) -> DataFrame:
    """`df` written once to the shared folder and read back, so that lost executors never re-evaluate it."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a `stored` table that nothing reads any more."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more, between the steps of a long job.

    Spark's cleaner acts when the driver has collected its garbage; references from Python go first, so it takes two rounds.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def _at_exit(spark: SparkSession, files, place) -> None:
    """Hadoop removes `place` at the end of the JVM; it only notes paths that exist, so the folder is made for a moment."""
    files.mkdirs(place)
    files.deleteOnExit(place)
    files.delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize `df` reliably, so that lost executors never re-evaluate it differently."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
