"""Shared helpers of the training-data operators."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: words are maximal runs of other bytes than space and \t \n \v \f \r
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


_TABLES: list[str] = []                         # folders of this process' stored tables that were not deleted
_CALL = threading.local()                       # .made: those of the thread's innermost stored_alone


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the session's checkpoint folder, which
    every executor shares, and read it back: the rows no longer depend on the
    plan (or on the executors) that made them."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    _TABLES.append(path)
    if getattr(_CALL, "made", None) is not None:
        _CALL.made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Let the shuffle files of the queries run inside be deleted as each ends:
    a stored table needs them no longer, and the driver's garbage collection
    may come much later."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``stored(make(), name)``, after which the tables that ``make`` stored on
    the way are deleted."""
    outer, _CALL.made = getattr(_CALL, "made", None), []
    try:
        df = make()
        mine, _CALL.made = _CALL.made, outer
        out = stored(df, name)
    finally:
        _CALL.made = outer
    for path in mine:
        delete_folder(out.sparkSession, path)
        _TABLES.remove(path)
    return out


@contextmanager
def temporary(spark: SparkSession):
    """The tables that ``stored`` makes inside are deleted at the end."""
    outer, _CALL.made = getattr(_CALL, "made", None), []
    try:
        yield
        mine = _CALL.made
    finally:
        _CALL.made = outer
    for path in mine:
        delete_folder(spark, path)
        _TABLES.remove(path)


class Bucketed:
    """Tables bucketed by a column, under names of their own in the session's
    shared folder: what joins or groups them by that column shuffles none of
    them.  ``drop`` forgets and deletes one."""

    def __init__(self, spark: SparkSession, key: str, buckets: int):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.folder = ensure_checkpoint_dir(spark).rstrip("/")

    def write(self, df: DataFrame, name: str) -> str:
        table = f"{name}_{uuid.uuid4().hex}"
        with shuffles_deleted(self.spark):
            df.write.bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.folder}/{table}").saveAsTable(table)
        return table

    def read(self, table: str) -> DataFrame:
        return self.spark.table(table)

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete_folder(self.spark, f"{self.folder}/{table}")


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


BATCH_ROWS = 2000                               # whole texts that Python gets at a time


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ``BATCH_ROWS`` rows from here on: with whole
    texts in them, the default of 10,000 rows fills a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def buckets_for(items: int, per_bucket: int, least: int = 1) -> int:
    """Number of hash buckets that hold about ``per_bucket`` items each."""
    return max(least, -(-int(items) // per_bucket))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
