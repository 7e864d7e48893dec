"""Tables kept in the cluster's shared folder, so that lost executors cost a reread and not a recomputation."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barograph.session import dropped_shuffles


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode, where all tasks share the disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="barograph-")


@contextlib.contextmanager
def _batch_rows(spark: SparkSession, rows: int | None):
    """Arrow batches of at most so many rows in the queries that run in here."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows or before))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write df under the shared folder and read it back: a short lineage that survives lost executors.

    `batch_rows` bounds the Arrow batches of the write, where whole texts and what is made of them take much memory.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with dropped_shuffles(spark), _batch_rows(spark, batch_rows):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete staged tables whose last reader has been staged itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Tables up to so many bytes are broadcast, larger ones are shuffled.
BROADCAST_BYTES = 32 << 20


def sized(table: DataFrame, width: Column) -> DataFrame:
    """A staged table, with a broadcast hint if its rows of the given width take few bytes in all."""
    taken = table.agg(F.sum(width + 64).alias("n")).first().n or 0
    return F.broadcast(table) if taken <= BROADCAST_BYTES else table


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
