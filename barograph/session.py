"""Spark session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession


CONSTRAINTS = "spark.sql.constraintPropagation.enabled"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "barograph", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time and adaptive execution.

    Shuffle width is left to the cluster's own setting; adaptive execution coalesces small partitions and splits
    skewed ones. A local master gets a width that fits one machine.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # Joins on top of the wide feature block make the optimizer derive constraints from hundreds of aliases, which
        # can take longer than the query; nothing here depends on derived filters.
        .config(CONSTRAINTS, "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
        if master.startswith("local"):
            builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's ``spark.checkpoint.dir``, else a folder of our own (local runs)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared)
        return shared
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="barograph-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current


@contextlib.contextmanager
def dropped_shuffles(spark: SparkSession):
    """Queries that end in here leave no shuffle files behind: for writes whose result is read back from its files."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialized(df):
    """Rows written once to the shared folder as Parquet and read back, for results that several jobs read.

    Readers prune columns, push filters and have the files' sizes; lost executors cost a reread.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/barograph-{uuid.uuid4().hex}"
    with dropped_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
