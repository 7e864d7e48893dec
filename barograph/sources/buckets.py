"""Tables of daily rows kept in buckets by symbol: windows per symbol and joins by symbol read them without a shuffle.

A symbol's rows lie in the same bucket of every such table with as many buckets, in all partitions; a scan gives one task
per bucket. Partitions are years, so that a table of n buckets has n files a year. The layout is for tables with one row per
symbol and day: a symbol then is bounded by the calendar, and no bucket can hold more than its symbols' days.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from barograph.sources.tables import conform, exists, upsert

CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


@dataclass(frozen=True)
class Buckets:
    """A bucketed table: its name in the catalog, folder, schema with `part`, and number of buckets."""

    table: str
    path: str
    schema: T.StructType
    buckets: int = 200
    key: str = "symbol"
    part: str = "year"

    def ddl(self) -> str:
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        return (f"CREATE TABLE IF NOT EXISTS {self.table} ({cols}) USING parquet PARTITIONED BY ({self.part}) "
                f"CLUSTERED BY ({self.key}) SORTED BY (day) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")


def bucketed(table: str, path: str, columns: T.StructType, buckets: int = 200) -> Buckets:
    """The layout of a table with these columns, among them `symbol` and `day`; a column `year` is added."""
    return Buckets(table, path, T.StructType([*[f for f in columns.fields if f.name != "year"], T.StructField("year", T.DateType())]), buckets)


def with_year(rows: DataFrame) -> DataFrame:
    return rows.withColumn("year", F.trunc("day", "year"))


def ensure(spark: SparkSession, layout: Buckets) -> None:
    """The catalog knows the table, and just the partitions that its folder has by now."""
    spark.sql(layout.ddl())
    if exists(spark, layout.path):
        spark.sql(f"MSCK REPAIR TABLE {layout.table} SYNC PARTITIONS")
    spark.catalog.refreshTable(layout.table)


def write_buckets(rows: DataFrame, layout: Buckets) -> None:
    """Replace the partitions that occur in the rows. One task writes a bucket, so it has one file in each partition."""
    spark = rows.sparkSession
    ensure(spark, layout)
    rows = conform(rows if layout.part in rows.columns else with_year(rows), layout.schema).repartition(layout.buckets, layout.key)
    rows.write.option("partitionOverwriteMode", "dynamic").insertInto(layout.table, overwrite=True)
    ensure(spark, layout)


def upsert_buckets(updates: DataFrame, layout: Buckets, keys: Sequence[str] = ("day", "symbol"), *, version: Sequence[str] = (),
                   cleared: DataFrame | None = None) -> None:
    """Keyed upsert, staged and replayed as upsert() does it; the layout stays."""
    spark = updates.sparkSession
    ensure(spark, layout)
    upsert(with_year(updates), layout.path, layout.schema, keys, version=version, part=layout.part,
           cleared=None if cleared is None else with_year(cleared), write=lambda rows: write_buckets(rows, layout))
    ensure(spark, layout)


@contextlib.contextmanager
def co_located(spark: SparkSession) -> Iterator[None]:
    """Queries that are planned in here may join by more columns than the tables are bucketed by without a shuffle.

    Bucketed by symbol, two tables meet on (symbol, day) where they lie. Not for other queries: a join on a column of few
    values and another one would then also stay on the first.
    """
    before = spark.conf.get(CO_PARTITION)
    spark.conf.set(CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITION, before)
