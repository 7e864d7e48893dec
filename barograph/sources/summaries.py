"""Summary rows beside partitioned tables: reports merge them instead of scanning the tables.

The summary of the table at `path` lies at `<path>_summary`, partitioned alike: one row per partition and symbol with the
number of rows, the newest time and the distinct days. These merge: numbers add up, times take the maximum, days unite.
Every row carries the stamp of its partition's files (names, lengths and times, from a listing; no file is opened for it).

refresh() reads only partitions whose stamp has changed, by appends, upserts or rewrites alike, and drops the rows of
partitions that are gone. Stamps are listed before rows are read, so a write that comes between makes the partition stale
once more; a refresh that breaks off leaves partitions with their old stamps, which the next one refreshes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from barograph.operators.observe import _lag_minutes
from barograph.sources.tables import exists, table_state, write_partitions

SUMMARY = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("rows", T.LongType()),
                        T.StructField("last_time", T.TimestampNTZType()), T.StructField("days", T.ArrayType(T.DateType())),
                        T.StructField("stamp", T.StringType())])


def summary_path(path: str) -> str:
    return f"{path.rstrip('/')}_summary"


def file_stamps(spark: SparkSession, path: str, part: str = "day") -> DataFrame:
    """(folder, stamp) of every partition that has files."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
             .select("path", "length", F.unix_micros("modificationTime").alias("at")))
    folder = F.regexp_extract("path", f"/({part}=[^/]+)/([^/]+)$", 1)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    files = files.select(folder.alias("folder"), F.concat_ws("|", name, "length", "at").alias("file")).where("folder != ''")
    return files.groupBy("folder").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("file")), ","), 256).alias("stamp"))


def read_summary(spark: SparkSession, path: str, part: T.StructField = T.StructField("day", T.DateType())) -> DataFrame:
    schema = T.StructType([*SUMMARY.fields, part])
    where = summary_path(path)
    return spark.read.schema(schema).parquet(where) if exists(spark, where) else spark.createDataFrame([], schema)


def partition_rows(spark: SparkSession, path: str, schema: T.StructType, folders: Sequence[str]) -> DataFrame:
    """The rows of some partitions of a table; no other folder is listed or read."""
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path.rstrip('/')}/{f}" for f in folders])


def summarised(rows: DataFrame, part: str, day: str = "day", time: str | None = None, symbol: str = "symbol") -> DataFrame:
    """One row per partition and symbol. Rows combine before the shuffle; the days of a partition are a bounded calendar."""
    newest = F.max(F.col(time or day).cast("timestamp_ntz"))
    days = F.array_sort(F.collect_set(F.to_date(day)))
    return rows.groupBy(F.col(part).alias("_part"), F.col(symbol).cast("string").alias("symbol")).agg(
        F.count(F.lit(1)).alias("rows"), newest.alias("last_time"), days.alias("days")).withColumnRenamed("_part", part)


def _stamped_folders(summary: DataFrame, part: str) -> dict[str, str]:
    """Folder to stamp; as long as the table has partitions, which the driver lists to plan any scan."""
    rows = summary.select(_folder(part).alias("folder"), "stamp").distinct().collect()
    return {r.folder: r.stamp for r in rows}


def _folder(part: str) -> F.Column:
    return F.concat(F.lit(f"{part}="), F.coalesce(F.col(part).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))


def refresh(spark: SparkSession, path: str, schema: T.StructType, part: str = "day", *, day: str = "day",
            time: str | None = None, symbol: str = "symbol") -> list[str]:
    """Bring the summary up to date; returns the folders that were read. Partition values are dates or plain words.

    An empty table gives an empty summary; null symbols are summarised like any other.
    """
    field, where = schema[part], summary_path(path)
    now = {r.folder: r.stamp for r in file_stamps(spark, path, part).collect()} if exists(spark, path) else {}
    known = _stamped_folders(read_summary(spark, path, field), part)
    touched = sorted(f for f, stamp in now.items() if known.get(f) != stamp)
    if touched:
        stamps = spark.createDataFrame([(f, now[f]) for f in touched], "folder string, stamp string")  # one row per partition
        rows = summarised(partition_rows(spark, path, schema, touched), part, day, time, symbol)
        rows = rows.withColumn("folder", _folder(part)).join(F.broadcast(stamps), "folder").drop("folder")
        write_partitions(rows.select(*SUMMARY.fieldNames(), part), where, (part,))
    if touched or set(known) - set(now):
        # What has another stamp by now belongs to partitions that are gone or have lost all rows.
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        for folder, stamp in _stamped_folders(read_summary(spark, path, field), part).items():
            if now.get(folder) != stamp:
                gone = fs_path(f"{where}/{folder}")
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return touched


def state_from_summary(summary: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct days and newest day per wanted symbol, as table_state() finds them by a scan."""
    return table_state(summary.select("symbol", F.explode("days").alias("day")), symbols)


def health_from_summary(summaries: Mapping[str, DataFrame], now: DataFrame) -> DataFrame:
    """One row per table, as table_health() finds it by a scan."""
    out = None
    for name, summary in summaries.items():
        one = summary.agg(F.max("last_time").alias("latest_time"), F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"))
        one = one.select(F.lit(name).alias("table_name"), "latest_time", "row_count")
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(now)).select(  # one row
        "table_name", "latest_time", "row_count", _lag_minutes(F.col("now"), F.col("latest_time")).alias("lag_minutes"),
        F.when(F.col("latest_time").isNull(), "error").otherwise("ok").alias("status"))


def freshness_from_summary(summaries: Mapping[str, DataFrame], now: DataFrame) -> DataFrame:
    """Newest time per table and symbol, as symbol_freshness() finds it by a scan."""
    out = None
    for name, summary in summaries.items():
        one = summary.groupBy("symbol").agg(F.max("last_time").alias("latest_time"))
        one = one.select(F.lit(name).alias("table_name"), "symbol", "latest_time")
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(now)).select(  # one row
        "table_name", "symbol", "latest_time", _lag_minutes(F.col("now"), F.col("latest_time")).alias("lag_minutes"))
