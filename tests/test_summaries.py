"""Summaries of partitioned tables against full scans."""

import os
import shutil

from pyspark.sql import functions as F
from pyspark.sql import types as T

from barograph.operators import observe
from barograph.sources import summaries as sm, tables as tb

SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("day", T.DateType()), T.StructField("close", T.DoubleType()),
                       T.StructField("month", T.DateType())])


def bars(spark, first, last, symbols=("A", "B", None)):
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}')) as day")
    names = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    rows = days.join(F.broadcast(names)).withColumn("close", F.dayofyear("day") + 0.5).withColumn("month", F.trunc("day", "month"))
    return rows.select(*SCHEMA.fieldNames())


def assert_equals_scan(spark, path):
    summary = sm.read_summary(spark, path, SCHEMA["month"])
    table = spark.read.schema(SCHEMA).parquet(path)
    now = spark.sql("select timestamp_ntz'2024-06-01 00:00:00' as now")
    wanted = spark.createDataFrame([("A",), ("B",), ("Z",)], "symbol string")
    pairs = [(sm.state_from_summary(summary, wanted), tb.table_state(table, wanted)),
             (sm.health_from_summary({"t": summary}, now), observe.table_health({"t": table}, now)),
             (sm.freshness_from_summary({"t": summary}, now), observe.symbol_freshness({"t": table}, now))]
    for ours, theirs in pairs:
        assert sorted(ours.collect(), key=str) == sorted(theirs.select(ours.columns).collect(), key=str)


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(sm.summary_path(path)) for f in fs if f.endswith(".parquet")}


def test_summary_follows_appends_upserts_and_removals(spark, tmp_path):
    path = f"{tmp_path}/bars"
    fresh = lambda: sm.refresh(spark, path, SCHEMA, "month")
    assert fresh() == []  # no table yet
    tb.append(bars(spark, "2024-01-03", "2024-04-10"), path, ("month",))
    assert fresh() == [f"month=2024-0{k}-01" for k in (1, 2, 3, 4)]
    assert_equals_scan(spark, path)
    assert fresh() == []
    before = files(path)
    tb.append(bars(spark, "2024-04-11", "2024-05-02", ("A", "C")), path, ("month",))
    assert fresh() == ["month=2024-04-01", "month=2024-05-01"]
    assert {f for f in before if "-04-01" not in f} <= files(path)
    assert_equals_scan(spark, path)
    tb.upsert(bars(spark, "2024-02-01", "2024-02-03", ("A", "D")), path, SCHEMA, ["day", "symbol"], part="month")
    assert fresh() == ["month=2024-02-01"]
    assert_equals_scan(spark, path)
    shutil.rmtree(f"{path}/month=2024-03-01")
    assert fresh() == []
    assert not any("2024-03-01" in f for f in files(path))
    assert_equals_scan(spark, path)


def test_partition_without_rows_leaves_the_summary(spark, tmp_path):
    path = f"{tmp_path}/bars"
    tb.append(bars(spark, "2024-01-30", "2024-02-02"), path, ("month",))
    sm.refresh(spark, path, SCHEMA, "month")
    shutil.rmtree(f"{path}/month=2024-01-01")
    bars(spark, "2024-01-30", "2024-01-31").limit(0).drop("month").coalesce(1).write.parquet(f"{path}/month=2024-01-01")
    assert sm.refresh(spark, path, SCHEMA, "month") == ["month=2024-01-01"]
    assert_equals_scan(spark, path)
    assert all("2024-02-01" in f for f in files(path))


def test_only_touched_partitions_are_read(spark, tmp_path):
    path = f"{tmp_path}/bars"
    tb.append(bars(spark, "2024-01-01", "2024-03-31"), path, ("month",))
    rows = sm.partition_rows(spark, path, SCHEMA, ["month=2024-02-01"])
    assert rows.inputFiles() and all("month=2024-02-01" in f for f in rows.inputFiles())
    assert rows.select("month").distinct().count() == 1
    listed = sm.file_stamps(spark, path, "month")
    assert "content" not in listed._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_interrupted_refresh_is_made_good(spark, tmp_path):
    """A summary written before the table changed once more has an old stamp."""
    path = f"{tmp_path}/bars"
    tb.append(bars(spark, "2024-01-01", "2024-02-10"), path, ("month",))
    sm.refresh(spark, path, SCHEMA, "month")
    old = {r.folder: r.stamp for r in sm.file_stamps(spark, path, "month").collect()}
    tb.append(bars(spark, "2024-02-11", "2024-02-12"), path, ("month",))
    new = {r.folder: r.stamp for r in sm.file_stamps(spark, path, "month").collect()}
    assert old["month=2024-01-01"] == new["month=2024-01-01"] and old["month=2024-02-01"] != new["month=2024-02-01"]
    assert sm.refresh(spark, path, SCHEMA, "month") == ["month=2024-02-01"]
    assert_equals_scan(spark, path)
