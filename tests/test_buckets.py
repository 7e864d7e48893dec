"""Tables bucketed by symbol: layout, plans without exchanges, upserts."""

import glob
import re
import uuid

import pytest
from pyspark.sql import Window, functions as F

from barograph.sources import buckets as bk


def daily(spark, first, last, value):
    days = spark.sql(f"select explode(sequence(date'{first}', date'{last}')) as day")
    symbols = spark.range(12).select(F.concat(F.lit("S"), "id").alias("symbol"))
    return days.join(F.broadcast(symbols)).withColumn(value, F.dayofyear("day") + F.length("symbol") / 10)


def layout(spark, tmp_path, name, rows, buckets=4):
    return bk.bucketed(f"{name}_{uuid.uuid4().hex}", f"{tmp_path}/{name}", rows.schema, buckets)


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    df.collect()
    return re.findall(r"\b\w*Exchange\b", df._jdf.queryExecution().executedPlan().toString())


def files_of(path):
    return sorted(glob.glob(f"{path}/year=*/*.parquet"))


def test_joins_and_windows_without_exchange_also_after_an_upsert(spark, tmp_path, no_broadcast):
    features, labels = daily(spark, "2022-11-01", "2024-02-10", "f"), daily(spark, "2022-11-01", "2024-01-31", "y")
    left, right = (layout(spark, tmp_path, n, r) for n, r in (("features", features), ("labels", labels)))
    bk.write_buckets(features, left)
    bk.write_buckets(labels, right)
    assert len(files_of(left.path)) <= 3 * 4

    def joined():
        return spark.table(left.table).join(spark.table(right.table).drop("year"), ["symbol", "day"])

    def window():
        by = Window.partitionBy("symbol").orderBy("day")
        return spark.table(left.table).withColumn("before", F.lag("f").over(by)).groupBy("symbol").agg(F.sum("before").alias("s"))

    def check(f, y):
        with bk.co_located(spark):
            assert exchanges(joined()) == [] and exchanges(window()) == []
        got = sorted((r.symbol, r.day, r.f, r.y) for r in joined().collect())
        assert got == sorted((r.symbol, r.day, r.f, r.y) for r in f.join(y, ["symbol", "day"]).collect())

    check(features, labels)
    assert exchanges(joined()) != []  # outside, the session plans as ever
    changed = daily(spark, "2024-02-05", "2024-02-20", "f").withColumn("f", F.col("f") + 1)
    before = [f for f in files_of(left.path) if "year=2024" not in f]
    bk.upsert_buckets(changed, left)
    assert [f for f in files_of(left.path) if "year=2024" not in f] == before
    check(features.where("day < date'2024-02-05'").unionByName(changed), labels)


def test_cleared_partition_leaves_the_table(spark, tmp_path):
    rows = daily(spark, "2023-12-30", "2024-01-02", "f")
    own = layout(spark, tmp_path, "bars", rows)
    bk.write_buckets(rows, own)
    gone = rows.where("day < date'2024-01-01'").select("day", "symbol")
    bk.upsert_buckets(rows.where("day = date'2024-01-02'").withColumn("f", F.lit(0.5)), own, cleared=gone)
    table = spark.table(own.table)
    assert {str(r.day) for r in table.select("day").distinct().collect()} == {"2024-01-01", "2024-01-02"}
    assert {r.f for r in table.where("day = date'2024-01-02'").collect()} == {0.5}
    assert table.count() == 24


def test_table_is_found_again_in_another_catalog(spark, tmp_path):
    rows = daily(spark, "2023-12-30", "2024-01-02", "f").limit(0)
    own = layout(spark, tmp_path, "bars", rows)
    bk.write_buckets(rows, own)
    assert spark.table(own.table).count() == 0
    bk.write_buckets(daily(spark, "2023-12-30", "2024-01-02", "f"), own)
    again = bk.Buckets(own.table + "_2", own.path, own.schema, own.buckets)
    bk.ensure(spark, again)
    assert spark.table(again.table).count() == 48
