"""The streaming jobs over files give the batch result, and a repeated batch changes nothing."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barograph.operators import alerts as al, intraday
from barograph.schemas import RAW_STREAM
from barograph.sources import tables as tb
from barograph.streaming import jobs
from barograph.streaming.lifecycle import StreamSource, run_together


def _messages(n, start=0, symbols=("AAA", "BBB")):
    rows, begin = [], datetime(2024, 1, 2)
    for i in range(start, start + n):
        for k, s in enumerate(symbols):
            p = 100 + 10 * ((i * 7 + k * 3) % 13) + (40 if i % 29 == 0 else 0)
            doc = {"Datetime": (begin + timedelta(minutes=i)).strftime("%Y-%m-%d %H:%M:%S"), "Open": p, "High": p + 2.0, "Low": p - 2.0,
                   "Close": float(p), "Volume": 10 + (900 if i % 31 == 0 else i % 5), "Dividends": 0.0, "Stock Splits": 0.0, "Symbol": s}
            rows.append((json.dumps(doc), "stock_market", k, i))
    rows.append(("{}", "stock_market", 9, start))
    return rows


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("lake"))
    source = StreamSource("parquet", "stock_market", f"{base}/topic")
    for start, n in ((0, 90), (90, 60)):
        spark.createDataFrame(_messages(n, start), RAW_STREAM).coalesce(1).write.mode("append").parquet(source.path)
        run_together(spark, [jobs.land(spark, source, "market", base)])
        run_together(spark, [jobs.clean(spark, "market", base, every=None, repeats_within=None)])
        run_together(spark, [jobs.raise_alerts(spark, base)])
    return base


def test_bronze_and_silver(spark, lake):
    assert tb.read_table(spark, lake, "bronze.market").count() == 300
    silver = tb.read_table(spark, lake, "silver.market")
    assert silver.count() == 300 and silver.where("daily_range = 4").count() == 300


def test_stream_equals_batch(spark, lake):
    silver = tb.read_table(spark, lake, "silver.market").select("symbol", "ts", "open", "high", "low", "close", "volume")
    want = {tuple(r) for r in al.alerts(intraday.indicators(silver)).select("symbol", "event_time", "alert_type").collect()}
    stored = tb.read_table(spark, lake, "alert.market")
    got = [tuple(r) for r in stored.select("symbol", "event_time", "alert_type").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_repeated_batch_changes_nothing(spark, lake):
    before = tb.read_table(spark, lake, "alert.market").count()
    jobs.alert_batch(lake)(tb.read_table(spark, lake, "silver.market"), 99)
    assert tb.read_table(spark, lake, "alert.market").count() == before


def test_news_object_and_array(spark):
    from barograph.sources.decode import news_messages

    one = json.dumps({"id": 1, "datetime": 1704067200, "headline": "a", "related": "AAA", "url": "u"})
    rows = spark.createDataFrame([(one, "t", 0, 0), (f"[{one},{one}]", "t", 0, 1)], RAW_STREAM)
    out = news_messages(rows).collect()
    assert len(out) == 3 and {r.symbol for r in out} == {"AAA"} and all(r.ts is not None for r in out)


def test_feature_batch_writes_only_touched_days(spark, tmp_path):
    base = str(tmp_path)
    begin = datetime(2023, 1, 1)
    rows = [(begin + timedelta(days=i), s, 100.0 + (i * 7) % 11 + k, 103.0 + (i * 7) % 11 + k, 97.0 + (i * 5) % 7 + k,
             100.5 + (i * 7) % 11 + k * (i % 3), 1000 + i % 17, 0.0, 0.0, 6.0, 0.5, begin, begin)
            for i in range(300) for k, s in enumerate(("AAA", "SPY"))]
    silver = tb.with_day(spark.createDataFrame(rows, tb.TABLES["silver.market"][0]))
    tb.append(silver, f"{base}/silver/market")
    newest = silver.where(F.col("ts") >= F.lit(begin + timedelta(days=298)))
    for batch in (1, 2):
        jobs.feature_batch(base)(newest, batch)
    out = tb.read_table(spark, base, "ml.features")
    assert out.count() == 2 and {r.symbol for r in out.collect()} == {"AAA"}
    assert all(len(r.feature_vector) == 47 for r in out.collect())


def test_lake_sink_is_idempotent(spark, tmp_path):
    from barograph.streaming.lifecycle import lake_sink

    rows = spark.createDataFrame([(datetime(2024, 1, 1), "AAA")], "ts timestamp, symbol string")
    write = lake_sink(str(tmp_path / "t"))
    write(rows, 0), write(rows, 0), write(rows, 1)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def _session(day, n, price):
    begin = datetime(2024, 1, day, 14, 30)
    now = datetime(2024, 2, 1)
    return [(begin + timedelta(minutes=i), s, p, p + 1.0, p - 1.0, p, 1000 + (5000 if i % 97 == 0 else i % 7), 0.0, 0.0, 2.0, 0.5, now, now)
            for i in range(n) for s in ("AAA", "BBB") for p in [price(i + day * 31 + (s == "BBB"))]]


def _alert_keys(rows):
    return {tuple(r) for r in rows.select("symbol", "event_time", "alert_type").collect()}


def test_default_alerts_over_a_weekend_and_a_corrected_tick(spark, tmp_path):
    """Thursday, Friday and the first hour of Monday; then one stored price is corrected."""
    base, schema = str(tmp_path), tb.TABLES["silver.market"][0]
    price = lambda k: 100.0 + 8 * ((k * 7) % 13) / 13 + (30 if k % 83 == 0 else 0)
    parts = [spark.createDataFrame(_session(day, n, price), schema) for day, n in ((4, 390), (5, 390), (8, 60))]
    for k, part in enumerate(parts):
        tb.append(tb.with_day(part), f"{base}/silver/market")
        jobs.alert_batch(base)(part, k)
    columns = ("symbol", "ts", "open", "high", "low", "close", "volume")
    batch = al.alerts(intraday.indicators(tb.read_table(spark, base, "silver.market").select(*columns)))
    stored = tb.read_table(spark, base, "alert.market")
    want = _alert_keys(batch)
    assert _alert_keys(stored) == want and stored.count() == len(want)
    assert any(t.day == 8 for _, t, _ in want)
    moment = max(t for s, t, _ in want if s == "AAA" and t.day == 8)
    fixed = parts[2].where((F.col("symbol") == "AAA") & (F.col("ts") == F.lit(moment))).withColumn(
        "process_date", F.lit(datetime(2024, 2, 2)))
    for c in ("open", "high", "low", "close"):
        fixed = fixed.withColumn(c, F.lit(103.0))
    tb.append(tb.with_day(fixed), f"{base}/silver/market")
    jobs.alert_batch(base)(fixed, 9)
    from barograph.operators.bars import latest_version

    silver = tb.read_table(spark, base, "silver.market").select(*columns, "process_date")
    newest = latest_version(silver, ["symbol", "ts"], ["process_date"]).drop("process_date")
    at_moment = lambda keys: {k for k in keys if k[0] == "AAA" and k[1] == moment}
    now = at_moment(_alert_keys(al.alerts(intraday.indicators(newest))))
    assert at_moment(_alert_keys(tb.read_table(spark, base, "alert.market"))) == now != at_moment(want)


def test_two_sinks_leave_silver_where_it_is(spark, tmp_path):
    from barograph.streaming.lifecycle import lake_sink

    base = str(tmp_path)
    source = StreamSource("parquet", "stock_market", f"{base}/topic")
    spark.createDataFrame(_messages(60), RAW_STREAM).write.parquet(source.path)
    run_together(spark, [jobs.land(spark, source, "market", base)])
    run_together(spark, [jobs.clean(spark, "market", base, every=None, repeats_within="10 minutes")])
    run_together(spark, [jobs.forward(spark, "market", base, [lake_sink(f"{base}/copy"), lake_sink(f"{base}/more")], "copies", every=None)])
    run_together(spark, [jobs.raise_alerts(spark, base)])
    assert {spark.read.parquet(f"{base}/{n}").count() for n in ("silver/market", "copy", "more")} == {120}
    assert tb.read_table(spark, base, "alert.market").count() > 0


def test_repeats_are_dropped_within_the_delay(spark, tmp_path):
    from barograph.streaming.lifecycle import without_repeats

    rows = [(datetime(2024, 1, 1, 10, 0), "AAA", 1.0), (datetime(2024, 1, 1, 10, 0), "AAA", 2.0), (datetime(2024, 1, 1, 10, 1), "AAA", 1.0)]
    spark.createDataFrame(rows, "ts timestamp, symbol string, x double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, symbol string, x double").parquet(f"{tmp_path}/in")
    query = (without_repeats(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_catalog_tables_show_appended_rows(spark, tmp_path):
    base, name = str(tmp_path), "silver.daily_bars"
    tb.ensure_tables(spark, base, [name])
    try:
        rows = spark.createDataFrame([(datetime(2024, 1, k).date(), "AAA", 1.0, 1.0, 1.0, 1.0, 5) for k in (1, 2)], tb.TABLES[name][0])
        tb.append(rows, f"{base}/silver/daily_bars")
        tb.refresh_tables(spark, base, [name])
        assert spark.sql("select count(*) as n from silver_daily_bars").first().n == 2
    finally:
        spark.sql("drop table if exists silver_daily_bars")


def test_upsert_survives_a_break_between_stage_and_swap(spark, tmp_path):
    path, schema = f"{tmp_path}/bars", tb.TABLES["silver.daily_bars"][0]
    make = lambda *rows: spark.createDataFrame([(datetime(2024, 1, d).date(), s, x, x, x, x, 1) for d, s, x in rows], schema)
    read = lambda: {(r.day.day, r.symbol, r.close) for r in spark.read.schema(schema).parquet(path).collect()}
    tb.upsert(make((1, "A", 1.0), (1, "B", 2.0), (2, "A", 3.0)), path, schema, ["day", "symbol"])
    tb.stage_upsert(make((1, "A", 9.0)), path, schema, ["day", "symbol"])
    assert read() == {(1, "A", 1.0), (1, "B", 2.0), (2, "A", 3.0)}
    tb.upsert(make((3, "C", 4.0)), path, schema, ["day", "symbol"])
    assert read() == {(1, "A", 9.0), (1, "B", 2.0), (2, "A", 3.0), (3, "C", 4.0)}
    tb.upsert(make(), path, schema, ["day", "symbol"], cleared=make((2, "A", 0.0)).select("day", "symbol"))
    assert read() == {(1, "A", 9.0), (1, "B", 2.0), (3, "C", 4.0)}


def test_exports_and_stages(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, n int")
    tb.export_csv(rows, f"{tmp_path}/csv"), tb.export_json(rows, f"{tmp_path}/json")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == spark.read.json(f"{tmp_path}/json").count() == 2
    assert sorted(r.n for r in tb.stage_run(rows, str(tmp_path), "run1", "bars").collect()) == [1, 2]
