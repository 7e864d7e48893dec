"""Dead letters and progress: every landed message is a row or a dead letter, and a stopped query has a lag."""

import json
from datetime import datetime

import pytest

from barograph.operators.observe import offset_report
from barograph.schemas import MARKET_JSON, NEWS_JSON, RAW_STREAM
from barograph.sources import decode as dc, tables as tb
from barograph.streaming import jobs, progress as pr
from barograph.streaming.lifecycle import StreamSource, run_together

GOOD = {"Datetime": "2024-01-02 10:00:00", "Open": 1.0, "High": 2.0, "Low": 0.5, "Close": 1.5, "Volume": 7, "Dividends": 0.0,
        "Stock Splits": 0.0, "Symbol": "AAA"}


def _market(spark):
    texts = [json.dumps(GOOD), json.dumps(GOOD | {"Venue": "X", "Open": 1}), "not json", "", None, json.dumps(GOOD | {"Open": "much"}),
             json.dumps(GOOD | {"Volume": 1.5}), json.dumps({k: v for k, v in GOOD.items() if k != "Datetime"}), json.dumps(GOOD | {"Datetime": "soon"}),
             "{}", '{"Datetime": "2024-01-02 10:00:00", "Close": {"deep": 1}}', json.dumps(GOOD | {"Close": None})]
    return spark.createDataFrame([(t, "stock_market", 0, k) for k, t in enumerate(texts)], RAW_STREAM)


def test_market_messages_are_rows_or_dead_letters(spark):
    raw = _market(spark)
    rows = dc.market_messages(raw, faults=True)
    letters = {r.offset: (r.fault, r.field) for r in dc.dead_letters(rows, MARKET_JSON, "Datetime").collect()}
    assert letters == {2: ("malformed", None), 3: ("empty", None), 4: ("empty", None), 5: ("malformed", "Open"), 6: ("malformed", "Volume"),
                       7: ("no time", "Datetime"), 8: ("no time", "Datetime"), 9: ("no time", "Datetime"), 10: ("malformed", "Close")}
    assert sorted(r.offset for r in rows.where("fault is null").collect()) == [0, 1, 11]
    good = rows.where("fault is null").drop("fault", "payload", "etl_load")
    plain = dc.known_time(dc.market_messages(raw)).join(good.select("offset"), "offset", "left_semi").drop("etl_load")
    assert sorted(map(str, good.collect())) == sorted(map(str, plain.select(good.columns).collect()))
    assert rows._jdf.queryExecution().executedPlan().toString().count("from_json") == 1
    extra = dc.unknown_fields(raw, MARKET_JSON).selectExpr("offset", "field", "cast(found as string) as found").collect()
    assert [tuple(r) for r in extra] == [(1, "Venue", "X")]


def test_news_messages_are_rows_or_dead_letters(spark):
    one = {"id": 1, "datetime": 1704067200, "headline": "a", "related": "AAA", "url": "u"}
    texts = [json.dumps(one), json.dumps([one, one]), "[]", "nothing", json.dumps({k: v for k, v in one.items() if k != "datetime"}), ""]
    rows = dc.news_messages(spark.createDataFrame([(t, "news", 1, k) for k, t in enumerate(texts)], RAW_STREAM), faults=True)
    assert sorted(r.offset for r in rows.where("fault is null").collect()) == [0, 1, 1]
    letters = {r.offset: (r.fault, r.field) for r in dc.dead_letters(rows, NEWS_JSON, "datetime").collect()}
    assert letters.keys() == {2, 3, 4, 5}
    assert letters[4] == ("no time", "datetime") and letters[5] == ("empty", None) and {letters[2][0], letters[3][0]} <= {"no items", "malformed", "no time"}


def test_landing_with_quarantine_and_lag(spark, tmp_path):
    base = str(tmp_path)
    source = StreamSource("parquet", "stock_market", f"{base}/topic")
    _market(spark).coalesce(1).write.parquet(source.path)
    log = pr.ProgressLog()
    spark.streams.addListener(log)
    try:
        run_together(spark, [jobs.land(spark, source, "market", base, quarantine=True)])
        stored = tb.read_table(spark, base, "bronze.market")
        letters = spark.read.parquet(f"{base}/bronze/dead_letters/market")
        assert sorted([r.offset for r in stored.collect()] + [r.offset for r in letters.collect()]) == list(range(12))
        assert letters.where("offset = 10").selectExpr("variant_get(document, '$.Close.deep', 'int') as x").first().x == 1
        # The query has stopped; the source goes on.
        spark.createDataFrame([(json.dumps(GOOD), "stock_market", p, o) for p, o in ((0, 12), (0, 13), (3, 0))], RAW_STREAM).coalesce(
            1).write.mode("append").parquet(source.path)
        report = lambda: {r.partition: (r.last_offset, r.latest_offset, r.lag) for r in pr.with_lag(offset_report(
            tb.read_table(spark, base, "bronze.market").select("topic", "partition", "offset")), pr.source_offsets(spark, source)).collect()}
        assert report() == {0: (11, 13, 2), 3: (None, 0, 1)}
        run_together(spark, [jobs.land(spark, source, "market", base, quarantine=True)])
        assert report() == {0: (13, 13, 0), 3: (0, 0, 0)}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        assert log.flush(spark, base) > 0 and log.flush(spark, base) == 0
    finally:
        spark.streams.removeListener(log)
    kept = tb.read_table(spark, base, "ops.progress")
    assert sum(r.input_rows for r in kept.collect()) == 15
    assert [r.rows for r in pr.throughput(kept).collect()] == [15]
    name = kept.first()["query"]
    assert [r["query"] for r in pr.stalled(kept, [name, "never"], "2000-01-01 00:00:00", 5).collect()] == ["never"]


def test_newest_offsets_of_a_topic_source(spark):
    """As a broker's source reports them: the offset after the last message of each partition."""
    report = {"id": "q", "runId": "r", "name": "land", "batchId": 3, "timestamp": "2024-01-01T10:00:00.000Z", "sources": [
        {"description": "topic", "startOffset": {"t": {"0": 5}}, "endOffset": {"t": {"0": 9, "1": 2}}, "latestOffset": {"t": {"0": 12, "1": 2}},
         "numInputRows": 6, "processedRowsPerSecond": 2.0}]}
    older = report | {"batchId": 2, "timestamp": "2024-01-01T09:00:00.000Z", "sources": [report["sources"][0] | {"latestOffset": {"t": {"0": 99}}}]}
    from barograph.schemas import PROGRESS

    table = spark.createDataFrame(pr.progress_rows(older) + pr.progress_rows(report), PROGRESS)
    assert {(r.topic, r.partition, r.latest_offset) for r in pr.newest_offsets(table).collect()} == {("t", 0, 11), ("t", 1, 1)}
    stored = spark.createDataFrame([("t", 0, k) for k in range(9)] + [("t", 1, 0), ("t", 1, 1)], "topic string, partition int, offset long")
    got = {r.partition: r.lag for r in pr.with_lag(offset_report(stored), pr.newest_offsets(table)).collect()}
    assert got == {0: 3, 1: 0}
    assert table.where("ts = timestamp'2024-01-01 10:00:00'").count() == 1
    assert isinstance(table.first().ts, datetime)
