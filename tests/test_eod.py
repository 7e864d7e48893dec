"""The end-of-day job over the given tables: running it twice gives equal tables."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barograph.eod import EndOfDay, run_end_of_day
from barograph.operators import news as nw
from barograph.plans.context import _aliases
from barograph.schemas import TABLES
from barograph.sources import standins as st, tables as tb

WRITTEN = ("eod.prices", "eod.curated", "ml.features", "ml.predictions", "ml.sentiment", "ml.valuation")


def _landed(spark, days):
    """Vendor rows of so many days."""
    begin = date(2023, 1, 1)
    rows = [(begin + timedelta(days=i), s, p, p + 2.0, p - 2.0, p + (i * 5 + k) % 3 - 1.0, p, 1000.0 + i % 17, 0.0, 0.0)
            for i in range(days) for k, s in enumerate(("AAA", "SPY")) for p in [100.0 + (i * 7 + k) % 11 + i / 50]]
    return spark.createDataFrame(rows, "Datetime date, Symbol string, Open double, High double, Low double, Close double, "
                                       "`Adj Close` double, Volume double, Dividends double, `Stock Splits` double")


def _items(spark, sf):
    n = st.news(spark, sf).select("symbol", "id", "headline", "polarity", "url", F.col("day").cast("timestamp").alias("published_at"))
    return nw.merge_sources([("yfinance", n), ("finnhub", n)])


def _plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def test_running_the_last_days_again_changes_nothing(spark, tmp_path):
    sf, base = "/root/testdata/sf0.01", str(tmp_path)
    landed, seen = _landed(spark, 262), []
    last = landed.agg(F.max("Datetime")).first()[0]
    landed = landed.withColumn("Close", F.when((F.col("Symbol") == "AAA") & (F.col("Datetime") == F.date_sub(F.lit(last), 100)), -1.0).otherwise(F.col("Close")))
    for k, rows in enumerate((landed, landed.where(F.col("Datetime") > F.date_sub(F.lit(last), 5)))):
        job = EndOfDay(base, f"run{k}", last.isoformat(), "2024-03-01 00:00:00", min_days=100)
        names = _aliases(spark, sf).withColumnRenamed("alias", "name")
        manifest = run_end_of_day(spark, job, rows, st.scored, _items(spark, sf), st.fundamentals(spark, sf).limit(200), names)
        assert [(r.stage, r.rows > 0) for r in manifest.collect()] == [(name, True) for name in WRITTEN]
        # Measured in the write, and the same as another pass over what was written gives.
        for r in manifest.collect():
            again = tb.run_manifest(spark.read.parquet(f"{base}/runs/run{k}/{r.stage}"), r.run_id, r.stage, TABLES[r.stage][1][0]).first()
            assert r.asDict() | {"columns": sorted(r.columns), "rejected": None} == again.asDict() | {"columns": sorted(again.columns), "rejected": None}
        assert {r.stage: r.rejected for r in manifest.collect()}["eod.curated"] == (1 if k == 0 else 0)
        seen.append({name: sorted(repr(_plain(tuple(r))) for r in tb.read_table(spark, base, name).collect()) for name in WRITTEN})
    assert seen[0] == seen[1]
    assert {len(r.feature_vector) for r in tb.read_table(spark, base, "ml.features").collect()} == {47}


def test_short_history_stops_the_run(spark, tmp_path):
    job = EndOfDay(str(tmp_path), "run", "2023-01-09", "2024-03-01 00:00:00", min_days=10**6)
    with pytest.raises(ValueError):
        run_end_of_day(spark, job, _landed(spark, 9), st.scored)
    assert "ml.predictions" in TABLES and not tb.exists(spark, f"{tmp_path}/ml/predictions")


@pytest.fixture
def plain_features(monkeypatch):
    """Constant features: what is tested here doesn't depend on them."""
    from barograph import eod
    from barograph.schemas import FEATURE_COLUMNS

    monkeypatch.setattr(eod.df_, "price_features", lambda bars, market: bars.select(
        "day", "symbol", "close", *[F.lit(0.5).alias(c) for c in FEATURE_COLUMNS], F.lit(0.1).alias("maxdd90")))


def test_stories_that_do_not_name_their_symbol_are_left_out(spark, tmp_path, plain_features):
    """Also before the fallback of a symbol without fresh stories."""
    as_of = "2023-09-18"
    rows = [("AAA", 1, "Alpha Works Inc. opens a plant", None, 1.0, "2023-09-17"), ("AAA", 2, "Shares of aaa, at last", None, 0.5, "2023-09-16"),
            ("AAA", 3, "Markets fall", None, -1.0, "2023-09-17"), ("AAA", 4, "Markets fall again", "says Alpha Works", 0.0, "2023-09-15"),
            ("AAA", 5, "", "", -1.0, "2023-09-15"), ("OLD", 6, "OLD news", None, 0.25, "2022-01-01"), ("OLD", 7, "Weather", None, -1.0, "2022-01-02"),
            ("GONE", 8, "Nothing to the point", None, 1.0, "2023-09-17")]
    items = spark.createDataFrame([(s, i, h, m, p, f"u/{i}", d) for s, i, h, m, p, d in rows], "symbol string, id long, headline string, "
                                  "summary string, polarity double, url string, day string").withColumn("published_at", F.to_timestamp("day")).drop("day")
    names = spark.createDataFrame([("AAA", "Alpha Works Inc.")], "symbol string, name string")
    job = EndOfDay(str(tmp_path), "run", as_of, "2024-03-01 00:00:00", min_days=100)
    run_end_of_day(spark, job, _landed(spark, 262), st.scored, nw.merge_sources([("finnhub", items)]), names=names)
    got = {r.symbol: (r.article_count, r.sentiment_score) for r in tb.read_table(spark, str(tmp_path), "ml.sentiment").collect()}
    assert got == {"AAA": (3, 0.5), "OLD": (1, 0.25)}


def test_scores_outside_the_contract_reach_no_table(spark, tmp_path, plain_features):
    job = EndOfDay(str(tmp_path), "run", "2023-09-19", "2024-03-01 00:00:00", min_days=100)
    with pytest.raises(ValueError, match="contract"):
        run_end_of_day(spark, job, _landed(spark, 262), lambda rows: st.scored(rows).withColumn("risk_prob", F.lit(1.5)))
    assert not tb.exists(spark, f"{tmp_path}/ml/predictions")
