"""Registered queries: bars and calendars, daily features, intraday indicators, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.functions import dates
from barograph.operators import alerts as al, bars, daily_features as df_, intraday
from barograph.plans.common import features, rounded
from barograph.schemas import FEATURE_COLUMNS
from barograph.sources import standins as st


def latest_tick_version(spark, sf):
    rows = st.ticks(spark, sf).select("symbol", F.date_trunc("minute", "ts").alias("minute"), "ts", "price", "event_id")
    return bars.latest_version(rows, ["symbol", "minute"], ["ts", "event_id"])


def daily_bars(spark, sf):
    return rounded(st.eod(spark, sf))


def quarter_hour_bars(spark, sf):
    t = st.ticks(spark, sf)
    return bars.resample(t.select("symbol", "ts", *[F.col("price").alias(c) for c in bars.PRICES], "volume"),
                         "15 minutes")


def indicator_daily_close(spark, sf):
    t = st.ticks(spark, sf)
    return bars.daily_close(t.where("symbol = 'click'").select("ts", F.col("price").alias("close")))


def benchmark_alignment(spark, sf):
    """One brand stands for the benchmark; it does not trade every day, so values are carried forward."""
    eod = st.eod(spark, sf)
    bench = eod.where("symbol = 'Brand#1'").select("day", "close")
    return rounded(bars.align_benchmark(eod, bench).select("symbol", "day", "close", "bench"), bench=None)


def rebalance_calendar(spark, sf):
    return bars.rebalance_days(st.eod(spark, sf), 260, 20)


def prices_as_of_rebalance(spark, sf):
    eod = st.eod(spark, sf)
    return rounded(bars.as_of(eod, bars.rebalance_days(eod, 260, 20), "rebalance_day", ["close"]))


def forward_returns(spark, sf):
    return rounded(bars.forward_close(st.eod(spark, sf), (5, 10, 20))
                   .select("symbol", "day", "close", "close_5d", "close_10d", "close_20d", "ret_5d", "ret_10d", "ret_20d"),
                   close_5d=None, close_10d=None, close_20d=None)


def session_calendar(spark, sf):
    """Trading volume of every shipping day with the session state of the date."""
    days = st.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.count(F.lit(1)).alias("trades"))
    return days.selectExpr("day", "trades", f"{dates.is_session('day')} as is_session",
                           f"{dates.latest_session('day')} as latest_session")


def latest_completed_session(spark, sf):
    hours = st.ticks(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("ticks"))
    return (hours.selectExpr("ts", "ticks", f"{dates.completed_candidate('ts')} as _c")
            .selectExpr("ts", "ticks", f"{dates.latest_session('_c')} as session_day"))


def wide_to_long(spark, sf):
    """Wide daily frame with one column group per return flag, back to long rows."""
    t = st.table(spark, sf, "lineitem").selectExpr("to_date(l_shipdate) as day", "l_returnflag as f",
                                                   "l_extendedprice / l_quantity as p", "l_quantity as q")
    flags = ("A", "N", "R")
    aggs = []
    for f in flags:
        price, vol = F.when(F.col("f") == f, F.col("p")), F.when(F.col("f") == f, F.col("q"))
        aggs += [F.max(price).alias(f"{f}_high"), F.min(price).alias(f"{f}_low"), F.sum(vol).alias(f"{f}_volume")]
    return rounded(bars.unpivot_tickers(t.groupBy("day").agg(*aggs), "day", flags, ("high", "low", "volume")))


def daily_features(spark, sf):
    return rounded(features(spark, sf), 6, EMA20_slope=4, EMA50_slope=4, MACD_hist=4, OBV_slope=4)


def complete_feature_vectors(spark, sf):
    """Complete rows with the vector in contract order, one column for each of its places."""
    rows = df_.with_vector(df_.check_contract(features(spark, sf, complete=True)), "v1", 7, "2024-01-01 00:00:00")
    vec = F.col("feature_vector")
    return rows.select("day", "symbol", F.size(vec).alias("width"), *[F.round(vec[k], 4).alias(f"v{k}") for k in range(len(FEATURE_COLUMNS))],
                       "feature_version", "source_batch_id", "process_date")


def features_of_touched_days(spark, sf):
    """Only the (day, symbol) pairs of the newest month of ticks; the rest is history."""
    t = st.trades(spark, sf)
    newest = t.agg(F.date_trunc("month", F.max("ts")).alias("_m"))
    touched = t.select("symbol", "ts").join(newest, F.col("ts") >= F.col("_m")).drop("_m")
    return rounded(df_.touched_only(features(spark, sf), touched).select("day", "symbol", "r1", "CLV", "MFI14", "vol20"))


def features_on_target_day(spark, sf):
    """A target past the last bar falls back to the latest day with features."""
    return rounded(df_.on_target_day(features(spark, sf), "2035-01-01").select("day", "symbol", "r1", "r20", "BB_pctB"))


def intraday_indicators(spark, sf):
    return rounded(intraday.indicators(st.hour_bars(spark, sf)), 5)


def intraday_alerts(spark, sf):
    found = al.alerts(intraday.indicators(st.hour_bars(spark, sf)), batch_id=3)
    doc = lambda k: F.round(F.get_json_object("metadata", f"$.{k}").cast("double"), 4)
    return found.select("symbol", "event_time", "alert_type", "alert_level", "feature_name",
                        F.round("feature_value", 4).alias("feature_value"),
                        F.round("threshold_value", 4).alias("threshold_value"), "message", "source_batch_id",
                        doc("Close").alias("meta_close"), doc("rsi14").alias("meta_rsi14"),
                        F.get_json_object("metadata", "$.timeframe").alias("timeframe"))


def alert_counts(spark, sf):
    return al.alerts(intraday.indicators(st.hour_bars(spark, sf))).groupBy("symbol", "alert_type", "alert_level").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))


QUERIES = {f.__name__: f for f in (
    latest_tick_version, daily_bars, quarter_hour_bars, indicator_daily_close, benchmark_alignment, rebalance_calendar,
    prices_as_of_rebalance, forward_returns, session_calendar, latest_completed_session, wide_to_long, daily_features,
    complete_feature_vectors, features_of_touched_days, features_on_target_day, intraday_indicators, intraday_alerts,
    alert_counts)}
