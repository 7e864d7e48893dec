"""Registered queries: observability."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.operators import alerts as al, intraday, observe as ob
from barograph.operators.daily_features import price_features
from barograph.plans.common import features, last_moment, rounded
from barograph.sources import standins as st


def _tables(spark, sf):
    return {"silver.market": st.ticks(spark, sf), "silver.indicator": st.hour_bars(spark, sf).withColumnRenamed(
        "symbol", "indicator"), "alert.market": _alerts(spark, sf)}


def _alerts(spark, sf):
    return al.alerts(intraday.indicators(st.hour_bars(spark, sf)))


def table_health(spark, sf):
    return ob.table_health({**_tables(spark, sf), "silver.news": st.news(spark, sf)}, last_moment(spark, sf))


def symbol_freshness(spark, sf):
    return ob.symbol_freshness(_tables(spark, sf), last_moment(spark, sf))


def active_alerts(spark, sf):
    return ob.recent_alerts(_alerts(spark, sf), last_moment(spark, sf), 3 * 1440, levels=("HIGH",), limit=50).select(
        "symbol", "event_time", "alert_type", "alert_level")


def missing_symbol_incidents(spark, sf):
    """Unlabelled documents stand for news without a symbol, ticks of one user for blank ones."""
    labelled = st.table(spark, sf, "labels").select("doc_id", F.lit("L").alias("symbol"))
    news = st.table(spark, sf, "documents").select("doc_id", F.timestamp_seconds(F.col("n_chars")).alias("ts")).join(
        labelled, "doc_id", "left")
    ticks = st.ticks(spark, sf).withColumn("symbol", F.when(F.col("user_id") % 50 == 0, "  ").otherwise(F.col("symbol")))
    return ob.missing_symbol_incidents({"silver.news": news, "silver.market": ticks})


def feature_drift(spark, sf):
    """Features from whole history against features from bars of the years since 1998 only."""
    cols = ["r1", "vol20", "maxdd20", "MFI14"]
    bars = st.eod(spark, sf)
    short = price_features(bars.where("day >= date'1998-01-01'"), st.benchmark(spark, sf), drop_incomplete=False)
    return rounded(ob.feature_drift(short, features(spark, sf), cols))


def offset_report(spark, sf):
    """Lineage of the event stream: partition by user, offset by event; a few events are delivered twice."""
    t = st.ticks(spark, sf).select(F.lit("stock_market").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"),
                                   F.col("event_id").alias("offset"))
    again = t.where("offset % 97 = 0")
    return ob.offset_report(t.unionByName(again), block=1024)


def symbol_monitor(spark, sf):
    now = last_moment(spark, sf)
    fresh = ob.symbol_freshness({"silver.market": st.ticks(spark, sf)}, now)
    return ob.symbol_monitor(fresh, _alerts(spark, sf), now, 5 * 1440)


def request_readiness(spark, sf):
    """Customers as requests: market section from their orders, risk and portfolio sections from their account."""
    c = st.table(spark, sf, "customer")
    mode = F.when(F.col("c_nationkey") % 2 == 0, "portfolio_recommendation").otherwise("single_symbol_advisory")
    orders = st.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("request_id")).agg(
        F.count_if(F.col("o_orderstatus") == "P").alias("open_orders"), F.max("o_orderdate").alias("newest"))
    base = c.select(F.col("c_custkey").alias("request_id"), mode.alias("decision_mode"), "c_acctbal").join(orders, "request_id", "left")
    stale = F.coalesce(F.col("newest") < F.lit("2000-06-01").cast("timestamp"), F.lit(True))
    section = lambda name, status, old, missing: F.struct(
        F.lit(name).alias("section"), status.alias("status"), old.alias("is_stale"), missing.cast("bigint").alias("missing"))
    good, none = F.lit("SUCCESS"), F.lit(0)
    rows = base.select("request_id", "decision_mode", F.inline(F.array(
        section("market_features", F.when(F.col("newest").isNull(), "UNAVAILABLE").otherwise("SUCCESS"), stale,
                F.coalesce("open_orders", none)),
        section("risk_snapshot", good, stale, none),
        section("portfolio_snapshot", F.when(F.col("c_acctbal") > 0, "SUCCESS").otherwise("PARTIAL"), F.lit(False), none))))
    return ob.readiness(rows)


QUERIES = {f.__name__: f for f in (table_health, symbol_freshness, active_alerts, missing_symbol_incidents, feature_drift,
                                   offset_report, symbol_monitor, request_readiness)}
