"""Registered queries: serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.config import TradeRules
from barograph.operators import alerts as al, intraday, serving as sv
from barograph.plans.common import features, predictions, rounded
from barograph.sources import standins as st


def _scores(spark, sf):
    return predictions(spark, sf).select("symbol", "day", "close", "pred_a", "risk_prob", "final_score",
                                         F.lit("v1").alias("feature_version"))


def _alerts(spark, sf):
    return al.alerts(intraday.indicators(st.hour_bars(spark, sf)))


def advisory_context(spark, sf):
    """Newest scores with features and prices, plus the latest news sentiment per brand where there is one."""
    news = st.news(spark, sf).select(F.regexp_replace("symbol", "src", "Brand#").alias("symbol"), "day", "id", "polarity")
    senti = sv.latest_per_key(news, order=("day", "id")).select("symbol", F.col("polarity").alias("latest_polarity"))
    f = features(spark, sf).select("symbol", "day", F.lit("v1").alias("feature_version"), "r1", "RVOL20", "RSI14", "MACD_hist",
                                   "BB_pctB", "EMA20_50_spread", "EMA20_slope", "ROC10", "ADX14", "vol20", "maxdd20", "beta_60D")
    return rounded(sv.advisory_context(_scores(spark, sf).drop("close"), f, st.eod(spark, sf), "2001-01-01", [senti]),
                   MACD_hist=4, EMA20_slope=4)


def valid_latest_rows(spark, sf):
    rows = _scores(spark, sf).withColumn("prediction_time", F.expr("date_add(day, day(day) % 3)"))
    return rounded(sv.valid_latest(rows.drop("feature_version"), ["prediction_time", "day"]))


def request_context_status(spark, sf):
    """Requests are the customers' holdings; the context holds the brands scored on the newest day."""
    newest = sv.at_latest_day(_scores(spark, sf))
    wanted = st.positions(spark, sf).select(F.col("account_id").alias("request_id"), "symbol").crossJoin(
        F.broadcast(newest.agg(F.expr("max(day) + interval 2 days").cast("timestamp").alias("as_of"))))
    return sv.request_status(wanted, newest.select("symbol", F.col("day").cast("timestamp").alias("updated_at")), 86400)


def latest_screen(spark, sf):
    f = features(spark, sf).select("symbol", "day", "r1", "r3", "r5", "RVOL20")
    top = sv.screen(_scores(spark, sf), 5).select("symbol", "day", "pred_a", "risk_prob", "final_score")
    return rounded(sv.enrich(top, st.eod(spark, sf), f), latest_price=None)


def latest_scores(spark, sf):
    return rounded(sv.latest_per_key(_scores(spark, sf)))


def holdings_comparison(spark, sf):
    """Each customer's brands ranked by their latest score, with row warnings."""
    latest = sv.latest_per_key(_scores(spark, sf).select("symbol", "day", F.col("close").alias("latest_price"), "final_score"))
    held = st.positions(spark, sf).select("account_id", "symbol").join(latest, "symbol", "left")
    return rounded(sv.comparison(held, "account_id"), latest_price=None)


RULES = TradeRules(min_pred_a=0.06, max_risk=0.45)


def _picks(spark, sf):
    p = _scores(spark, sf).select(F.col("day").alias("Datetime"), F.col("symbol").alias("Ticker"), F.col("close").alias("Close"),
                                  F.col("pred_a").alias("Pred_A"), F.col("risk_prob").alias("RiskProb"))
    return sv.picks(p, RULES, limit=25)  # the page of picks


def stock_picks(spark, sf):
    return rounded(_picks(spark, sf), entry_price=None)


def picks_summary(spark, sf):
    return rounded(sv.picks_summary(_picks(spark, sf), 0.02, 42.0))


def market_overview(spark, sf):
    t = st.ticks(spark, sf).select(F.col("symbol").alias("indicator"), "ts", F.col("price").alias("close"), "volume")
    return rounded(sv.market_overview(t))


def latest_market(spark, sf):
    return rounded(sv.latest_market(st.hour_bars(spark, sf)))


def symbol_directory(spark, sf):
    return sv.symbol_list(st.trades(spark, sf))


def symbol_history(spark, sf):
    return sv.symbol_history(st.hour_bars(spark, sf), "purchase", "2024-01-10 00:00:00")


def _news_versions(spark, sf):
    """Stories keyed by text, so copies are versions of one story."""
    n = st.news(spark, sf)
    return n.select(F.col("day").cast("timestamp").alias("ts"), "symbol", F.md5("headline").alias("id"), "headline", "url",
                    F.col("id").alias("event_timestamp"))


def news_search(spark, sf):
    return sv.news_search(_news_versions(spark, sf), text="THE ", limit=300).drop("headline")


def alert_search(spark, sf):
    return sv.alert_search(_alerts(spark, sf), ("click", "purchase", "view"), (), ("HIGH", "MEDIUM"), "2024-01-05", "2024-01-20",
                           100).select("symbol", "event_time", "alert_type", "alert_level", "feature_name")


def alert_facets(spark, sf):
    return sv.alert_facets(_alerts(spark, sf))


def market_page(spark, sf):
    return rounded(sv.page(sv.latest_market(st.eod(spark, sf).withColumn("ts", F.col("day").cast("timestamp"))), 2, 5,
                           "day_change_pct", True, "brand"))


def indicator_names(spark, sf):
    codes = st.table(spark, sf, "part").groupBy(F.concat(F.lit("^"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("=F"))
                                                .alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return codes.withColumn("name", sv.display_name("code"))


def table_diagnostics(spark, sf):
    return sv.diagnostics(_scores(spark, sf), "predictions").unionByName(sv.diagnostics(
        st.positions(spark, sf), "positions"))


QUERIES = {f.__name__: f for f in (
    advisory_context, valid_latest_rows, request_context_status, latest_screen, latest_scores, holdings_comparison,
    stock_picks, picks_summary, market_overview, latest_market, symbol_directory, symbol_history, news_search, alert_search,
    alert_facets, market_page, indicator_names, table_diagnostics)}
