"""Registered queries: signals, decision rules, portfolios, messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.config import PortfolioRules
from barograph.operators import decisions as de, portfolio as pf, serving as sv, signals as sg
from barograph.plans import context as cx
from barograph.plans.common import features, predictions, rounded
from barograph.session import materialized
from barograph.sources import standins as st


def _context(spark, sf):
    """Scored rows with their features; the stand-in's scores are stretched to cover all label ranges."""
    p = predictions(spark, sf)
    return p.withColumn("pred_a", F.col("pred_a") * 5).withColumn("risk_prob", F.least(F.lit(1.0), F.col("risk_prob") * 1.4))


def symbol_signals(spark, sf):
    s = sg.symbol_signals(_context(spark, sf))
    return rounded(s.select("symbol", "day", "predicted_direction", "probability_up", "probability_down", "trend_direction",
                            "price_change_1d", "volume_ratio", "rsi_14", "macd_signal", "bollinger_position", "risk_label",
                            F.size("risk_factors").alias("factors"), F.col("risk_factors")[0].alias("first_factor"),
                            "volatility", "max_drawdown", "confidence_cap"))


def market_stances(spark, sf):
    s = sg.symbol_signals(_context(spark, sf)).withColumn("has_ml", F.dayofmonth("day") % 5 != 0)
    return rounded(sg.market_stance(s).select("symbol", "day", "stance", "market_confidence"))


def _requests(spark, sf):
    """Customers as requests."""
    c = st.table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_nationkey") % 2 == 0, "portfolio_recommendation").otherwise("single_symbol_advisory").alias("decision_mode"),
        F.when(F.col("c_mktsegment") == "BUILDING", "SHORT_TERM").otherwise("LONG_TERM").alias("time_horizon"),
        F.when(F.col("c_custkey") % 3 == 0, "BUY").when(F.col("c_custkey") % 3 == 1, "SELL").alias("proposed_recommendation"),
        F.when(F.col("c_custkey") % 2 == 0, "INCREASE_WEIGHT").otherwise("EXIT").alias("proposed_action"),
        (F.col("c_custkey") % 40).cast("double").alias("turnover_pct"))


def _brand_valuation(spark, sf):
    part = st.table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), "p_brand")
    rows = cx.valuation(spark, sf).join(part, "symbol").groupBy("p_brand").agg(
        F.max_by(F.struct("valuation_label", "valuation_quality", F.col("symbol").alias("part")), "symbol").alias("v"))
    return rows.select(F.col("p_brand").alias("symbol"), "v.*", F.lit(False).alias("valuation_stale"))


def _request_rows(spark, sf, positions=None):
    """One row per request and symbol with every context section; the newest day covers only some brands."""
    positions = st.positions(spark, sf) if positions is None else positions
    ctx = sv.at_latest_day(_context(spark, sf))
    s = sg.market_stance(sg.symbol_signals(ctx).withColumn("has_ml", F.lit(True))).select(
        "symbol", "stance", "market_confidence", "probability_up", "probability_down", "risk_label", "confidence_cap",
        F.lit(True).alias("_m"))
    senti = cx.sentiment(spark, sf).select(
        F.replace("symbol", F.lit("src"), F.lit("Brand#")).alias("symbol"), "sentiment_label", "sentiment_score",
        (F.col("latest_article_published_at") < F.lit("2024-02-15").cast("timestamp")).alias("sentiment_stale"))
    rows = _requests(spark, sf).join(positions.select(F.col("account_id").alias("request_id"), "symbol"), "request_id")
    rows = rows.join(s, "symbol", "left").join(senti, "symbol", "left").join(_brand_valuation(spark, sf), "symbol", "left")
    # Five roll-ups read these rows.
    return materialized(rows.withColumn("has_market", F.col("_m").isNotNull()).withColumn("has_ml", F.col("has_market")).drop("_m"))


def market_rollup(spark, sf):
    return rounded(de.market_rollup(_request_rows(spark, sf)))


def _holdings(spark, sf):
    return pf.holdings(st.positions(spark, sf))


def _risk(rows, positions):
    held = pf.holdings(positions).select(F.col("account_id").alias("request_id"), "symbol", "weight", F.lit(12.0).alias("max_weight"))
    return de.risk_rollup(rows, held.where("request_id % 7 <> 0"))


def risk_rollup(spark, sf):
    return rounded(_risk(_request_rows(spark, sf), st.positions(spark, sf)))


def sentiment_rollup(spark, sf):
    return rounded(de.sentiment_rollup(_request_rows(spark, sf)))


def valuation_rollup(spark, sf):
    return rounded(de.valuation_rollup(_request_rows(spark, sf)))


def _references(rows):
    """One row per request with the references of its sections; it lists at most the universe of brands."""
    refs = lambda prefix, key, have: F.array_sort(F.collect_list(F.when(have, F.concat(F.lit(prefix), F.col(key).cast("string")))))
    has_s, has_v = F.col("sentiment_label").isNotNull(), F.col("valuation_label").isNotNull()
    return rows.groupBy("request_id", "decision_mode").agg(
        F.collect_list(F.upper("symbol")).alias("symbols"), F.count(F.lit(1)).alias("wanted"),
        refs("ml_ready.stock_price_features:", "symbol", F.col("has_market")).alias("r1"), F.count_if("has_market").alias("f1"),
        refs("ml.predictions:", "symbol", F.col("has_ml")).alias("r4"), F.count_if("has_ml").alias("f4"),
        refs("ml.risk:", "symbol", F.col("has_market")).alias("r5"),
        refs("finbert.news:", "symbol", has_s).alias("r2"), F.count_if(has_s).alias("f2"),
        F.coalesce(F.max("sentiment_stale"), F.lit(False)).alias("s2"),
        refs("yfinance.fundamentals:", "part", has_v).alias("r3"), F.count_if(has_v).alias("f3"))


def _sections(references):
    """The six sections of every request. Every seventh request has no portfolio."""
    part = lambda name, refs_, found, stale, wanted=F.col("wanted"), present=None: F.struct(
        F.lit(name).alias("section"), (found > 0 if present is None else present).alias("present"), refs_.alias("source_refs"),
        wanted.cast("long").alias("wanted"), found.cast("long").alias("found"), stale.alias("is_stale"))
    held, mode = F.col("request_id") % 7 != 0, F.col("decision_mode") == "portfolio_recommendation"
    return references.select("request_id", "symbols", F.inline(F.array(
        part("market_features", F.col("r1"), F.col("f1"), F.lit(False)),
        part("ml_predictions", F.col("r4"), F.col("f4"), F.lit(False)),
        part("sentiment_snapshot", F.col("r2"), F.col("f2"), F.col("s2")),
        part("valuation_snapshot", F.col("r3"), F.col("f3"), F.lit(False)),
        part("risk_snapshot", F.col("r5"), F.col("f1"), F.lit(False)),
        part("portfolio_snapshot", F.array(F.concat(F.lit("postgresql.portfolio_positions:"), F.col("request_id").cast("string"))),
             (held & mode).cast("long"), F.lit(False), mode.cast("long"), held))))


def source_quality(spark, sf):
    return rounded(de.source_quality(_sections(_references(_request_rows(spark, sf)))))


def _decisions(spark, sf):
    # The rows and the risk section read the positions, and two operators the sections; each is made once.
    positions = materialized(st.positions(spark, sf))
    rows = _request_rows(spark, sf, positions)
    out, sections = _requests(spark, sf), _sections(materialized(_references(rows)))
    for part in (de.market_rollup(rows), _risk(rows, positions), de.sentiment_rollup(rows), de.valuation_rollup(rows),
                 de.source_quality(sections), de.citations(sections)):
        out = out.join(part, "request_id")
    return de.human_review(de.confidence(de.conflicts(out)))


def request_decisions(spark, sf):
    d = _decisions(spark, sf)
    return rounded(d.select(
        "request_id", "conflict_level", "major_conflict", "conflicting_signals", "recommendation", "portfolio_action",
        "base_confidence", "risk_adjustment", "applied_risk_cap", "applied_quality_cap", "final_confidence", "review_reasons",
        "requires_review", de.ordered_distinct(F.transform("missing_fields", lambda x: F.concat(F.lit("missing:"), x)),
                                               F.transform("risk_missing", lambda x: F.concat(F.lit("missing:"), x)),
                                               "quality_warnings").alias("limitations"), "citations"))


def evidence_hashes(spark, sf):
    """Digest of each request's own fields."""
    r = _requests(spark, sf)
    return r.select("request_id", de.evidence_hash("request_id", "decision_mode", "time_horizon", "proposed_recommendation")
                    .alias("result_hash"))


def account_holdings(spark, sf):
    return rounded(_holdings(spark, sf), 2)


def tenant_holdings(spark, sf):
    return rounded(pf.holdings(st.positions(spark, sf), tenant="BUILDING"), 2)


def rebalance_plan(spark, sf):
    return rounded(pf.rebalance(_holdings(spark, sf), PortfolioRules(max_weight=6.0, min_cash=10.0, excluded=("BRAND#3", "BRAND#7"))), 2)


def allocation_checks(spark, sf):
    """Holdings with their cash row as proposed allocations."""
    pos = st.positions(spark, sf)
    cash = pos.groupBy("account_id").agg((F.max("cash") / (F.sum("market_value") + F.max("cash")) * 100).alias("weight_pct"))
    rows = _holdings(spark, sf).select(F.col("account_id").alias("portfolio_id"), "symbol", F.col("weight").alias("weight_pct")).unionByName(
        cash.select(F.col("account_id").alias("portfolio_id"), F.lit("CASH").alias("symbol"), F.round("weight_pct", 2).alias("weight_pct")))
    return pf.allocation_faults(rows, 15.0, 0.5)


def forbidden_claim_scan(spark, sf):
    docs = st.table(spark, sf, "documents").select("doc_id", "text")
    chat = st.table(spark, sf, "conversations").select((-F.col("conv_id") * 1000 - F.col("turn")).alias("doc_id"), "text")
    return pf.forbidden_claims(docs.unionByName(chat)).select("doc_id", "claims", F.length("text").alias("chars"))


def message_routes(spark, sf):
    m = st.table(spark, sf, "conversations")
    return pf.message_tickers(m).select("conv_id", "turn", F.array_sort("symbols").alias("symbols"), "route", "router_confidence")


QUERIES = {f.__name__: f for f in (
    symbol_signals, market_stances, market_rollup, risk_rollup, sentiment_rollup, valuation_rollup, source_quality,
    request_decisions, evidence_hashes, account_holdings, tenant_holdings, rebalance_plan, allocation_checks,
    forbidden_claim_scan, message_routes)}
