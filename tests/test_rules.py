"""Fixed cases of the decision rules, alerts, portfolios, news and tables."""

import random
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from barograph.config import PortfolioRules
from barograph.operators import alerts as al, decisions as de, news as nw, portfolio as pf, signals as sg
from barograph.sources import tables as tb


def _conf(spark, market, ml, senti, value, quality, label, cap=None, qcap=0.9, fresh=1.0, conflict=False):
    return de.confidence(spark.createDataFrame(
        [(market, ml, senti, value, quality, label, cap, qcap, fresh, conflict)],
        "market_confidence double, ml_confidence double, sentiment_confidence double, valuation_confidence double, quality double, "
        "risk_label string, risk_cap double, quality_cap double, freshness double, major_conflict boolean")).first()


def test_confidence_cases(spark):
    r = _conf(spark, 0.9, 0.9, 0.8, 0.8, 0.9, "HIGH")
    assert (r.base_confidence, r.risk_adjustment, r.applied_risk_cap, r.final_confidence) == (0.87, -0.12, 0.65, 0.65)
    r = _conf(spark, 0.95, 0.95, 0.95, 0.95, 0.8, "LOW", fresh=0.4)
    assert (r.applied_quality_cap, r.final_confidence) == (0.55, 0.55)
    r = _conf(spark, 0.95, 0.95, 0.95, 0.95, 0.95, "LOW", conflict=True)
    assert (r.applied_risk_cap, r.final_confidence) == (0.70, 0.70)


CONTEXT = ("close double, pred_a double, risk_prob double, vol20 double, maxdd20 double, ADX14 double, EMA20_50_spread double, "
           "EMA20_slope double, ROC10 double, BB_pctB double, MACD_hist double, RSI14 double, r1 double, RVOL20 double")


def _signal(spark, pred=0.5415, risk=0.0378, adx=24.0):
    row = (442.25, pred, risk, 0.02, 0.05, adx, 2.1, 0.4, 1.9, 0.84, 0.17, 61.0, 0.01, 1.2)
    return sg.symbol_signals(spark.createDataFrame([row], CONTEXT)).first()


def test_signal_cases(spark):
    r = _signal(spark)
    assert (r.predicted_direction, r.trend_direction, r.bollinger_position, r.macd_signal, r.risk_label, r.confidence_cap) == (
        "NEUTRAL", "UP", "UPPER", "BULLISH", "LOW", 0.9)
    assert [_signal(spark, p).predicted_direction for p in (0.55, 0.45, 0.5)] == ["UP", "DOWN", "NEUTRAL"]
    got = [(x.risk_label, x.confidence_cap) for x in (_signal(spark, risk=p) for p in (0.35, 0.6, 0.75))]
    assert got == [("MEDIUM", 0.825), ("HIGH", 0.7), ("CRITICAL", 0.625)]
    assert _signal(spark, 0.2, adx=10.0).trend_direction == "DOWN"


def _review(spark, conf, label, quality, stale, level, turnover):
    return de.human_review(spark.createDataFrame([(conf, label, quality, stale, level, turnover)],
        "final_confidence double, risk_label string, quality double, stale_data boolean, conflict_level string, turnover_pct double")).first()


def test_review_gate_cases(spark):
    r = _review(spark, 0.74, "MEDIUM", 0.9, False, "LOW", None)
    assert (r.requires_review, r.review_reasons) == (False, [])
    r = _review(spark, 0.5, "HIGH", 0.6, True, "HIGH", None)
    assert r.requires_review and r.review_reasons == ["LOW_CONFIDENCE", "HIGH_RISK", "DATA_QUALITY", "STALE_DATA", "CONFLICTING_SIGNALS"]
    r = _review(spark, 0.8, "LOW", None, False, None, 30.0)
    assert r.requires_review and r.review_reasons == ["PORTFOLIO_CONSTRAINT_VIOLATION"]


def test_scorer_plugs_in(spark):
    def scorer(frames):
        for frame in frames:
            yield frame.assign(score=frame["headline"].str.len() - 4.0)

    news = spark.createDataFrame([("A", "up"), ("B", "long headline"), ("C", "four"), ("D", "")], "symbol string, headline string")
    got = {r.symbol: r.score for r in nw.score_items(news, scorer).collect()}
    assert got == {"A": -1.0, "B": 1.0, "C": 0.0, "D": -1.0}  # kept within [-1, 1]


def _conflict(spark, label, stance, senti, value, horizon, rec, act):
    return de.conflicts(spark.createDataFrame([(label, stance, senti, value, horizon, rec, act, False, 1.0)],
        "risk_label string, market_stance string, sentiment_label string, valuation_label string, time_horizon string, "
        "proposed_recommendation string, proposed_action string, stale_data boolean, quality double")).first()


def test_conflict_cases(spark):
    r = _conflict(spark, "HIGH", "BULLISH", None, None, None, "BUY", None)
    assert (r.recommendation, r.conflict_level) == ("HOLD", "HIGH")
    assert _conflict(spark, "LOW", "BULLISH", "BEARISH", None, "SHORT_TERM", None, None).conflict_level == "MEDIUM"
    assert _conflict(spark, "HIGH", "NEUTRAL", None, "OVERVALUED", None, None, "INCREASE_WEIGHT").portfolio_action == "MAINTAIN_WEIGHT"


def test_rebalance_and_tenants(spark):
    held = spark.createDataFrame([(1, "t", s, w, 0.0) for s, w in (("AAA", 80.0), ("BBB", 10.0), ("CCC", 10.0))],
                                 "account_id int, tenant_id string, symbol string, market_value double, cash double")
    rows = pf.rebalance(pf.holdings(held), PortfolioRules(max_weight=30.0, min_cash=20.0, excluded=("BBB",))).collect()
    assert {(r.symbol, r.target_weight, r.change, r.cash_target) for r in rows} == {("AAA", 30.0, -50.0, 40.0), ("CCC", 30.0, 20.0, 40.0)}
    assert pf.holdings(held, tenant="other").count() == 0


def test_allocation_faults(spark):
    rows = [("ok", "AAPL", 80.0), ("ok", "CASH", 20.0), ("over", "AAPL", 95.0), ("over", "CASH", 5.0), ("sum", "AAPL", 50.0),
            ("neg", "AAPL", -1.0), ("neg", "CASH", 101.0)]
    df = spark.createDataFrame(rows, "portfolio_id string, symbol string, weight_pct double")
    assert {r.portfolio_id for r in pf.allocation_faults(df, 80.0, 10.0).collect() if r.passed} == {"ok"}


def test_tickers(spark):
    text = ["Compare AAPL and MSFT using latest API predictions", "what about it?", "I like BRK-B, THE best", "aXYZ 1ABC ABCDEF"]
    rows = pf.message_tickers(spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "conv_id int, turn int, text string"))
    got = {r.turn: (r.symbols, r.route) for r in rows.collect()}
    assert got[0] == (["AAPL", "MSFT"], "symbol_comparison") and got[1][0] == ["AAPL", "MSFT"]
    assert got[2] == (["BRK-B"], "single_symbol_advisory") and got[3][0] == ["AAPL", "MSFT", "BRK-B"]


def test_ticker_hints(spark):
    rows = [(1, 0, "AAPL?", [" brk.b", "too long", None]), (1, 1, "what about it?", None), (1, 2, "nothing", ["msft"]), (1, 3, None, [])]
    rows = pf.message_tickers(spark.createDataFrame(rows, "conv_id int, turn int, text string, given array<string>"), hints="given")
    got = {r.turn: r.symbols for r in rows.collect()}
    assert got == {0: ["BRK-B", "AAPL"], 1: ["BRK-B", "AAPL"], 2: ["MSFT"], 3: ["BRK-B", "AAPL", "MSFT"]}


def _quality(spark, absent=(), stale=(), mode=True):
    rows = [(1, s, s not in absent, s in stale, [f"ml_ready.{s}:{x}" for x in ("AAPL", "MSFT")], ["AAPL", "MSFT"],
             2 if s != "portfolio_snapshot" else int(mode), 0 if s in absent else 2 if s != "portfolio_snapshot" else int(mode))
            for s in de.SECTIONS]
    sections = spark.createDataFrame(rows, "request_id int, section string, present boolean, is_stale boolean, "
                                           "source_refs array<string>, symbols array<string>, wanted long, found long")
    return de.source_quality(sections).first(), de.citations(sections).first().citations


def test_source_quality_cases(spark):
    r, cited = _quality(spark)
    assert (r.quality, r.freshness, r.quality_cap, r.stale_data, r.quality_warnings) == (1.0, 1.0, 0.9, False, [])
    assert len(cited) == 12 and cited[:3] == ["ml_ready.market_features:AAPL", "ml_ready.market_features:MSFT", "ml_ready.ml_predictions:AAPL"]
    r, _ = _quality(spark, stale=de.SECTIONS[:4])
    assert (r.stale_data, r.freshness, r.quality_cap, r.quality_warnings) == (True, 0.33, 0.55, ["One or more tool results are stale."])
    r, cited = _quality(spark, absent=["valuation_snapshot", "sentiment_snapshot"], stale=["valuation_snapshot"])
    assert (r.completeness, r.stale_data, r.freshness) == (0.64, False, 1.0) and len(cited) == 8
    assert r.quality_warnings == ["Optional or per-symbol tool context is incomplete."]
    r, _ = _quality(spark, absent=["market_features"], mode=False)
    assert r.quality_warnings == ["Required market feature data is missing."] and r.completeness == 0.8
    r, cited = _quality(spark, absent=de.SECTIONS)
    assert (r.freshness, r.relevance, r.reliability, r.completeness, r.quality_cap, cited) == (0.0, 0.5, 0.5, 0.0, 0.55, [])


def test_relevance_with_long_lists_of_aliases(spark):
    """Same items as a search for every alias, and a text costs no pass for each alias."""
    draw = random.Random(5)
    letters = "abAß \u00e9\U0001F600."
    text = ["".join(draw.choices(letters, k=draw.randrange(60))) for _ in range(300)] + [None, "", "One two  threefold", "ONE\ttwo three"]
    alias = {"few": ["".join(draw.choices(letters, k=draw.randrange(9))) for _ in range(8)] + [None, "", "two  three"],
             "many": ["".join(draw.choices(letters, k=draw.randrange(5, 12))) for _ in range(400)] + [None, "", "e two  threefo", "ne\tt"]}
    names = spark.createDataFrame([(s, a) for s, v in alias.items() for a in v] + [(None, "a")], "symbol string, alias string")
    rows = spark.createDataFrame([(s, i, t) for s in [*alias, "none", None] for i, t in enumerate(text)] + [("many", 302, text[302])],
                                 "symbol string, id int, text string")
    want = [(s, i) for s, v in alias.items() for i, t in enumerate(text) if t and any(a and a.lower() in t.lower() for a in v)]
    got = nw.relevant(rows, names)
    assert got.columns == ["symbol", "id", "text"]
    assert sorted((r.symbol, r.id) for r in got.collect()) == sorted(want + [("many", 302)])
    assert 0 < len(want) < 500 and ("many", 302) in want and ("many", 303) in want
    names = spark.range(3000).selectExpr("'S' as symbol", "concat('q', substr(md5(cast(id as string)), 1, 9)) as alias")
    rows = spark.range(400).selectExpr("'S' as symbol", "id", "repeat(concat('plain words of text ', id, ' '), 500) as text")
    started = time.time()
    assert nw.relevant(rows, names).count() == 0
    assert time.time() - started < 30
    assert nw.relevant(rows, names.union(spark.createDataFrame([("S", "text 41 plain")], names.schema))).first().id == 41


def test_news_relevance_and_merge(spark):
    names = spark.createDataFrame([("AAPL", a) for a in ("AAPL", "apple", "apple inc")], "symbol string, alias string")
    text = ["Apple launches new chips", "AAPL shares rise", "Broad market rallies"]
    rows = spark.createDataFrame([("AAPL", t) for t in text], "symbol string, text string")
    assert {r.text for r in nw.relevant(rows, names).collect()} == set(text[:2])
    item = "symbol string, id bigint, headline string, url string, published_at timestamp"
    a = spark.createDataFrame([("S", 1, "x", "U1", datetime(2024, 1, 1)), ("S", 2, "same", None, datetime(2024, 1, 1))], item)
    b = spark.createDataFrame([("S", 3, "y", "u1", datetime(2024, 1, 2)), ("S", 4, "Same ", "", datetime(2024, 1, 1)),
                               ("S", 5, "same", None, datetime(2024, 1, 3))], item)
    got = {(r.id, r.data_source) for r in nw.merge_sources([("one", a), ("two", b)]).collect()}
    assert got == {(1, "one"), (2, "one"), (5, "two")}


def test_news_fallback_outside_window(spark):
    rows = [("OLD", i, f"h{i}", datetime(2023, 1, 1 + i), 0.5) for i in range(12)] + [("NEW", 50, "n", datetime(2024, 2, 19), -0.5),
                                                                                      ("NEW", 51, "o", datetime(2023, 2, 19), 0.9)]
    df = spark.createDataFrame(rows, "symbol string, id bigint, headline string, published_at timestamp, polarity double").withColumn(
        "data_source", F.lit("yfinance"))
    s = nw.sentiment_snapshot(nw.score_items(nw.in_window(nw.newest_items(df), "2024-02-20 00:00:00")), "2024-02-20")
    got = {r.symbol: (r.article_count, r.stale_article_count, r.sentiment_label, len(r.top_drivers)) for r in s.collect()}
    assert got == {"OLD": (10, 10, "BULLISH", 3), "NEW": (1, 0, "BEARISH", 1)}


def test_each_alert_kind(spark):
    base = dict(symbol="AAA", ts=datetime(2024, 1, 1), open=1.0, high=1.0, low=1.0, close=100.0, volume=1, rsi14=50.0, ema9=1.0, ema20=1.0,
                ema50=1.0, prev_ema9=1.0, prev_ema20=1.0, prev_ema50=1.0, avg_volume20=1.0, rvol20=1.0, atr14=1.0, avg_atr50=1.0,
                volatility20=1.0, avg_volatility50=1.0, sma20=100.0, std20=1.0, bb_upper20=110.0, bb_lower20=90.0, momentum5=0.0,
                prev_momentum5=0.0)
    cases = {"RSI_OVERBOUGHT": dict(rsi14=71.0), "RSI_OVERSOLD": dict(rsi14=29.0), "VOLUME_SPIKE": dict(rvol20=5.5),
             "PRICE_ABOVE_BOLLINGER_UPPER": dict(bb_upper20=99.0), "PRICE_BELOW_BOLLINGER_LOWER": dict(bb_lower20=101.0),
             "BULLISH_EMA_CROSS": dict(ema9=2.0), "BEARISH_EMA_CROSS": dict(ema9=0.5), "BULLISH_TREND_EMA_CROSS": dict(ema50=0.5),
             "BEARISH_TREND_EMA_CROSS": dict(ema50=2.0), "ATR_SPIKE": dict(atr14=2.1), "VOLATILITY_SPIKE": dict(volatility20=2.1),
             "BULLISH_MOMENTUM_REVERSAL": dict(momentum5=1.0, prev_momentum5=-0.1),
             "BEARISH_MOMENTUM_REVERSAL": dict(momentum5=-1.0, prev_momentum5=0.1)}
    rows = [{**base, **change, "symbol": kind} for kind, change in cases.items()]
    found = al.alerts(spark.createDataFrame(rows)).collect()
    assert sorted((r.symbol, r.alert_type) for r in found) == sorted((k, k) for k in cases)
    assert {r.alert_type for r in found if r.alert_level == "HIGH"} == {"VOLUME_SPIKE", "BULLISH_TREND_EMA_CROSS",
                                                                        "BEARISH_TREND_EMA_CROSS", "ATR_SPIKE", "VOLATILITY_SPIKE"}


def test_upsert_and_schema_growth(spark, tmp_path):
    path, schema = str(tmp_path / "t"), tb.table_schema("ml.predictions")
    one = spark.createDataFrame([(date(2024, 1, 1), "A", 1.0), (date(2024, 1, 2), None, 2.0)], "day date, symbol string, pred_a double")
    two = one.withColumn("pred_a", F.col("pred_a") * 10).where("pred_a > 15")
    for rows in (one, two, two):
        tb.upsert(rows, path, schema, ["day", "symbol"])
    got = {(r.day.day, r.symbol, r.pred_a) for r in spark.read.schema(schema).parquet(path).collect()}
    assert got == {(1, "A", 1.0), (2, None, 20.0)}
    assert tb.grown_schema(one.schema, one.withColumn("x", F.lit(1)).schema).fieldNames() == ["day", "symbol", "pred_a", "x"]


def test_gates_raise(spark):
    from barograph.operators import quality as ql
    from barograph.operators.daily_features import check_contract

    bars = spark.createDataFrame([("A", date(2024, 1, 1))], "symbol string, day date")
    gate = ql.history_gate(bars, spark.createDataFrame([("A",), ("B",)], "symbol string"), 2)
    assert {(r.symbol, r.status) for r in gate.collect()} == {("A", "short"), ("B", "missing")}
    with pytest.raises(ValueError):
        ql.require_history(gate)
    with pytest.raises(ValueError):
        ql.require_rows(bars.limit(0), "clean")
    with pytest.raises(ValueError):
        check_contract(bars)


def test_half_even_rounds_like_python(spark):
    import random

    from barograph.functions.rounding import half_even

    rng = random.Random(7)
    cases = [0.125, 0.625, 5.625, 0.605, 0.615, 2.675, 1.005, -0.125, -0.615, 0.0, -0.001, 99.995, 12345.675] + [
        k / 8 for k in range(-40, 40)] + [k / 1000 for k in range(1, 2000, 5)] + [rng.uniform(-1e4, 1e4) for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in cases], "x double").select("x", half_even(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [round(r.x, 2) for r in rows]
