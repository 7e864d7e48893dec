"""Decision rules over (request, symbol) rows: roll-ups, source quality, confidence, conflicts, review.

A request lists at most ``RequestCaps.max_symbols`` symbols, so the small arrays collected per request are bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barograph.config import TRUSTED_PREFIXES
from barograph.functions.rounding import half_even

# fixed values: severity, default caps and adjustments per risk label
SEVERITY = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
RISK_CAP = {"LOW": 0.95, "MEDIUM": 0.85, "HIGH": 0.65, "CRITICAL": 0.45}
RISK_ADJUSTMENT = {"LOW": 0.02, "MEDIUM": -0.04, "HIGH": -0.12, "CRITICAL": -0.25}


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def half_up(x: Column, digits: int = 2) -> Column:
    """Round half up on the decimal form of the number."""
    return F.round(x, digits)


def _mean2(name: str) -> Column:
    """Two digits of a mean; the noise of the summing order is removed first."""
    return half_even(F.round(name, 10))


def _present(items: Sequence[Column]) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _listed(name: str, when: Column) -> Column:
    """Sorted ``name.symbol`` texts of the rows where the condition holds."""
    return F.array_sort(F.collect_list(F.when(when, F.concat(F.lit(f"{name}."), "symbol"))))


def market_rollup(rows: DataFrame) -> DataFrame:
    """Per request from rows with ``has_market``, ``has_ml``, ``stance`` and ``market_confidence``.

    The strongest signal decides the stance; among equals the first symbol.
    """
    seen = F.col("has_market")
    agg = rows.groupBy("request_id").agg(
        F.count_if(seen).alias("_n"), F.avg(F.when(seen, F.col("market_confidence"))).alias("_c"),
        F.concat(_listed("market_features", ~seen), _listed("ml_predictions", seen & ~F.col("has_ml"))).alias("missing_fields"),
        F.min_by(F.when(seen, F.col("stance")), F.when(seen, F.struct(-F.col("market_confidence"), F.col("symbol"))))
        .alias("market_stance"),
        F.max(F.when(seen, F.greatest("probability_up", "probability_down"))).alias("ml_confidence"))
    return agg.select(
        "request_id", F.coalesce(_mean2("_c"), F.lit(0.0)).alias("market_confidence"), "market_stance", "ml_confidence",
        "missing_fields", F.when(F.col("_n") == 0, "ERROR").when(F.size("missing_fields") > 0, "DEGRADED")
        .otherwise("SUCCESS").alias("market_status"))


def risk_rollup(rows: DataFrame, holdings: DataFrame) -> DataFrame:
    """Worst label, lowest cap and over-weight holdings per request.

    ``holdings`` has (request_id, symbol, weight, max_weight) for requests in portfolio mode.
    """
    seen = F.col("has_market")
    agg = rows.groupBy("request_id", "decision_mode").agg(
        F.max_by(F.when(seen, F.col("risk_label")), F.when(seen, lookup(SEVERITY, F.col("risk_label")))).alias("_label"),
        F.min(F.when(seen, F.col("confidence_cap"))).alias("_cap"), _listed("risk_snapshot", ~seen).alias("_missing"))
    heavy = holdings.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("weight") > F.col("max_weight"), F.col("symbol")))).alias("overweight"),
        F.lit(True).alias("_has"))
    out = agg.join(heavy, "request_id", "left")
    lacking = (F.col("decision_mode") == "portfolio_recommendation") & F.col("_has").isNull()
    none = F.col("_label").isNull()
    missing = F.concat("_missing", F.when(lacking, F.array(F.lit("portfolio_snapshot"))).otherwise(
        F.array().cast("array<string>")))
    return out.select(
        "request_id", F.coalesce("_label", F.lit("HIGH")).alias("risk_label"),
        F.when(none, 0.45).otherwise(F.coalesce("_cap", lookup(RISK_CAP, F.col("_label")))).alias("risk_cap"),
        F.when(none, 0.0).otherwise(half_even(F.least(F.lit(0.8), "_cap"))).alias("risk_confidence"),
        F.when(F.col("decision_mode") == "portfolio_recommendation", F.coalesce("overweight", F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>")).alias("overweight"),
        missing.alias("risk_missing"),
        F.when(none, "ERROR").when(F.size(missing) > 0, "DEGRADED").otherwise("SUCCESS").alias("risk_status"))


def sentiment_rollup(rows: DataFrame) -> DataFrame:
    """Mean strength and common label per request; ``sentiment_stale`` caps the confidence."""
    seen = F.col("sentiment_label").isNotNull()
    agg = rows.groupBy("request_id").agg(
        F.count_if(seen).alias("_n"), F.avg(F.abs("sentiment_score")).alias("_s"), F.min("sentiment_label").alias("_a"),
        F.max("sentiment_label").alias("_b"), F.max("sentiment_stale").alias("_stale"), F.count_if(~seen).alias("_miss"))
    conf = half_even(F.round(F.lit(0.5) + F.least(F.col("_s"), F.lit(1.0)) * 0.3, 10))
    stale = F.coalesce("_stale", F.lit(False))
    return agg.select(
        "request_id", F.when(F.col("_n") == 0, "UNAVAILABLE").when(F.col("_a") != F.col("_b"), "MIXED").otherwise(F.col("_a"))
        .alias("sentiment_label"),
        F.when(F.col("_n") == 0, 0.0).when(stale, F.least(conf, F.lit(0.45))).otherwise(conf).alias("sentiment_confidence"),
        F.when(F.col("_n") == 0, "SKIPPED").when((F.col("_miss") > 0) | stale, "DEGRADED").otherwise("SUCCESS")
        .alias("sentiment_status"))


def valuation_rollup(rows: DataFrame) -> DataFrame:
    """Label by precedence, confidence by the weakest quality."""
    label, quality = F.col("valuation_label"), F.upper("valuation_quality")
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    agg = rows.groupBy("request_id").agg(
        F.count(label).alias("_n"), F.count_if(label.isNull()).alias("_miss"), has(label == "OVERVALUED").alias("_over"),
        has(label == "UNDERVALUED").alias("_under"), has(label == "FAIRLY_VALUED").alias("_fair"),
        has((label == "UNKNOWN") | (quality == "UNKNOWN")).alias("_unknown"), has(quality == "LOW").alias("_low"),
        has(F.col("valuation_stale")).alias("_stale"))
    best = F.when(F.col("_over"), "OVERVALUED").when(F.col("_under"), "UNDERVALUED").when(F.col("_fair"), "FAIRLY_VALUED").otherwise("UNKNOWN")
    conf = F.when(F.col("_unknown") | (best == "UNKNOWN"), 0.35).when(F.col("_low"), 0.45).otherwise(0.58)
    none = F.col("_n") == 0
    return agg.select(
        "request_id", best.alias("valuation_label"),
        F.when(none, 0.0).when(F.col("_stale"), F.least(conf, F.lit(0.45))).otherwise(conf).alias("valuation_confidence"),
        F.when(none, "SKIPPED").when((F.col("_miss") > 0) | F.col("_low") | F.col("_unknown") | F.col("_stale"), "DEGRADED")
        .otherwise("SUCCESS").alias("valuation_status"))


# fixed values: sections of a request's context, in the order of their citations
SECTIONS = ("market_features", "ml_predictions", "sentiment_snapshot", "valuation_snapshot", "risk_snapshot",
            "portfolio_snapshot")


def source_quality(sections: DataFrame) -> DataFrame:
    """Freshness, relevance, completeness and reliability per request.

    ``sections`` has (request_id, section, present, is_stale, source_refs, symbols, wanted, found), one row per section of
    SECTIONS. An absent section has nothing fresh or stale and no sources, but what it should hold is wanted. In portfolio
    mode the portfolio section wants one item, else none.
    """
    here = F.col("present")
    refs = sections.withColumn("source_refs", F.when(here, F.col("source_refs")).otherwise(F.array().cast("array<string>")))
    # Every text is folded once, not again for each symbol or prefix that it is compared with.
    refs = refs.withColumn("is_stale", F.when(here, F.col("is_stale"))).select("*", F.expr(
        "size(filter(transform(source_refs, r -> upper(r)), r -> exists(symbols, s -> contains(r, s))))").alias("_rel"), F.expr(
        "size(filter(transform(source_refs, r -> lower(r)), r -> " + " or ".join(f"startswith(r, '{p}')" for p in TRUSTED_PREFIXES)
        + "))").alias("_trust"))
    agg = refs.groupBy("request_id").agg(
        F.avg((~F.col("is_stale")).cast("double")).alias("_f"), F.sum(F.size("source_refs")).alias("_refs"),
        F.sum("_rel").alias("_rel"), F.sum("_trust").alias("_trust"), F.try_divide(F.sum("found"), F.sum("wanted")).alias("_c"),
        F.coalesce(F.max("is_stale"), F.lit(False)).alias("stale_data"),
        F.coalesce(F.bool_or((F.col("section") == "market_features") & here), F.lit(False)).alias("_market"))
    share = lambda c: half_even(F.coalesce(F.try_divide(F.col(c), F.col("_refs")), F.lit(0.5)))
    scores = agg.select("request_id", "stale_data", "_market", F.coalesce(half_even(F.col("_f")), F.lit(0.0)).alias("freshness"),
                        share("_rel").alias("relevance"), F.coalesce(half_even(F.col("_c")), F.lit(0.0)).alias("completeness"),
                        share("_trust").alias("reliability"))
    total = half_even(0.35 * F.col("freshness") + 0.25 * F.col("relevance") + 0.25 * F.col("completeness")
                      + 0.15 * F.col("reliability"))
    scores = scores.withColumn("quality", total)
    q, f = F.col("quality"), F.col("freshness")
    # fixed values: shares, limits and texts of the warnings
    return scores.select(
        "*", F.when((f < 0.6) | (q < 0.6), 0.55).when(q < 0.7, 0.65).otherwise(0.9).alias("quality_cap"),
        half_even(F.least(F.lit(0.0), (q - 1.0) * 0.2)).alias("quality_adjustment"),
        _present([F.when(~F.col("_market"), "Required market feature data is missing."),
                  F.when(F.col("stale_data"), "One or more tool results are stale."),
                  F.when(F.col("relevance") < 0.7, "Some source references do not directly mention requested symbols."),
                  F.when(F.col("completeness") < 0.7, "Optional or per-symbol tool context is incomplete.")])
        .alias("quality_warnings")).drop("_market")


def citations(sections: DataFrame) -> DataFrame:
    """Distinct source references of the present sections per request, in the order of SECTIONS."""
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    listed = F.array_sort(F.collect_list(F.when(F.col("present"), F.struct(place.alias("place"), F.col("source_refs").alias("refs")))))
    return sections.groupBy("request_id").agg(
        F.filter(F.array_distinct(F.flatten(F.transform(listed, lambda s: s["refs"]))), lambda r: r != "").alias("citations"))


def confidence(rows: DataFrame) -> DataFrame:
    """Weighted confidence, risk adjustment and caps. Adds base, adjustment, cap and final columns."""
    half = lambda c: F.coalesce(F.col(c), F.lit(0.5))
    base = half_up(0.30 * F.col("market_confidence") + 0.25 * half("ml_confidence") + 0.20 * half("sentiment_confidence")
                   + 0.15 * half("valuation_confidence") + 0.10 * F.col("quality"))
    adjust = lookup(RISK_ADJUSTMENT, F.col("risk_label"))
    rows = rows.withColumn("base_confidence", base).withColumn("risk_adjustment", adjust)
    moved = half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("base_confidence") + F.col("risk_adjustment"))))
    cap = F.coalesce("risk_cap", lookup(RISK_CAP, F.col("risk_label")))
    cap = F.when(F.col("major_conflict"), F.least(cap, F.lit(0.70))).otherwise(cap)
    qcap = F.when(F.col("freshness") < 0.6, F.least("quality_cap", F.lit(0.55))).otherwise(F.col("quality_cap"))
    return rows.withColumn("applied_risk_cap", cap).withColumn("applied_quality_cap", qcap).withColumn(
        "final_confidence", half_up(F.least(moved, "applied_risk_cap", "applied_quality_cap")))


def conflicts(rows: DataFrame) -> DataFrame:
    """Conflicting signals, their level, and downgraded recommendation and portfolio action."""
    risky = F.col("risk_label").isin("HIGH", "CRITICAL")
    bull = F.coalesce(F.col("market_stance") == "BULLISH", F.lit(False))
    over = F.coalesce(F.col("valuation_label") == "OVERVALUED", F.lit(False))
    stale, q = F.col("stale_data"), F.col("quality")
    # fixed values: texts of the conflicts, in their order
    found = _present([
        F.when(risky & bull, "Risk is high while market or ML signals are bullish."),
        F.when(risky & over, "Valuation is overvalued while risk is high."),
        F.when((F.col("sentiment_label") == "BEARISH") & bull, "Sentiment is bearish while technical signals are bullish."),
        F.when(q < 0.7, "Source quality is low enough to cap confidence."),
        F.when(stale, "Market or supporting data is stale.")])
    rows = rows.withColumn("conflicting_signals", found)
    n = F.size("conflicting_signals")
    level = (F.when(n == 0, "NONE").when((F.col("risk_label") == "CRITICAL") | (n >= 2) | (F.col("risk_label") == "HIGH"), "HIGH")
             .when(F.col("time_horizon").isin("INTRADAY", "SHORT_TERM"), "MEDIUM").otherwise("LOW"))
    buy, more = F.col("proposed_recommendation") == "BUY", F.col("proposed_action") == "INCREASE_WEIGHT"
    return rows.withColumn("conflict_level", level).withColumn(
        "major_conflict", F.col("conflict_level").isin("MEDIUM", "HIGH")).withColumn(
        "recommendation", F.when(buy & risky, "HOLD").when(buy & ((q < 0.6) | stale), "WATCH")
        .otherwise(F.col("proposed_recommendation"))).withColumn(
        "portfolio_action", F.when(more & (risky | over), "MAINTAIN_WEIGHT").otherwise(F.col("proposed_action")))


def human_review(rows: DataFrame, turnover_limit: float = 25.0) -> DataFrame:
    reasons = _present([
        F.when(F.col("final_confidence") < 0.55, "LOW_CONFIDENCE"),
        F.when(F.col("risk_label").isin("HIGH", "CRITICAL"), "HIGH_RISK"), F.when(F.col("quality") < 0.65, "DATA_QUALITY"),
        F.when(F.col("stale_data"), "STALE_DATA"),
        F.when(F.col("conflict_level").isin("MEDIUM", "HIGH"), "CONFLICTING_SIGNALS"),
        F.when(F.col("turnover_pct") > turnover_limit, "PORTFOLIO_CONSTRAINT_VIOLATION")])
    return rows.withColumn("review_reasons", reasons).withColumn("requires_review", F.size("review_reasons") > 0)


def evidence_hash(*columns: str) -> Column:
    """Digest of the named values as JSON with sorted keys."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def ordered_distinct(*lists: Column) -> Column:
    """Distinct non-empty texts in order of first appearance."""
    return F.array_distinct(F.filter(F.flatten(F.array(*lists)), lambda x: x.isNotNull() & (x != "")))
