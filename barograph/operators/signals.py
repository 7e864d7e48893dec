"""Per-symbol signals from context rows: model direction, trend, indicator labels, risk, stance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barograph.functions.rounding import half_even


def symbol_signals(context: DataFrame, drawdown_sign: int = 1) -> DataFrame:
    """Labels per row of joined scores, features and close.

    ``drawdown_sign=-1`` reads a positive drawdown as a loss; the default keeps the literal comparison.
    """
    rows = context.selectExpr(
        "*", "greatest(0.0d, least(1.0d, coalesce(pred_a, 0.0d))) as probability_up",
        "coalesce(risk_prob, 0.0d) as _risk", "greatest(0.0d, coalesce(vol20, 0.0d)) as volatility",
        f"coalesce(maxdd20, 0.0d) * {drawdown_sign} as max_drawdown",
        "coalesce(signum(EMA20_50_spread), 0) + coalesce(signum(EMA20_slope), 0) + coalesce(signum(ROC10), 0) as _votes",
        "coalesce(ADX14, 0.0d) >= 15 as _strong", "coalesce(BB_pctB, 0.5d) as _band", "coalesce(MACD_hist, 0.0d) as _macd")
    rows = rows.selectExpr(
        "*", "1.0d - probability_up as probability_down",
        "case when probability_up >= 0.55d then 'UP' when probability_up <= 0.45d then 'DOWN' else 'NEUTRAL' end "
        "as predicted_direction")
    rows = rows.selectExpr(
        "*", "case when _strong and _votes > 0 then 'UP' when _strong and _votes < 0 then 'DOWN' "
        "else predicted_direction end as trend_direction")
    return rows.selectExpr(
        *[c for c in context.columns], "probability_up", "probability_down", "predicted_direction", "trend_direction",
        "close as latest_price", "coalesce(r1, 0.0d) as price_change_1d", "greatest(coalesce(RVOL20, 1.0d), 0.0d) as volume_ratio",
        "if(RSI14 between 0 and 100, RSI14, null) as rsi_14",
        "case when _macd > 0 then 'BULLISH' when _macd < 0 then 'BEARISH' else 'NEUTRAL' end as macd_signal",
        "case when _band >= 0.8d then 'UPPER' when _band <= 0.2d then 'LOWER' else 'MIDDLE' end as bollinger_position",
        "case when _risk >= 0.75d then 'CRITICAL' when _risk >= 0.6d then 'HIGH' when _risk >= 0.35d then 'MEDIUM' "
        "else 'LOW' end as risk_label",
        "filter(array(format_string('upstream risk_prob=%.4f', _risk), "
        "if(volatility >= 0.04d, format_string('high volatility vol20=%.4f', volatility), null), "
        "if(max_drawdown <= -0.10d, format_string('large drawdown maxdd20=%.4f', max_drawdown), null)), "
        "f -> f is not null) as risk_factors",
        "volatility", "max_drawdown", "greatest(0.25d, least(0.9d, 1 - _risk / 2)) as confidence_cap")


def market_stance(signals: DataFrame) -> DataFrame:
    """Stance and confidence per row; ``has_ml`` tells whether there is a score."""
    rows = signals.selectExpr(
        "*", "if(upper(trend_direction) in ('UP', 'DOWN'), 0.66d, 0.55d) as _trend")
    return rows.selectExpr(
        *signals.columns,
        "case when has_ml and probability_up >= 0.6d then 'BULLISH' when has_ml and probability_down >= 0.6d then 'BEARISH' "
        "when upper(trend_direction) in ('UP', 'BULLISH') then 'BULLISH' "
        "when upper(trend_direction) in ('DOWN', 'BEARISH') then 'BEARISH' else 'NEUTRAL' end as stance",
        "if(has_ml, (_trend + greatest(probability_up, probability_down)) / 2, _trend) as market_confidence").withColumn(
        "market_confidence", F.when(F.col("has_ml"), half_even(F.col("market_confidence"))).otherwise(F.col("market_confidence")))
