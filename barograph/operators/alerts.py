"""Alert rules over rows with intraday indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barograph.config import AlertRules
from barograph.schemas import ALERTS

# fixed values: fields of the metadata document, in the order of their names
_META = [("Close", "close"), ("High", "high"), ("Low", "low"), ("Open", "open"), ("Volume", "volume"),
         *[(n, n) for n in ("atr14", "avg_atr50", "avg_volatility50", "avg_volume20", "bb_lower20", "bb_upper20", "ema20",
                            "ema50", "ema9", "momentum5", "prev_momentum5", "rsi14", "rvol20", "sma20")]]


# Messages round exact halves to even, as the values they are compared with do.
def _rules(c: AlertRules) -> list[tuple[str, str, str, str, str, str, str]]:
    """(type, level, feature, value, threshold, condition, message), all SQL."""
    crosses = []
    for fast, slow, kind, level in ((9, 20, "", "MEDIUM"), (20, 50, "TREND_", "HIGH")):
        f, s = f"ema{fast}", f"ema{slow}"
        for name, now, before, side in (("BULLISH", ">", "<=", "above"), ("BEARISH", "<", ">=", "below")):
            crosses.append((f"{name}_{kind}EMA_CROSS", f"'{level}'", f"{f}_vs_{s}", f, s,
                            f"{f} {now} {s} and prev_{f} {before} prev_{s}",
                            f"concat(symbol, ' EMA{fast} crossed {side} EMA{slow}')"))
    spikes = [
        (f"{name}_SPIKE", "'HIGH'", x, x, f"{base} * {c.spike_multiplier}d",
         f"{base} > 0 and {x} > {base} * {c.spike_multiplier}d",
         f"format_string('%s {label}={fmt} exceeded %.1fx baseline', symbol, bround({x}, {digits}), {c.spike_multiplier}d)")
        for name, x, base, label, fmt, digits in (("ATR", "atr14", "avg_atr50", "ATR14", "%.4f", 4),
                                                  ("VOLATILITY", "volatility20", "avg_volatility50", "volatility20", "%.6f", 6))]
    strong = f"close > 0 and abs(momentum5) >= greatest(close * {c.momentum_min_pct}d, coalesce(atr14, 0.0d))"
    turns = [(f"{name}_MOMENTUM_REVERSAL", "'MEDIUM'", "momentum5", "momentum5", "prev_momentum5",
              f"{turn} and {strong}", f"concat(symbol, ' 5-minute momentum reversed {side} strongly')")
             for name, turn, side in (("BULLISH", "prev_momentum5 < 0 and momentum5 > 0", "upward"),
                                      ("BEARISH", "prev_momentum5 > 0 and momentum5 < 0", "downward"))]
    bands = [(f"PRICE_{side.upper()}_BOLLINGER_{band.upper()}", "'MEDIUM'", f"close_vs_bb_{band}20", "close",
              f"bb_{band}20", f"close {op} bb_{band}20",
              f"format_string('%s close=%.4f crossed {side} Bollinger {band} band=%.4f', symbol, bround(close, 4), bround(bb_{band}20, 4))")
             for side, band, op in (("above", "upper", ">"), ("below", "lower", "<"))]
    rsi = [(f"RSI_{name}", "'MEDIUM'", "rsi14", "rsi14", f"{cut}d", f"rsi14 {op} {cut}d",
            f"format_string('%s RSI14=%.2f {op} %.2f: {name.lower()}', symbol, bround(rsi14, 2), {cut}d)")
           for name, op, cut in (("OVERBOUGHT", ">", c.rsi_overbought), ("OVERSOLD", "<", c.rsi_oversold))]
    volume = [("VOLUME_SPIKE", f"if(rvol20 > {c.rvol_extreme}d, 'HIGH', 'MEDIUM')", "rvol20", "rvol20",
               f"{c.rvol_spike}d", f"rvol20 > {c.rvol_spike}d",
               "format_string('%s volume is %.2fx the 20-minute average', symbol, bround(rvol20, 2))")]
    return rsi + volume + bands + crosses + spikes + turns


def alerts(rows: DataFrame, rules: AlertRules = AlertRules(), batch_id: int = 0, ts: str = "ts") -> DataFrame:
    """0 to 13 alerts per row, as rows of the alert schema without the write time."""
    docs = [f"'{name}', cast({col} as double)" for name, col in _META]
    tail = [f"'source_batch_id', {batch_id}L", f"'timeframe', '{rules.timeframe}'",
            "'volatility20', volatility20"]
    meta = f"to_json(named_struct({', '.join(docs + tail)}), map('ignoreNullFields', 'false'))"
    found = [f"if({cond}, named_struct('alert_type', '{kind}', 'alert_level', {level}, 'feature_name', '{feature}', "
             f"'feature_value', cast({value} as double), 'threshold_value', cast({limit} as double), "
             f"'message', {message}), null)"
             for kind, level, feature, value, limit, cond, message in _rules(rules)]
    hits = f"filter(array({', '.join(found)}), a -> a is not null)"
    # The document is only built for rows that raise an alert.
    return (rows.selectExpr("*", f"{hits} as _hits").where("size(_hits) > 0")
            .selectExpr("symbol", f"{ts} as event_time", f"{meta} as metadata", "inline(_hits)")
            .selectExpr("symbol", "event_time", "alert_type", "alert_level", "feature_name", "feature_value",
                        "threshold_value", "message", "metadata", f"{batch_id}L as source_batch_id"))


def stamped(found: DataFrame, now=None) -> DataFrame:
    when = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return found.withColumn("process_date", when).select(*ALERTS.fieldNames())
