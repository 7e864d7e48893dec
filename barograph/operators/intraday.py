"""Intraday indicators: RSI, EMAs, relative volume, ATR, volatility, Bollinger bands, momentum."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barograph.functions.ewm import Ewm, add_ewm
from barograph.functions.rolling import Series, true_range
from barograph.operators.halo import number_rows, own_rows, with_halo

EMA_SPANS = (9, 20, 50)
# Rows of history that can influence a value: 20+50 bars for the volatility baseline; e^-40 of a 50-span EMA is 1000.
LOOKBACK_ROWS = 1024

INDICATORS = ["rsi14", "ema9", "ema20", "ema50", "prev_ema9", "prev_ema20", "prev_ema50", "avg_volume20", "rvol20",
              "atr14", "avg_atr50", "volatility20", "avg_volatility50", "sma20", "std20", "bb_upper20", "bb_lower20",
              "momentum5", "prev_momentum5"]


def indicators(bars: DataFrame, key: str = "symbol", ts: str = "ts", block: int = 8192,
               lookback: int = LOOKBACK_ROWS, slice_unit: str = "day") -> DataFrame:
    """Add all intraday indicators to OHLCV rows of any width (one row per key and time).

    The series is cut into overlapping blocks, so a symbol with most of the rows is spread over many tasks.
    """
    rows = with_halo(number_rows(bars, key, ts, slice_unit), lookback, block)
    keys = [key, "block"]
    w = Series(keys, ts)
    # Inside a block the first rows are halo: a row-number gate of the block would open too early only for them.
    rows = rows.selectExpr("*", f"row_number() over ({w.spec}) as _brn")
    rows = add_ewm(rows, keys, ts, [Ewm.span(f"_ema{n}", "close", n) for n in EMA_SPANS], rn="_brn")
    rows = rows.selectExpr("*", f"{w.lag('close')} as _pc", f"close - {w.lag('close', 5)} as momentum5",
                           *[f"if(rn >= {n}, _ema{n}, null) as ema{n}" for n in EMA_SPANS])
    rows = rows.selectExpr(
        "*", "if(_pc is null, null, greatest(close - _pc, 0.0d)) as _gain",
        "if(_pc is null, null, greatest(_pc - close, 0.0d)) as _loss", f"{true_range('high', 'low', '_pc')} as _tr",
        "try_divide(close, _pc) - 1 as _ret", f"{w.lag('momentum5')} as prev_momentum5",
        *[f"{w.lag(f'ema{n}')} as prev_ema{n}" for n in EMA_SPANS])
    rows = rows.selectExpr("*", *[f"{w.so_far(f'count({x})')} as _n{x}" for x in ("_gain", "_ret")])
    rows = rows.selectExpr(
        "*", f"{w.gated('avg(_gain)', '_n_gain', 14)} as _ag", f"{w.gated('avg(_loss)', '_n_gain', 14)} as _al",
        f"{w.dense('avg(volume)', 20)} as avg_volume20", f"{w.dense('avg(_tr)', 14)} as atr14",
        f"{w.gated('stddev_samp(_ret)', '_n_ret', 20)} as volatility20", f"{w.dense('avg(close)', 20)} as sma20",
        f"{w.dense('stddev_samp(close)', 20)} as std20")
    rows = rows.selectExpr("*", *[f"{w.so_far(f'count({x})')} as _n_{x}" for x in ("atr14", "volatility20")])
    rows = rows.selectExpr(
        "*", f"{w.gated('avg(atr14)', '_n_atr14', 50, 20)} as avg_atr50",
        f"{w.gated('avg(volatility20)', '_n_volatility20', 50, 20)} as avg_volatility50",
        "case when _al = 0 and _ag > 0 then 100.0d when _al = 0 and _ag = 0 then 50.0d "
        "else 100.0d - try_divide(100.0d, 1 + try_divide(_ag, _al)) end as rsi14",
        "try_divide(cast(volume as double), avg_volume20) as rvol20",
        "sma20 + 2 * std20 as bb_upper20", "sma20 - 2 * std20 as bb_lower20")
    return own_rows(rows).select(*bars.columns, *INDICATORS)
