"""The daily feature contract: 47 columns per symbol and day from OHLCV bars and a benchmark series.

A symbol has at most one bar per calendar day (ticks are aggregated first), so windows per symbol are bounded by the
calendar. All steps share one hash partitioning on the symbol: one shuffle for the whole contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barograph.functions.ewm import Ewm, add_ewm
from barograph.functions.rolling import Series, true_range
from barograph.operators.bars import align_benchmark
from barograph.schemas import FEATURE_COLUMNS

RETURNS = (1, 3, 5, 10, 14, 20, 21)


def price_features(bars: DataFrame, bench: DataFrame, *, drop_incomplete: bool = True, adjust: bool = True,
                   key: str = "symbol") -> DataFrame:
    """(day, symbol, close, 47 features, maxdd90). ``adjust`` picks the weighting of the trend EMAs."""
    rows = align_benchmark(bars.select(key, "day", "high", "low", "close", F.col("volume").cast("double")
                                       .alias("volume")), bench, "bench", key)
    out = contract_columns(indicator_rows(rows, adjust=adjust, key=key), key)
    return complete_rows(out) if drop_incomplete else out


def indicator_rows(rows: DataFrame, *, adjust: bool = True, key: str = "symbol", resumed: bool = False) -> DataFrame:
    """All indicators from (symbol, day, high, low, close, volume, bench). ``resumed`` rows begin in the middle of a series.

    Their first row per symbol has the running values up to it in columns ``c_…`` (see ``operators.feature_state``).
    """
    w = Series([key], "day")
    count = (["row_number() over ({}) as pos".format(w.spec), f"{w.so_far('sum(coalesce(c_rn, 1))')} as rn"] if resumed else
             [f"row_number() over ({w.spec}) as rn"])
    pos, highest = ("pos", "greatest(close, c_peak)") if resumed else ("rn", "close")

    def begun(name: str, **more: str) -> dict[str, str]:
        return {"start": f"c_{name}", **more} if resumed else {}

    rows = rows.selectExpr(
        "*", *count, f"{w.lag('close')} as pc", f"high - {w.lag('high')} as up",
        f"{w.lag('low')} - low as down", f"{w.so_far(f'max({highest})')} as peak", "(high + low + close) / 3 as typical",
        "try_divide(close, bench) as rs", f"{w.change('bench', 1)} as rb", f"{w.change('bench', 20)} as SPY_20d_return",
        f"(volume - {w.lag('volume', 5)}) / 5 as volume_slope_20",
        *[f"{w.change('close', k)} as r{k}" for k in RETURNS])
    rows = rows.selectExpr(
        "*", "if(up > down and up > 0, up, 0.0d) as pdm", f"{true_range('high', 'low', 'pc')} as tr",
        "if(pc is null, null, greatest(close - pc, 0.0d)) as gain",
        "if(pc is null, null, greatest(pc - close, 0.0d)) as loss", f"{w.lag('typical')} as ptyp",
        "coalesce(signum(close - pc), 0.0d) * coalesce(volume, 0.0d) as signed_volume",
        "if(r1 < 0, r1, 0.0d) as down_ret", "try_divide(close - peak, peak) as dd",
        *[f"{w.so_far(f'count({x})')} as n_{n}" for n, x in (
            ("r1", "r1"), ("r20", "r20"), ("rb", "rb"), ("pair", "r1 + rb"))])
    # The downward move is compared with the upward move after its own filter.
    rows = rows.selectExpr("*", "if(down > pdm and down > 0, down, 0.0d) as mdm", f"{w.so_far('count(dd)')} as n_dd",
                           f"{w.so_far('sum(coalesce(c_obv, signed_volume))' if resumed else 'sum(signed_volume)')} as obv",
                           "if(typical > ptyp, typical * volume, 0.0d) as inflow_1",
                           "if(typical < ptyp, typical * volume, 0.0d) as outflow_1")

    rows = add_ewm(rows, [key], "day", [
        *[Ewm.span(f"ema{n}", "close", n, adjust, **begun(f"ema{n}", start_seen="c_rn")) for n in (20, 50, 200)],
        *[Ewm.span(f"ema{n}", "close", n, **begun(f"ema{n}")) for n in (12, 26)],
        Ewm("avg_gain", "gain", 1 / 14, dense=False, **begun("avg_gain")), Ewm("avg_loss", "loss", 1 / 14, dense=False, **begun("avg_loss")),
        *[Ewm(name, x, 1 / 14, **begun(name)) for name, x in (("atr_w", "tr"), ("pdm_w", "pdm"), ("mdm_w", "mdm"))],
        Ewm.span("bench_ema50", "bench", 50, True, dense=False, **begun("bench_ema50", start_seen="c_seen"))], rn=pos, total="rn")
    rows = rows.selectExpr("*", "ema12 - ema26 as macd", "100 * try_divide(pdm_w, atr_w) as plus_di",
                           "100 * try_divide(mdm_w, atr_w) as minus_di")
    rows = rows.selectExpr("*", "100 * try_divide(abs(plus_di - minus_di), plus_di + minus_di) as dx")
    rows = add_ewm(rows, [key], "day", [Ewm.span("macd_signal", "macd", 9, **begun("macd_signal")),
                                        Ewm("ADX14", "dx", 1 / 14, dense=False, **begun("ADX14", start_gap="c_dx_gap"))], rn=pos)

    # Long extremes are widened from short ones, so no frame is longer than 60 rows.
    rows = rows.selectExpr(
        "*", f"{w.gated('avg(r20)', 'n_r20', 20)} as r20_mean", f"{w.gated('stddev_samp(r20)', 'n_r20', 20)} as r20_std",
        f"{w.dense('max(high)', 20)} as high20", f"{w.dense('avg(close)', 20)} as mean20",
        f"{w.dense('stddev_samp(close)', 20)} as std20", f"try_divide({w.dense('avg(tr)', 14)}, close) as ATR14_ratio",
        *[f"{w.gated('stddev_samp(r1)', 'n_r1', n)} as sd{n}" for n in (10, 20, 60)],
        f"{w.dense('stddev_samp(down_ret)', 20)} as downside_vol20", f"{w.frame('min(dd)', 20)} as dd20",
        f"{w.dense('avg(volume)', 20)} as mean_volume20", f"{w.dense('sum(inflow_1)', 14)} as inflow",
        f"{w.dense('sum(outflow_1)', 14)} as outflow", f"(obv - {w.lag('obv', 5)}) / 5 as OBV_slope",
        f"{w.change('rs', 14)} as RS_vs_SPY_14", f"{w.change('rs', 30)} as RS_vs_SPY_30",
        f"{w.gated('covar_samp(r1, rb)', 'n_pair', 60)} as cov60", f"{w.gated('var_samp(rb)', 'n_rb', 60)} as var60",
        f"(ema20 - {w.lag('ema20', 5)}) / 5 as EMA20_slope", f"(ema50 - {w.lag('ema50', 5)}) / 5 as EMA50_slope")
    rows = rows.selectExpr(
        "*", f"{w.widened('greatest', 'high20', (0, 20, 35), 'rn >= 55')} as high55",
        f"if({w.full('n_dd', 20)}, -dd20, null) as maxdd20",
        f"-{w.widened('least', 'dd20', (0, 20, 40, 60, 70), w.full('n_dd', 90))} as maxdd90",
        f"{w.so_far('count(ATR14_ratio)')} as n_atr")
    return rows.selectExpr(
        "*", f"{w.widened('greatest', 'high55', (0, 55, 110, 165, 197), 'rn >= 252')} as high252",
        f"{w.gated('avg(ATR14_ratio)', 'n_atr', 20)} as atr_mean20",
        f"{w.gated('stddev_samp(ATR14_ratio)', 'n_atr', 20)} as atr_std20")


def contract_columns(rows: DataFrame, key: str = "symbol") -> DataFrame:
    """The feature contract from indicator rows."""
    derived = {
        "cumret_20": "r20", "return_z_20": "try_divide(r20 - r20_mean, r20_std)", "gap_return": "r1",
        "CLV": "try_divide(close - low, high - low) - 0.5d", "EMA20_50_spread": "try_divide(ema20 - ema50, close)",
        "EMA50_200_spread": "try_divide(ema50 - ema200, close)", "MACD_hist": "macd - macd_signal",
        "RSI14": "100.0d - try_divide(100.0d, 1 + try_divide(avg_gain, avg_loss))", "ROC10": "r10 * 100",
        "ROC20": "r20 * 100", "dist_20d_high": "try_divide(high20 - close, close)",
        "dist_55d_high": "try_divide(high55 - close, close)", "dist_52w_high": "try_divide(high252 - close, close)",
        "BB_pctB": "try_divide(close - (mean20 - 2 * std20), 4 * std20)", "BB_width": "try_divide(4 * std20, close)",
        "dist_ema20": "try_divide(close - ema20, close)", "dist_ema50": "try_divide(close - ema50, close)",
        "vol20": "sd20", "realized_vol_10": "sd10", "realized_vol_20": "sd20",
        "vol_ratio_20_60": "try_divide(sd20, sd60)",
        "true_range_zscore": "try_divide(ATR14_ratio - atr_mean20, atr_std20)",
        "RVOL20": "try_divide(volume, mean_volume20)",
        "MFI14": "100.0d - try_divide(100.0d, 1 + try_divide(inflow, outflow))",
        "dollar_volume_log": "ln(if(close * volume = 0, 1.0d, close * volume))",
        "OBV_slope_neg": "if(OBV_slope < 0, 1.0d, 0.0d)", "beta_60D": "try_divide(cov60, var60)",
        "SPY_above_EMA50": "if(bench > bench_ema50, 1.0d, 0.0d)", "sector_percentile_20d": "0.5d",
    }
    return rows.selectExpr("day", key, "close", *[f"{derived.get(n, n)} as {n}" for n in FEATURE_COLUMNS], "maxdd90")


def complete_rows(features: DataFrame) -> DataFrame:
    return features.dropna(subset=FEATURE_COLUMNS)


def with_vector(features: DataFrame, version: str, batch_id: int, now=None) -> DataFrame:
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return features.select(
        "*", F.array(*[F.col(n).cast("double") for n in FEATURE_COLUMNS]).alias("feature_vector"),
        F.lit(version).alias("feature_version"), F.lit(batch_id).cast("bigint").alias("source_batch_id"),
        stamp.alias("process_date"))


def touched_only(features: DataFrame, touched: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows whose (day, symbol) appears in the new data; the rest was history for the windows."""
    keys = touched.dropna(subset=["ts", key]).select(key, F.to_date("ts").alias("day")).distinct()
    return features.join(keys, [key, "day"], "left_semi")


def on_target_day(features: DataFrame, target: str) -> DataFrame:
    """Rows of the target day or, when it has none, of the latest earlier day."""
    day = F.to_date(F.lit(target))
    pick = features.where(F.col("day") <= day).agg(F.max("day").alias("_pick"))
    return features.join(pick, F.col("day") == F.col("_pick")).drop("_pick")


def check_contract(df: DataFrame) -> DataFrame:
    missing = [n for n in FEATURE_COLUMNS if n not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    order = [c for c in df.columns if c in FEATURE_COLUMNS]
    if order != FEATURE_COLUMNS:
        raise ValueError("feature columns are not in contract order")
    return df
