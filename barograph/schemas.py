"""Declared schemas and the ordered feature contract."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: order of the daily feature vector
FEATURE_COLUMNS = [
    "r1", "r3", "r5", "r10", "r14", "r20", "r21", "cumret_20", "return_z_20", "gap_return", "CLV",
    "EMA20_50_spread", "EMA50_200_spread", "EMA20_slope", "EMA50_slope", "MACD_hist", "RSI14", "ROC10", "ROC20",
    "ADX14", "dist_20d_high", "dist_55d_high", "dist_52w_high", "BB_pctB", "BB_width", "dist_ema20", "dist_ema50",
    "ATR14_ratio", "vol20", "downside_vol20", "maxdd20", "realized_vol_10", "realized_vol_20", "vol_ratio_20_60",
    "true_range_zscore", "RVOL20", "OBV_slope", "MFI14", "dollar_volume_log", "volume_slope_20", "OBV_slope_neg",
    "RS_vs_SPY_14", "RS_vs_SPY_30", "beta_60D", "SPY_above_EMA50", "SPY_20d_return", "sector_percentile_20d",
]
CONTEXT_COLUMNS = ["close", "maxdd90"]


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


_S, _D, _L, _I, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampType()
_PRICE_JSON = (("Datetime", _S), ("Open", _D), ("High", _D), ("Low", _D), ("Close", _D), ("Volume", _L),
               ("Dividends", _D), ("Stock Splits", _D))

# fixed values: fields of the messages
MARKET_JSON = _fields(*_PRICE_JSON, ("Symbol", _S))
INDICATOR_JSON = _fields(*_PRICE_JSON, ("Indicator", _S))
NEWS_JSON = _fields(("category", _S), ("datetime", _L), ("headline", _S), ("id", _L), ("image", _S), ("related", _S),
                    ("source", _S), ("summary", _S), ("url", _S), ("Symbol", _S))

RAW_STREAM = _fields(("value", _S), ("topic", _S), ("partition", _I), ("offset", _L))

_BRONZE_PRICE = (("open", _D), ("high", _D), ("low", _D), ("close", _D), ("volume", _L), ("dividends", _D),
                 ("stock_splits", _D))
_LINEAGE = (("topic", _S), ("partition", _I), ("offset", _L), ("etl_load", _TS))

BRONZE_MARKET = _fields(("ts", _TS), ("symbol", _S), *_BRONZE_PRICE, *_LINEAGE)
BRONZE_INDICATOR = _fields(("ts", _TS), ("indicator", _S), *_BRONZE_PRICE, *_LINEAGE)
BRONZE_NEWS = _fields(("ts", _TS), ("symbol", _S), ("category", _S), ("event_timestamp", _L), ("headline", _S),
                      ("id", _L), ("image", _S), ("related", _S), ("source", _S), ("summary", _S), ("url", _S),
                      *_LINEAGE)
DEAD_LETTERS = _fields(("topic", _S), ("partition", _I), ("offset", _L), ("payload", _S), ("fault", _S), ("field", _S),
                       ("document", T.VariantType()), ("etl_load", _TS), ("day", T.DateType()))
#: One row per source of a micro-batch: where it began and ended, and the newest offsets the source had by then (JSON texts).
PROGRESS = _fields(("query", _S), ("run_id", _S), ("batch_id", _L), ("source", _S), ("start_offset", _S), ("end_offset", _S),
                   ("latest_offset", _S), ("input_rows", _L), ("rows_per_second", _D), ("ts", _TS), ("day", T.DateType()))
SILVER_MARKET = _fields(("ts", _TS), ("symbol", _S), *_BRONZE_PRICE, ("daily_range", _D), ("close_position", _D),
                        ("etl_load", _TS), ("process_date", _TS))
SILVER_INDICATOR = _fields(("ts", _TS), ("indicator", _S), *_BRONZE_PRICE, ("daily_range", _D),
                           ("close_position", _D), ("etl_load", _TS), ("process_date", _TS))
SILVER_NEWS = _fields(("ts", _TS), ("symbol", _S), ("id", _L), ("headline", _S), ("source", _S), ("url", _S),
                      ("event_timestamp", _L), ("image", _S), ("etl_load", _TS), ("process_date", _TS))
EOD_PRICES = _fields(("day", T.DateType()), ("symbol", _S), ("open", _D), ("high", _D), ("low", _D), ("close", _D),
                     ("adj_close", _D), ("volume", _L), ("dividends", _D), ("stock_splits", _D), ("source", _S),
                     ("etl_load", _TS))
ALERTS = _fields(("symbol", _S), ("event_time", _TS), ("alert_type", _S), ("alert_level", _S), ("feature_name", _S),
                 ("feature_value", _D), ("threshold_value", _D), ("message", _S), ("metadata", _S),
                 ("source_batch_id", _L), ("process_date", _TS))
FEATURES = T.StructType([T.StructField("day", T.DateType()), T.StructField("symbol", _S)]
                        + [T.StructField(n, _D) for n in FEATURE_COLUMNS]
                        + [T.StructField("feature_vector", T.ArrayType(_D)), T.StructField("feature_version", _S),
                           T.StructField("source_batch_id", _L), T.StructField("process_date", _TS)])
#: Running values at a row of a symbol's daily series; what all earlier rows mean for later ones.
CARRIED = ("rn", "peak", "obv", "seen", "ema20", "ema50", "ema200", "ema12", "ema26", "avg_gain", "avg_loss", "atr_w", "pdm_w", "mdm_w",
           "bench_ema50", "macd_signal", "ADX14", "dx_gap")
#: State after a day: the last bars, and the running values at the first of them (null if the series begins there).
FEATURE_STATE = T.StructType([
    T.StructField("day", T.DateType()), T.StructField("symbol", _S), T.StructField("rn", _L),
    T.StructField("carry", T.StructType([T.StructField(n, _L if n in ("rn", "seen", "dx_gap") else _D) for n in CARRIED])),
    T.StructField("halo", T.ArrayType(T.StructType([T.StructField("day", T.DateType())] + [
        T.StructField(n, _D) for n in ("high", "low", "close", "volume", "bench")])))])
PREDICTIONS = _fields(("day", T.DateType()), ("symbol", _S), ("model_version", _S), ("entry_price", _D),
                      ("pred_a", _D), ("risk_prob", _D), ("final_score", _D), ("feature_version", _S),
                      ("process_date", _TS))

DAILY_BARS = _fields(("day", T.DateType()), ("symbol", _S), ("open", _D), ("high", _D), ("low", _D), ("close", _D), ("volume", _L))
CURATED_PRICES = _fields(("day", T.DateType()), ("symbol", _S), ("open", _D), ("high", _D), ("low", _D), ("close", _D),
                         ("adj_close", _D), ("volume", _L), ("dividends", _D), ("stock_splits", _D), ("daily_range", _D),
                         ("close_position", _D), ("source", _S), ("etl_load", _TS), ("process_date", _TS))
SENTIMENT = _fields(("as_of_date", T.DateType()), ("symbol", _S), ("sentiment_score", _D), ("sentiment_label", _S),
                    ("article_count", _I), ("latest_article_published_at", _TS), ("oldest_article_published_at", _TS),
                    ("sentiment_scored_at", _TS), ("stale_article_count", _I), ("top_drivers", T.ArrayType(_S)),
                    ("source_refs", T.ArrayType(_S)), ("process_date", _TS))
VALUATION = _fields(("as_of_date", T.DateType()), ("symbol", _S), ("valuation_label", _S), ("pe_ratio", _D),
                    ("sector_pe_ratio", _D), ("fair_value_estimate", _D), ("upside_downside_pct", _D),
                    ("valuation_method", _S), ("valuation_quality", _S), ("valuation_fetched_at", _TS),
                    ("fundamentals_as_of", T.DateType()), ("sector_sample_count", _I), ("analyst_count", _D),
                    ("source_refs", T.ArrayType(_S)), ("process_date", _TS))

# One registry for every table: columns and partition column, so readers and writers agree on names.
TABLES: dict[str, tuple[T.StructType, list[str]]] = {
    "bronze.market": (BRONZE_MARKET, ["day"]),
    "bronze.indicator": (BRONZE_INDICATOR, ["day"]),
    "bronze.news": (BRONZE_NEWS, ["day"]),
    "bronze.dead_letters": (DEAD_LETTERS, ["day"]),
    "ops.progress": (PROGRESS, ["day"]),
    "silver.market": (SILVER_MARKET, ["day"]),
    "silver.daily_bars": (DAILY_BARS, ["day"]),
    "silver.indicator": (SILVER_INDICATOR, ["day"]),
    "silver.news": (SILVER_NEWS, ["day"]),
    "eod.prices": (EOD_PRICES, ["day"]),
    "eod.curated": (CURATED_PRICES, ["day"]),
    "ml.features": (FEATURES, ["day"]),
    "ml.feature_state": (FEATURE_STATE, ["day"]),
    "ml.predictions": (PREDICTIONS, ["day"]),
    "ml.sentiment": (SENTIMENT, ["as_of_date"]),
    "ml.valuation": (VALUATION, ["as_of_date"]),
    "alert.market": (ALERTS, ["day"]),
}
