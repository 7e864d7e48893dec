"""Cleaning rules, counts of rejected rows, history gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BAR_FIELDS = ("open", "high", "low", "close")


def intraday_rules(key: str = "symbol", need_volume: bool = True) -> dict[str, str]:
    """Named conditions a stored intraday row must meet, as SQL. Each is true, false or null; only true passes."""
    rules = {"time": "ts is not null", key: f"length(trim({key})) > 0", "close": "close > 0", "range": "high >= low"}
    if need_volume:
        rules["volume"] = "volume > 0"
    return rules


def eod_rules(as_of: str) -> dict[str, str]:
    return {"day": f"day <= date'{as_of}'", "symbol": "length(trim(symbol)) > 0",
            **{c: f"{c} > 0" for c in BAR_FIELDS}, "range": "high >= low", "volume": "volume >= 0"}


def news_rules() -> dict[str, str]:
    return {"time": "ts is not null", **{c: f"length(trim({c})) > 0" for c in ("symbol", "headline", "url")}}


def _passing(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    for condition in rules.values():
        rows = rows.where(condition)
    return rows


def rejections(rules: dict[str, str]) -> dict[str, Column]:
    """Counts of all rows, rows failing each rule and rows failing any; for ``agg`` or ``observe``."""
    fails = {name: f"not coalesce({c}, false)" for name, c in rules.items()}
    return {"rows": F.count(F.lit(1)), **{f"bad_{n}": F.expr(f"count_if({c})") for n, c in fails.items()},
            "rejected": F.expr(f"count_if({' or '.join(fails.values())})")}


def rejected_counts(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows failing each rule, rows failing any, and all rows, in one pass."""
    return rows.agg(*[c.alias(n) for n, c in rejections(rules).items()])


def _ranges() -> tuple[Column, Column]:
    high, low, close = F.col("high"), F.col("low"), F.col("close")
    return (high - low).alias("daily_range"), F.when(high > low, (close - low) / (high - low)).alias("close_position")


def clean_intraday(rows: DataFrame, key: str = "symbol", need_volume: bool = True, now=None) -> DataFrame:
    """Typed, valid intraday rows with range columns."""
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    typed = rows.select(
        "ts", F.trim(key).alias(key), *[F.expr(f"try_cast({c} as double)").alias(c) for c in BAR_FIELDS],
        F.expr("try_cast(volume as bigint)").alias("volume"),
        *[F.expr(f"try_cast({c} as double)").alias(c) for c in ("dividends", "stock_splits")], "etl_load")
    return _passing(typed, intraday_rules(key, need_volume)).select(
        *[c for c in typed.columns if c != "etl_load"], *_ranges(), "etl_load", stamp.alias("process_date"))


def clean_news(rows: DataFrame, now=None) -> DataFrame:
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    tidy = rows.select(
        "ts", F.trim("symbol").alias("symbol"), "id", F.lower(F.trim("category")).alias("category"),
        F.trim("headline").alias("headline"), F.trim("source").alias("source"),
        F.regexp_replace(F.trim("summary"), r"\s+", " ").alias("summary"), F.trim("url").alias("url"), "event_timestamp",
        "image", "etl_load")
    return _passing(tidy, news_rules()).withColumn("process_date", stamp)


def tidy_eod(rows: DataFrame) -> DataFrame:
    return rows.withColumn("symbol", F.upper(F.trim("symbol")))


def clean_eod(rows: DataFrame, as_of: str, now=None) -> DataFrame:
    return passing_eod(tidy_eod(rows), as_of, now)


def passing_eod(tidy: DataFrame, as_of: str, now=None) -> DataFrame:
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return _passing(tidy, eod_rules(as_of)).select("*", *_ranges(), stamp.alias("process_date"))


def history_gate(bars: DataFrame, symbols: DataFrame, min_days: int = 260) -> DataFrame:
    """Distinct days per wanted symbol: ok, short (a failure) or missing (a warning)."""
    days = bars.groupBy("symbol").agg(F.count_distinct("day").alias("days"))
    status = F.when(F.col("days").isNull(), "missing").when(F.col("days") < min_days, "short").otherwise("ok")
    return symbols.select("symbol").distinct().join(days, "symbol", "left").select(
        "symbol", F.coalesce("days", F.lit(0)).alias("days"), status.alias("status"))


def require_history(gate: DataFrame) -> DataFrame:
    """Raise when no symbol has history or any present one is too short."""
    found = {r["status"]: r["n"] for r in gate.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not found.get("ok", 0) and not found.get("short", 0):
        raise ValueError("no symbol has any history after cleaning")
    if found.get("short", 0):
        raise ValueError(f"{found['short']} symbols have too little history")
    return gate


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"no {what} rows")
    return rows
