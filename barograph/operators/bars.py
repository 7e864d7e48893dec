"""Bars, duplicate removal, alignment and calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from barograph.functions.rolling import series

PRICES = ("open", "high", "low", "close")


def _bar_aggs(order: str | Column, extra_sums: Sequence[str] = ()) -> list[Column]:
    o = F.col(order) if isinstance(order, str) else order
    known = lambda c: F.when(F.col(c).isNotNull(), o)  # noqa: E731 - first/last skip missing prices
    return [F.min_by("open", known("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", known("close")).alias("close"), F.sum("volume").alias("volume"),
            *[F.sum(c).alias(c) for c in extra_sums]]


def latest_version(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Newest load wins per key. A maximum of structs combines on the map side, so a hot key never reaches one task."""
    payload = [c for c in rows.columns if c not in keys]
    rank = F.struct(*[F.col(c) for c in version], *[F.col(c) for c in payload if c not in version])
    return (rows.groupBy(*keys).agg(F.max(rank).alias("_v"))
            .select(*keys, *[F.col(f"_v.{c}").alias(c) for c in payload]).select(*rows.columns))


def daily_bars(rows: DataFrame, key: str = "symbol", ts: str = "ts", order: str | None = None,
               extra_sums: Sequence[str] = ()) -> DataFrame:
    """One OHLCV row per key and day; days with a missing price are left out. Ticks are combined before the shuffle."""
    bars = rows.groupBy(key, F.to_date(ts).alias("day")).agg(*_bar_aggs(order or ts, extra_sums))
    return bars.dropna(subset=list(PRICES))


def resample(rows: DataFrame, width: str, key: str = "symbol", ts: str = "ts", order: str | None = None,
             extra_sums: Sequence[str] = ()) -> DataFrame:
    """Bars of any width; batch or streaming."""
    bars = rows.groupBy(key, F.window(ts, width).alias("_w")).agg(*_bar_aggs(order or ts, extra_sums))
    return (bars.dropna(subset=list(PRICES))
            .select(key, F.col("_w.start").alias("ts"), *PRICES, "volume", *extra_sums))


def daily_close(rows: DataFrame, ts: str = "ts", close: str = "close") -> DataFrame:
    """Last close of each day for a key-less series."""
    return (rows.where(F.col(close).isNotNull()).groupBy(F.to_date(ts).alias("day"))
            .agg(F.max_by(close, ts).alias("close")))


def align_benchmark(bars: DataFrame, bench: DataFrame, out: str = "bench", key: str = "symbol") -> DataFrame:
    """Benchmark close on each bar's day, carried forward along the symbol's own days.

    The benchmark has one row per calendar day; whether it is broadcast is left to the size statistics.
    """
    joined = bars.join(bench.select("day", F.col("close").alias("_b")), "day", "left")
    w = series(key).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.last("_b", ignorenulls=True).over(w)).drop("_b")


def unpivot_tickers(wide: DataFrame, day: str, tickers: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Wide frame with ``<ticker>_<field>`` columns to one row per ticker and day; incomplete rows are left out."""
    rows = [F.struct(F.lit(t).alias("symbol"), *[F.col(f"`{t}_{f}`").cast("double").alias(f) for f in fields])
            for t in tickers]
    return (wide.select(F.col(day).alias("day"), F.inline(F.array(*rows)))
            .dropna(subset=list(fields)))


def rebalance_days(bars: DataFrame, warmup: int, horizon: int) -> DataFrame:
    """First trading day of each month, after ``warmup`` trading days and with ``horizon`` days left.

    The bars are read once; windows without a key run over the calendar (one row per day), not over bars.
    """
    ordered = Window.orderBy("day")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = bars.select("day").distinct().select(
        "day", F.row_number().over(ordered).alias("rank"), F.count(F.lit(1)).over(whole).alias("n"),
        F.max("day").over(whole).alias("last"))
    at = lambda place: F.coalesce(F.max(F.when(F.col("rank") == place, F.col("day"))).over(whole), F.col("last"))
    bounded = ranked.select("day", at(F.lit(warmup)).alias("first_valid"), at(F.col("n") - horizon).alias("last_valid"))
    months = bounded.groupBy(F.trunc("day", "month").alias("month")).agg(
        F.min("day").alias("rebalance_day"), F.max("first_valid").alias("first_valid"), F.max("last_valid").alias("last_valid"))
    return months.where(F.col("rebalance_day").between(F.col("first_valid"), F.col("last_valid"))).select("month", "rebalance_day")


def as_of(facts: DataFrame, dates: DataFrame, date: str, values: Sequence[str], key: str = "symbol",
          day: str = "day") -> DataFrame:
    """Latest values per key at each date.

    Each fact is valid until the key's next fact. The wanted dates, a calendar, are one row: a map from month to the
    month's dates. A fact looks its own months up, so facts are shuffled by key only, and meet no date outside them.
    """
    w = series(key, day)
    calendar = dates.select(date).where(F.col(date).isNotNull()).distinct()
    months = calendar.groupBy(F.trunc(date, "month").alias("_m")).agg(F.collect_set(date).alias("_d"))
    table = months.agg(F.map_from_entries(F.collect_list(F.struct("_m", "_d"))).alias("_dates"),
                       F.max(F.array_max("_d")).alias("_last"))
    span = (facts.select(key, day, *values, F.lead(day).over(w).alias("_next")).crossJoin(F.broadcast(table))
            .where(F.col(day) <= F.col("_last"))
            .withColumn("_until", F.least("_last", F.coalesce(F.date_sub("_next", 1), F.col("_last")))))
    own = F.sequence(F.trunc(day, "month"), F.trunc("_until", "month"), F.expr("interval 1 month"))
    near = F.flatten(F.filter(F.transform(own, lambda m: F.col("_dates")[m]), lambda d: d.isNotNull()))
    hit = F.filter(near, lambda d: (d >= F.col(day)) & (d <= F.col("_until")))
    return span.where(F.col("_until") >= F.col(day)).select(
        F.explode(hit).alias(date), key, F.col(day).alias("as_of_day"), *values)


def forward_close(bars: DataFrame, horizons: Sequence[int], key: str = "symbol") -> DataFrame:
    """Close ``h`` trading rows later and the return to it, for each horizon."""
    w = series(key)
    out = bars
    for h in horizons:
        later = F.lead("close", h).over(w)
        out = out.withColumn(f"close_{h}d", later)
    for h in horizons:
        out = out.withColumn(f"ret_{h}d", F.try_divide(F.col(f"close_{h}d") - F.col("close"), F.col("close")))
    return out
