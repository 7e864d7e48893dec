"""Observability of tables and streams: health, freshness, lag, incidents, drift, offsets, readiness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# fixed values: candidate names of time and symbol columns, best first
TIME_COLUMNS = ("ts", "Datetime", "timestamp", "event_time", "process_time", "day", "process_date", "created_at")
SYMBOL_COLUMNS = ("symbol", "Symbol", "indicator")


def _first(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def _lag_minutes(now: Column, then: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.round((micros(now) - micros(then)) / 6e7, 2)


def table_health(tables: Mapping[str, DataFrame], now: DataFrame) -> DataFrame:
    """One row per table: latest time, row count, lag to the given time. One aggregate per table, united."""
    out = None
    for name, df in tables.items():
        time = _first(df, TIME_COLUMNS)
        latest = F.max(F.col(time).cast("timestamp_ntz")) if time else F.lit(None).cast("timestamp_ntz")
        one = df.agg(F.lit(name).alias("table_name"), latest.alias("latest_time"), F.count(F.lit(1)).alias("row_count"))
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(now)).select(
        "table_name", "latest_time", "row_count", _lag_minutes(F.col("now"), F.col("latest_time")).alias("lag_minutes"),
        F.when(F.col("latest_time").isNull(), "error").otherwise("ok").alias("status"))


def symbol_freshness(tables: Mapping[str, DataFrame], now: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        key, time = _first(df, SYMBOL_COLUMNS), _first(df, TIME_COLUMNS)
        one = df.groupBy(F.col(key).alias("symbol")).agg(F.max(F.col(time).cast("timestamp_ntz")).alias("latest_time"))
        one = one.select(F.lit(name).alias("table_name"), "symbol", "latest_time")
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(now)).select(
        "table_name", "symbol", "latest_time", _lag_minutes(F.col("now"), F.col("latest_time")).alias("lag_minutes"))


def recent_alerts(alerts: DataFrame, now: DataFrame, lookback_minutes: int, symbols: Sequence[str] = (),
                  levels: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Newest alerts inside the look-back."""
    rows = alerts
    if symbols:
        rows = rows.where(F.col("symbol").isin([s for s in symbols]))
    if levels:
        rows = rows.where(F.col("alert_level").isin(list(levels)))
    rows = rows.join(F.broadcast(now), F.col("event_time") >= F.col("now") - F.expr(f"interval {lookback_minutes} minutes"))
    newest = rows.drop("now").orderBy(F.desc("event_time"), "symbol", "alert_type")
    return newest if limit is None else newest.limit(limit)


def missing_symbol_incidents(tables: Mapping[str, DataFrame], limit: int | None = None) -> DataFrame:
    """Rows whose symbol is null or blank."""
    out = None
    for name, df in tables.items():
        key, time = _first(df, SYMBOL_COLUMNS), _first(df, TIME_COLUMNS)
        bad = df.where(F.col(key).isNull() | (F.trim(key) == "")).select(
            F.lit(name).alias("table_name"), F.lit("missing_symbol").alias("incident_type"),
            F.lit("Missing or blank symbol detected.").alias("message"), F.col(time).cast("timestamp_ntz").alias("ts"))
        out = bad if out is None else out.unionByName(bad)
    return out.orderBy("table_name", "ts").limit(limit) if limit else out


def feature_drift(stream: DataFrame, batch: DataFrame, features: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Per feature: rows on one side only, largest and mean difference, rows above the tolerance."""
    left = stream.select("symbol", "day", *[F.col(f).alias(f"s_{f}") for f in features]).withColumn("_s", F.lit(True))
    right = batch.select("symbol", "day", *[F.col(f).alias(f"b_{f}") for f in features]).withColumn("_b", F.lit(True))
    long = left.join(right, ["symbol", "day"], "full").select("_s", "_b", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.abs(F.col(f"s_{f}") - F.col(f"b_{f}")).alias("delta")) for f in features])))
    return long.groupBy("feature").agg(
        F.count_if(F.col("_b").isNull()).alias("stream_only"), F.count_if(F.col("_s").isNull()).alias("batch_only"),
        F.max("delta").alias("max_delta"), F.avg("delta").alias("mean_delta"),
        F.count_if(F.col("delta") > tolerance).alias("drifted"))


def offset_report(bronze: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Per topic and partition: first and last offset, rows, duplicates and missing offsets.

    Gaps are counted without ordering a whole topic partition: offsets are unique after a distinct, so the missing ones
    are the range minus the number of distinct offsets; the number of gaps comes from windows over offset blocks and
    the seams between blocks.
    """
    seen = bronze.groupBy("topic", "partition", "offset").agg(F.count(F.lit(1)).alias("_n"))
    seen = seen.withColumn("_blk", F.floor(F.col("offset") / block))
    inside = Window.partitionBy("topic", "partition", "_blk").orderBy("offset")
    rows = seen.withColumn("_gap", F.coalesce(F.col("offset") - F.lag("offset").over(inside) > 1, F.lit(False)))
    blocks = rows.groupBy("topic", "partition", "_blk").agg(
        F.min("offset").alias("lo"), F.max("offset").alias("hi"), F.sum("_n").alias("rows"),
        F.count(F.lit(1)).alias("distinct_offsets"), F.count_if("_gap").alias("gaps"))
    seam = Window.partitionBy("topic", "partition").orderBy("_blk")
    blocks = blocks.withColumn("_seam", F.coalesce((F.col("lo") - F.lag("hi").over(seam) > 1).cast("int"), F.lit(0)))
    return blocks.groupBy("topic", "partition").agg(
        F.min("lo").alias("first_offset"), F.max("hi").alias("last_offset"), F.sum("rows").alias("rows"),
        (F.sum("rows") - F.sum("distinct_offsets")).alias("duplicates"),
        (F.max("hi") - F.min("lo") + 1 - F.sum("distinct_offsets")).alias("missing"),
        (F.sum("gaps") + F.sum("_seam")).alias("gaps"))


def symbol_monitor(freshness: DataFrame, alerts: DataFrame, now: DataFrame, lookback_minutes: int) -> DataFrame:
    """Freshness of each symbol with its number of recent alerts."""
    active = (alerts.join(F.broadcast(now), F.col("event_time") >= F.col("now") - F.expr(f"interval {lookback_minutes} minutes"))
              .groupBy("symbol").agg(F.count(F.lit(1)).alias("active_alerts"), F.max("event_time").alias("last_alert")))
    return freshness.join(active, "symbol", "left").withColumn("active_alerts", F.coalesce("active_alerts", F.lit(0)))


def readiness(sections: DataFrame) -> DataFrame:
    """Per request: ready when every required section succeeded, is fresh and misses no symbol.

    ``sections`` has (request_id, decision_mode, section, status, is_stale, missing).
    """
    required = (F.col("section") == "market_features") | ((F.col("decision_mode") == "portfolio_recommendation")
                                                          & F.col("section").isin("risk_snapshot", "portfolio_snapshot"))
    good = (F.col("status") == "SUCCESS") & ~F.col("is_stale") & (F.col("missing") == 0)
    return sections.groupBy("request_id", "decision_mode").agg(
        F.coalesce(F.min(F.when(required, good)), F.lit(False)).alias("ready"),
        F.count_if(required & ~good).alias("blocking_sections"))
