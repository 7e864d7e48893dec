"""The four streaming jobs: landing, cleaning, alerts, daily features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from barograph.config import AlertRules
from barograph.operators import alerts as al, bars, daily_features as df_, intraday, quality as ql
from barograph.operators.feature_state import kept_days, next_states, resumed_rows, thinned
from barograph.schemas import FEATURE_COLUMNS, INDICATOR_JSON, MARKET_JSON, NEWS_JSON
from barograph.session import CONSTRAINTS, materialized
from barograph.sources import decode as dc
from barograph.sources.tables import exists, read_table, table_schema, upsert
from barograph.streaming.lifecycle import Sink, StreamSource, append_stream, lake_sink, open_stream, open_table, to_sinks, without_repeats

_DECODE = {"market": dc.market_messages, "indicator": dc.indicator_messages, "news": dc.news_messages}


def _path(base: str, name: str) -> str:
    return f"{base}/{name.replace('.', '/')}"


def land(spark: SparkSession, source: StreamSource, kind: str, base: str, every: str | None = None,
         quarantine: bool = False) -> StreamingQuery:
    """Topic to bronze.

    With ``quarantine`` every message that is no row goes to the table of dead letters instead of being lost. Both tables
    are then written by batch (a further partition ``batch``), from rows that are parsed once, and a repeated batch replaces
    its own files.
    """
    if not quarantine:
        rows = dc.known_time(_DECODE[kind](open_stream(spark, source)))
        return append_stream(rows, _path(base, f"bronze.{kind}"), f"{base}/checkpoints/land_{kind}", every)
    schema, time = {"market": (MARKET_JSON, "Datetime"), "indicator": (INDICATOR_JSON, "Datetime"), "news": (NEWS_JSON, "datetime")}[kind]
    good, bad = lake_sink(_path(base, f"bronze.{kind}")), lake_sink(_path(base, f"bronze.dead_letters/{kind}"))
    sinks = [lambda rows, k: good(rows.where("fault is null").drop("fault", "payload"), k),
             lambda rows, k: bad(dc.dead_letters(rows, schema, time), k)]
    return to_sinks(_DECODE[kind](open_stream(spark, source), faults=True), sinks, f"{base}/checkpoints/land_{kind}", every)


def clean(spark: SparkSession, kind: str, base: str, every: str | None = "2 minutes",
          repeats_within: str | None = None) -> StreamingQuery:
    """Bronze to silver."""
    rows = open_table(spark, base, f"bronze.{kind}").drop("day")
    if repeats_within:
        rows = without_repeats(rows, repeats_within, ("indicator" if kind == "indicator" else "symbol", "ts"))
    rules = {"market": lambda r: ql.clean_intraday(r), "indicator": lambda r: ql.clean_intraday(r, "indicator"),
             "news": lambda r: ql.clean_news(r).drop("category", "summary")}
    return append_stream(rules[kind](rows), _path(base, f"silver.{kind}"), f"{base}/checkpoints/clean_{kind}", every)


def forward(spark: SparkSession, kind: str, base: str, sinks: Sequence[Sink], name: str, every: str | None = "2 minutes") -> StreamingQuery:
    """Silver rows to further sinks, by batch. Silver itself is the same table whether or not anything follows it."""
    return to_sinks(open_table(spark, base, f"silver.{kind}"), sinks, f"{base}/checkpoints/forward_{kind}_{name}", every)


def _touched_history(batch: DataFrame, silver: DataFrame, lookback: int | None) -> DataFrame:
    """History of the touched symbols up to their newest touched time, with ``lookback`` bars before the first one.

    Days are added, twice as many each time, until every touched symbol has its bars or nothing older is left; each
    count reads two columns of the days in question. Only scalars come to the driver, so the scan skips files by day.
    """
    lo, hi = batch.agg(F.min("ts"), F.max("ts")).first()
    bounded = silver.where((F.col("ts") <= F.lit(hi)) & (F.col("day") <= F.to_date(F.lit(hi))))
    first = batch.groupBy("symbol").agg(F.min("ts").alias("_first"))
    if lookback is not None:
        back, before = 1, bounded.select("symbol", "ts", "day").join(first, "symbol").where(F.col("ts") < F.col("_first"))
        while True:
            start = F.date_sub(F.to_date(F.lit(lo)), back)
            bars_before = before.where(F.col("day") >= start).groupBy("symbol").agg(F.count_distinct("ts").alias("n"))
            short = first.join(bars_before, "symbol", "left").where(F.coalesce("n", F.lit(0)) < lookback).select("symbol")
            if before.where(F.col("day") < start).join(short, "symbol", "left_semi").isEmpty():
                break
            back *= 2
        bounded = bounded.where(F.col("day") >= start)
    return bounded.join(first.select("symbol"), "symbol", "left_semi")


def _batch_session(batch: DataFrame) -> SparkSession:
    """The micro-batch's own session, with the planner setting of ``build_session``."""
    session = batch.sparkSession
    session.conf.set(CONSTRAINTS, "false")
    return session


def alert_batch(base: str, rules: AlertRules = AlertRules(), lookback: int | None = intraday.LOOKBACK_ROWS) -> Sink:
    """Recompute indicators of the touched symbols and replace the alerts of the touched rows.

    The look-back is counted in bars, so a value depends neither on batch boundaries nor on nights and weekends. Stored
    alerts of a touched row that no longer hold, as after a corrected price, go.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = _batch_session(batch)
        keys = batch.where("ts is not null and symbol is not null").select("symbol", "ts").distinct().persist()
        try:
            if keys.isEmpty():
                return
            history = _touched_history(keys, read_table(spark, base, "silver.market"), lookback)
            rows = bars.latest_version(history.select("symbol", "ts", "open", "high", "low", "close", "volume", "process_date"),
                                       ["symbol", "ts"], ["process_date"]).drop("process_date")
            current = intraday.indicators(rows).join(keys, ["symbol", "ts"], "left_semi")
            found = al.stamped(al.alerts(current, rules, batch_id))
            upsert(found, _path(base, "alert.market"), table_schema("alert.market"), ["symbol", "event_time", "alert_type"],
                   cleared=keys.select("symbol", F.col("ts").alias("event_time"), F.to_date("ts").alias("day")))
        finally:
            keys.unpersist()
    return write


def raise_alerts(spark: SparkSession, base: str, every: str | None = None, rules: AlertRules = AlertRules(),
                 lookback: int | None = intraday.LOOKBACK_ROWS) -> StreamingQuery:
    return to_sinks(open_table(spark, base, "silver.market"), [alert_batch(base, rules, lookback)],
                    f"{base}/checkpoints/alerts", every)


def _current_bars(spark: SparkSession, base: str, batch: DataFrame) -> DataFrame:
    """The table of daily bars, with the days of the batch computed anew from silver."""
    path, schema = _path(base, "silver.daily_bars"), table_schema("silver.daily_bars")
    pairs = batch.where("ts is not null and symbol is not null").select("symbol", F.to_date("ts").alias("day")).distinct()
    silver = read_table(spark, base, "silver.market")
    if exists(spark, path):
        silver = silver.join(pairs.select("day").distinct(), "day", "left_semi")
    fresh = bars.daily_bars(silver.drop("day"))
    upsert(fresh.select("day", "symbol", "open", "high", "low", "close", "volume"), path, schema, ["day", "symbol"], cleared=pairs)
    return read_table(spark, base, "silver.daily_bars")


def _resume_points(states: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest state of each symbol before its first day, and (symbol, since): the day from which bars are needed.

    States of the last two months are looked at first; only symbols without one there look further back.
    """
    lowest, highest = first.agg(F.min("first"), F.max("first")).first()
    keys = states.select("symbol", "day").where(F.col("day") < F.lit(highest)).join(first, "symbol").where("day < first")
    newest = lambda rows: rows.groupBy("symbol").agg(F.max("day").alias("day"))
    near = F.col("day") >= F.date_sub(F.lit(lowest), 62)
    found = materialized(newest(keys.where(near)))
    unknown = first.select("symbol").join(found, "symbol", "left_anti")
    if not unknown.isEmpty():
        found = materialized(found.unionByName(newest(keys.where(~near).join(unknown, "symbol", "left_semi"))))
    # A symbol's first row leaves a state, so one without an earlier state has no earlier bars.
    since = first.join(found, "symbol", "left").select("symbol", F.coalesce(F.date_add("day", 1), "first").alias("since"))
    span = found.agg(F.min("day"), F.max("day")).first()
    own = states.where(F.col("day").between(F.lit(span[0]), F.lit(span[1]))).join(found, ["symbol", "day"], "left_semi")
    return own, since


def feature_batch(base: str, benchmark: str | None = "SPY", version: str = "v1") -> Sink:
    """Daily features of the touched (day, symbol) pairs, upserted; symbols go on from their stored states.

    The batch brings the table of daily bars up to date for the days it touches. Each touched symbol then resumes from its
    newest state before its first touched day: for the next day that is one state row and one bar; after a correction of
    an old day the bars since are replayed and later states replaced. Without a table of states all symbols begin anew.
    ``benchmark`` names the symbol that stands for the market; None takes the equal-weight mean of all daily closes. Where
    the batch changes the market on days that symbols have states of, these symbols are replayed, too. A named benchmark
    without any bar is an error, so the meaning of a column never depends on what has arrived.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = _batch_session(batch)
        rows = batch.where("ts is not null and symbol is not null").select("symbol", "ts", F.to_date("ts").alias("day")).persist()
        try:
            if rows.isEmpty():
                return
            daily = _current_bars(spark, base, batch)
            touched = rows.where(F.col("symbol") != (benchmark or ""))
            begun = exists(spark, _path(base, "ml.feature_state"))
            states = read_table(spark, base, "ml.feature_state") if begun else spark.createDataFrame([], table_schema("ml.feature_state"))
            first = touched.groupBy("symbol").agg(F.min("day").alias("first"))
            moved = (rows if benchmark is None else rows.where(F.col("symbol") == benchmark)).agg(F.min("day")).first()[0]
            if begun and moved is not None:
                stale = states.where(F.col("day") >= F.lit(moved)).select("symbol", F.lit(moved).alias("first"))
                first = first.unionByName(stale).groupBy("symbol").agg(F.min("first").alias("first"))
            if begun:
                first = materialized(first)
                if first.isEmpty():
                    return
                own, since = _resume_points(states, first)
                since = materialized(since)
                daily = daily.where(F.col("day") >= F.lit(since.agg(F.min("since")).first()[0]))
            elif touched.isEmpty():
                return
            if benchmark is None:
                market = daily.groupBy("day").agg(F.avg("close").alias("close"))
            else:
                market = daily.where(F.col("symbol") == benchmark).select("day", "close")
                if not begun and market.isEmpty():
                    raise ValueError(f"no bars of the benchmark {benchmark}")
            if begun:
                bars = daily.join(since, "symbol").where("day >= since").drop("since")
                gone = states.join(since, "symbol").where("day >= since").select("symbol", "day")
            else:
                own, bars = states, daily.where(F.col("symbol") != (benchmark or ""))
                gone = None
            series = materialized(resumed_rows(own, bars, market))
            fresh = df_.complete_rows(df_.contract_columns(series.where("new")))
            out = df_.with_vector(df_.touched_only(fresh, touched), version, batch_id).select(
                "day", "symbol", *FEATURE_COLUMNS, "feature_vector", "feature_version", "source_batch_id", "process_date")
            upsert(out, _path(base, "ml.features"), table_schema("ml.features"), ["day", "symbol", "feature_version"])
            # States go last: until then a repeated batch finds the same states to resume from.
            upsert(next_states(series, kept_days(series)), _path(base, "ml.feature_state"), table_schema("ml.feature_state"),
                   ["day", "symbol"], cleared=None if gone is None else materialized(gone))
        finally:
            rows.unpersist()
    return write


def thin_states(spark: SparkSession, base: str, before: str) -> None:
    """Keep one state per symbol and month of the months before a day's; rewrites those days' partitions only."""
    old = read_table(spark, base, "ml.feature_state").where(F.col("day") < F.trunc(F.to_date(F.lit(before)), "month"))
    kept = materialized(thinned(old))
    gone = materialized(old.select("symbol", "day").join(kept.select("symbol", "day"), ["symbol", "day"], "left_anti"))
    if not gone.isEmpty():
        upsert(kept.where(F.lit(False)), _path(base, "ml.feature_state"), table_schema("ml.feature_state"), ["day", "symbol"], cleared=gone)


def build_features(spark: SparkSession, base: str, benchmark: str | None = "SPY", every: str | None = None) -> StreamingQuery:
    return to_sinks(open_table(spark, base, "silver.market"), [feature_batch(base, benchmark)],
                    f"{base}/checkpoints/features", every)
