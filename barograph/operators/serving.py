"""Serving queries: latest state, screens, comparisons, searches, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from barograph.config import INDICATOR_NAMES, TradeRules


def at_latest_day(rows: DataFrame, as_of: str | None = None, day: str = "day") -> DataFrame:
    """Rows of the newest day, not after ``as_of``. The day is a one-row aggregate inside the same plan."""
    if as_of:
        rows = rows.where(F.col(day) <= F.to_date(F.lit(as_of)))
    newest = rows.agg(F.max(day).alias("_newest"))
    return rows.join(F.broadcast(newest), F.col(day) == F.col("_newest")).drop("_newest")


def latest_per_key(rows: DataFrame, key: str = "symbol", order: Sequence[str] = ("day",)) -> DataFrame:
    """Newest row per key by aggregation: combined on the map side, no sort of whole groups."""
    rest = [c for c in rows.columns if c != key]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def advisory_context(predictions: DataFrame, features: DataFrame, prices: DataFrame, as_of: str | None = None,
                     optional: Sequence[DataFrame] = ()) -> DataFrame:
    """Scores of the newest day with features (three keys), prices (two keys) and any latest-per-symbol context."""
    out = (at_latest_day(predictions, as_of).join(features, ["symbol", "day", "feature_version"], "left")
           .join(prices.select("symbol", "day", "close"), ["symbol", "day"], "left"))
    for extra in optional:
        out = out.join(extra, "symbol", "left")
    return out


def valid_latest(rows: DataFrame, times: Sequence[str]) -> DataFrame:
    """Newest row per symbol with a positive close; ties in one time are decided by the next."""
    epoch = F.lit("0001-01-01").cast("timestamp")
    keyed = rows.where(F.col("close") > 0).withColumn("symbol", F.upper(F.trim("symbol")))
    rest = [c for c in keyed.columns if c != "symbol"]
    best = keyed.groupBy("symbol").agg(
        F.max_by(F.struct(*rest), F.struct(*[F.coalesce(F.col(t).cast("timestamp"), epoch) for t in times])).alias("_r"))
    return best.select("symbol", *[F.col(f"_r.{c}").alias(c) for c in rest])


def request_status(wanted: DataFrame, context: DataFrame, max_age_seconds: int) -> DataFrame:
    """Per request: found and missing symbols, status and staleness of the freshest row.

    ``wanted`` has (request_id, as_of, symbol); ``context`` has (symbol, updated_at).
    """
    hit = F.col("updated_at").isNotNull()
    joined = wanted.join(context.select("symbol", "updated_at"), "symbol", "left")
    agg = joined.groupBy("request_id", "as_of").agg(
        F.count_if(hit).alias("found"), F.count_if(~hit).alias("missing"),
        F.coalesce(F.max("updated_at"), F.col("as_of")).alias("last_updated"))
    status = F.when(F.col("found") == 0, "UNAVAILABLE").when(F.col("missing") > 0, "PARTIAL").otherwise("SUCCESS")
    age = F.unix_timestamp("as_of") - F.unix_timestamp("last_updated")
    return agg.select("request_id", "found", "missing", status.alias("status"), "last_updated",
                      (age > max_age_seconds).alias("is_stale"))


def screen(predictions: DataFrame, n: int = 10) -> DataFrame:
    """Best scores of the newest day: a top-k sort with its rank, not a window over one partition."""
    top = at_latest_day(predictions).orderBy(F.col("final_score").desc_nulls_last(), "symbol").limit(n)
    return top


def enrich(rows: DataFrame, prices: DataFrame, features: DataFrame,
           columns: Sequence[str] = ("r1", "r3", "r5", "RSI14", "RVOL20", "ATR14_ratio")) -> DataFrame:
    """Add the latest price and the latest features of each symbol."""
    have = [c for c in columns if c in features.columns]
    price = latest_per_key(prices.select("symbol", "day", "close")).select("symbol", F.col("close").alias("latest_price"))
    newest = latest_per_key(features.select("symbol", "day", *have)).drop("day")
    return rows.join(price, "symbol", "left").join(newest, "symbol", "left")


def row_warnings(symbol: str = "symbol", as_of: str = "day", price: str = "latest_price", score: str = "final_score") -> Column:
    checks = [(F.coalesce(F.col(symbol), F.lit("")) == "", "missing symbol"), (F.col(as_of).isNull(), "missing as_of"),
              (F.col(price).isNull(), "missing latest_price"), (F.col(score).isNull(), "missing final_score")]
    return F.filter(F.array(*[F.when(bad, text) for bad, text in checks]), lambda w: w.isNotNull())


def comparison(rows: DataFrame, group: str) -> DataFrame:
    """Rank within a request's list by score; a missing score counts as zero. Adds warnings and status."""
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy(F.coalesce("final_score", F.lit(0.0)).desc(), "symbol")
    return (rows.withColumn("rank", F.row_number().over(order)).withColumn("warnings", row_warnings())
            .withColumn("status", F.when(F.size("warnings") > 0, "warning").otherwise("ok")))


def first_existing(df: DataFrame, *names: str) -> Column:
    """First of the candidate columns that exists, else null."""
    lower = {c.lower(): c for c in df.columns}
    for name in names:
        if name.lower() in lower:
            return F.col(f"`{lower[name.lower()]}`")
    return F.lit(None)


def picks(frame: DataFrame, rules: TradeRules = TradeRules(), limit: int | None = None) -> DataFrame:
    """Stock picks from tables of varying column names: risk as percent, score filled, thresholds, best first."""
    num = lambda c: c.cast("double")
    rows = frame.select(
        first_existing(frame, "date", "datetime", "day").cast("date").alias("date"),
        first_existing(frame, "ticker", "symbol").cast("string").alias("ticker"),
        num(first_existing(frame, "entry_price", "close")).alias("entry_price"),
        num(first_existing(frame, "pred_a")).alias("pred_a"),
        num(first_existing(frame, "Risk_Prob_%", "risk_prob", "RiskProb")).alias("_risk"),
        num(first_existing(frame, "FinalScore", "final_score")).alias("_score"))
    facts = rows.agg((F.coalesce(F.max("_risk"), F.lit(0.0)) <= 1).alias("_fraction"),
                     (F.count("_score") == 0).alias("_no_score"))
    rows = rows.crossJoin(F.broadcast(facts)).withColumn(
        "risk_prob_pct", F.when(F.col("_fraction"), F.col("_risk") * 100).otherwise(F.col("_risk")))
    rows = rows.withColumn("final_score", F.when(F.col("_no_score"), F.col("pred_a") * (1 - F.col("risk_prob_pct") / 100))
                           .otherwise(F.col("_score")))
    keep = rows.select("date", "ticker", "entry_price", "pred_a", "risk_prob_pct", "final_score").dropna(
        subset=["date", "ticker", "pred_a", "risk_prob_pct", "final_score"])
    best = (keep.where((F.col("pred_a") >= rules.min_pred_a) & (F.col("risk_prob_pct") <= rules.max_risk * 100))
            .orderBy(F.desc("date"), F.desc("final_score"), "ticker"))
    return _first(best, limit)


def picks_summary(rows: DataFrame, min_score: float = 0.0, max_risk_pct: float = 100.0) -> DataFrame:
    kept = rows.where((F.col("final_score") >= min_score) & (F.coalesce("risk_prob_pct", F.lit(0.0)) <= max_risk_pct))
    return kept.agg(F.count(F.lit(1)).alias("signals"), F.max("final_score").alias("best_score"),
                    (F.avg("pred_a") * 100).alias("mean_upside_pct"))


def market_overview(rows: DataFrame, key: str = "indicator", limit: int | None = None) -> DataFrame:
    """Latest value per indicator against the last value of an earlier day.

    Daily last values are taken first (map-side combine), so the step to the previous day sees one row per day.
    """
    daily = rows.groupBy(key, F.to_date("ts").alias("_d")).agg(
        F.max("ts").alias("latest_time"), F.max_by(F.struct("close", "volume"), "ts").alias("_v"))
    two = daily.groupBy(key).agg(F.max_by(F.struct("_d", "latest_time", "_v"), "_d").alias("_l"))
    prev = (daily.join(two.select(key, F.col("_l._d").alias("_last")), key).where(F.col("_d") < F.col("_last"))
            .groupBy(key).agg(F.max_by("_v.close", "_d").alias("previous_close")))
    out = two.join(prev, key, "left").select(
        key, F.col("_l.latest_time").alias("latest_time"), F.col("_l._v.close").alias("close"), "previous_close",
        (F.col("_l._v.close") - F.col("previous_close")).alias("change_value"),
        (F.try_divide(F.col("_l._v.close") - F.col("previous_close"), "previous_close") * 100).alias("change_pct"),
        F.col("_l._v.volume").alias("volume")).orderBy(key)
    return out.limit(limit) if limit else out


def latest_market(rows: DataFrame) -> DataFrame:
    """Latest bar per symbol with its change since the open."""
    newest = latest_per_key(rows.select("symbol", "ts", "open", "high", "low", "close", "volume"), order=("ts",))
    return newest.withColumn("day_change_pct", F.try_divide(F.col("close") - F.col("open"), "open") * 100)


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    """A page where the caller shows one; all rows otherwise."""
    return rows if limit is None else rows.limit(limit)


def symbol_list(rows: DataFrame, limit: int | None = None) -> DataFrame:
    return _first(rows.where(F.col("symbol").isNotNull()).select("symbol").distinct().orderBy("symbol"), limit)


def symbol_history(rows: DataFrame, symbol: str, start: str, limit: int | None = None) -> DataFrame:
    return _first(rows.where((F.col("symbol") == symbol) & (F.col("ts") >= F.lit(start).cast("timestamp"))).orderBy("ts"), limit)


def news_search(rows: DataFrame, symbol: str | None = None, text: str = "", limit: int | None = None, by_id: bool = False) -> DataFrame:
    """Newest version per story, newest first. ``by_id`` orders by story number instead."""
    if symbol and symbol != "All":
        rows = rows.where(F.col("symbol") == symbol)
    if text:
        rows = rows.where(F.lower("headline").contains(text.lower()))
    newest = latest_per_key(rows, "id", ("event_timestamp", "ts"))
    return _first(newest.orderBy(*(["id"] if by_id else [F.desc("ts"), "id"])), limit)


def alert_search(rows: DataFrame, symbols: Sequence[str] = (), types: Sequence[str] = (), levels: Sequence[str] = (),
                 start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Half-open time bounds on the stored column, so files and partitions can be skipped."""
    for column, wanted in (("symbol", symbols), ("alert_type", types), ("alert_level", levels)):
        if wanted:
            rows = rows.where(F.col(column).isin(list(wanted)))
    if start:
        rows = rows.where(F.col("event_time") >= F.lit(start).cast("timestamp"))
    if end:
        rows = rows.where(F.col("event_time") < F.date_add(F.to_date(F.lit(end)), 1).cast("timestamp"))
    return _first(rows.orderBy(F.desc("event_time"), "symbol", "alert_type"), limit)


def alert_facets(rows: DataFrame) -> DataFrame:
    """Sorted distinct values per facet; the three sets are small vocabularies."""
    seen = rows.select("symbol", "alert_type", "alert_level").distinct()
    return seen.agg(*[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("symbol", "alert_type", "alert_level")])


def page(rows: DataFrame, number: int, size: int, sort: str, descending: bool = False, contains: str = "",
         tie: str = "symbol") -> DataFrame:
    if contains:
        rows = rows.where(F.lower("symbol").contains(contains.lower()))
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return rows.orderBy(order, tie).offset((number - 1) * size).limit(size)


def display_name(code: str) -> Column:
    """Indicator code to a readable name: known names, else cleaned and capitalised."""
    known = F.create_map(*[F.lit(x) for pair in INDICATOR_NAMES.items() for x in pair])
    c = F.trim(code)
    clean = F.replace(F.replace(F.ltrim(c, F.lit("^")), F.lit("-USD"), F.lit("")), F.lit("=F"), F.lit(""))
    clean = F.initcap(F.translate(clean, "_-", "  "))
    return F.when(c.isNull() | (c == "") | (F.lower(c) == "nan"), "N/A").otherwise(F.coalesce(F.element_at(known, c), clean))


def diagnostics(rows: DataFrame, name: str, time: str = "day") -> DataFrame:
    """One row: columns, row count, latest time, status and warnings."""
    have = time in rows.columns
    latest = F.max(time).cast("string") if have else F.lit(None).cast("string")
    out = rows.agg(F.count(F.lit(1)).alias("row_count"), latest.alias("latest"))
    text = f"{name} has no {time} values" if have else f"{name} missing {time} column"
    bad = F.col("latest").isNull()
    return out.select(F.lit(name).alias("table_name"), "row_count", "latest",
                      F.array(*[F.lit(c) for c in rows.columns]).alias("columns"),
                      F.when(bad, "warning").otherwise("ok").alias("status"),
                      F.when(bad, F.array(F.lit(text))).otherwise(F.array().cast("array<string>")).alias("warnings"))
