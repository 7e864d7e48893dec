"""The end-of-day job: landed rows to stored prices, features, predictions, sentiment and valuation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from barograph.operators import daily_features as df_, models as md, news as nw, quality as ql, valuation as vl
from barograph.schemas import FEATURE_COLUMNS, TABLES
from barograph.sources import decode as dc, tables as tb


@dataclass(frozen=True)
class EndOfDay:
    """What a run needs besides its inputs; ``now`` stamps its rows, so that a repeated run writes equal tables."""

    base: str
    run_id: str
    as_of: str
    now: str
    benchmark: str = "SPY"
    min_days: int = 260
    feature_version: str = "v1"
    model_version: str = "upside+risk"


def _stored(spark: SparkSession, job: EndOfDay, rows: DataFrame, name: str, keys: list[str],
            check: Callable[[], None] | None = None) -> tuple[DataFrame, dict]:
    """Stage the rows under the run, put them into their table, and go on from the staged files.

    What the manifest says is measured while the rows are staged; ``check`` stands between the stage and the table.
    """
    schema, parts = TABLES[name]
    rows, measured = tb.measured_run(tb.conform(rows, schema), job.base, job.run_id, name, tb.stage_metrics(parts[0]))
    if check:
        check()
    tb.upsert(rows, f"{job.base}/{name.replace('.', '/')}", tb.table_schema(name), keys, part=parts[0])
    return rows, measured


def run_end_of_day(spark: SparkSession, job: EndOfDay, landed: DataFrame, score: Callable[[DataFrame], DataFrame],
                   news: DataFrame | None = None, fundamentals: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Run all stages in order and return the run's manifest, one row per stage; it is stored under the run, too.

    ``landed`` has the vendor's columns; ``score`` adds ``pred_a`` and ``risk_prob`` to rows of features; ``news`` are
    merged items (``news.merge_sources``) with a ``polarity``, of which those count that name their symbol or one of its
    ``names`` (symbol, name). Histories that are too short, and scores outside their contract, stop the run before
    anything is predicted. Counts, rejected rows and faults are measured in the writes themselves.
    """
    stamp = F.lit(job.now).cast("timestamp")
    written: list[tuple[str, list[str], dict]] = []

    def keep(rows: DataFrame, name: str, keys: list[str], check: Callable[[], None] | None = None) -> DataFrame:
        out, measured = _stored(spark, job, rows, name, keys, check)
        written.append((name, out.columns, measured))
        return out

    prices = keep(dc.raw_eod(landed, now=job.now), "eod.prices", ["day", "symbol"])
    tidy, rejected = tb.observed(ql.tidy_eod(prices), ql.rejections(ql.eod_rules(job.as_of)))
    curated = keep(ql.passing_eod(tidy, job.as_of, now=job.now), "eod.curated", ["day", "symbol"])
    written[-1][2]["rejected"] = rejected.get["rejected"]
    history = tb.read_table(spark, job.base, "eod.curated")
    ql.require_history(ql.history_gate(history, curated.select("symbol"), job.min_days))
    bars = history.select("day", "symbol", "open", "high", "low", "close", "volume")
    market = bars.where(F.col("symbol") == job.benchmark).select("day", "close")
    ql.require_rows(market, "benchmark")
    features = df_.price_features(bars.where(F.col("symbol") != job.benchmark), market)
    fresh = features.join(curated.select("symbol", "day").distinct(), ["symbol", "day"], "left_semi")
    features = keep(df_.with_vector(fresh, job.feature_version, 0, job.now), "ml.features", ["day", "symbol", "feature_version"])
    closes = bars.select("symbol", "day", F.col("close").alias("entry_price"))
    scored, faults = tb.observed(score(df_.on_target_day(features, job.as_of).select("day", "symbol", *FEATURE_COLUMNS)), md.contract_faults())
    predictions = md.final_score(scored).join(closes, ["symbol", "day"]).withColumns({
        "model_version": F.lit(job.model_version), "feature_version": F.lit(job.feature_version), "process_date": stamp})
    keep(predictions, "ml.predictions", ["day", "symbol", "model_version"], lambda: md.require_contract(faults.get))
    if news is not None:
        newest = nw.newest_items(news)
        stories = nw.relevant(newest.withColumn("_text", nw.story_text(newest)), nw.symbol_aliases(newest, names), "_text").drop("_text")
        windowed = nw.in_window(stories, job.as_of)
        snapshot = nw.sentiment_snapshot(nw.score_items(windowed), job.as_of)
        keep(snapshot.withColumns({"sentiment_scored_at": stamp, "process_date": stamp}), "ml.sentiment", ["as_of_date", "symbol"])
    if fundamentals is not None:
        snapshot = vl.valuation_snapshot(fundamentals, job.as_of).withColumns({
            "symbol": F.col("symbol").cast("string"), "valuation_fetched_at": stamp,
            "fundamentals_as_of": F.to_date(F.lit(job.as_of)), "process_date": stamp})
        keep(snapshot, "ml.valuation", ["as_of_date", "symbol"])
    return tb.stage_run(tb.manifest_table(spark, job.run_id, written), job.base, job.run_id, "manifest")
