"""Registered queries: decoding, cleaning, table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barograph.config import SYMBOL_ALIASES
from barograph.operators import quality as ql
from barograph.plans.common import predictions, rounded
from barograph.session import checkpoint_dir
from barograph.sources import decode as dc, standins as st, summaries as sm, tables as tb

NOW = "2024-02-01 00:00:00"


def _payloads(spark, sf, key="Symbol"):
    """The event stream as JSON messages with lineage. Some events lack a symbol, a time, a volume or a valid range."""
    e = st.ticks(spark, sf)
    bad = lambda n: F.col("event_id") % n == 0
    value = F.to_json(F.struct(
        F.when(bad(31), "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("Datetime"),
        F.col("price").alias("Open"), F.when(bad(37), F.col("price") - 1).otherwise(F.col("price") + 1).alias("High"),
        F.col("price").alias("Low"), F.when(bad(41), F.lit(0.0)).otherwise(F.col("price")).alias("Close"),
        F.when(bad(43), F.lit(0)).otherwise(F.col("user_id")).alias("Volume"), F.lit(0.0).alias("Dividends"),
        (F.col("event_id") % 3).cast("double").alias("Stock Splits"),
        F.when(bad(47), "  ").otherwise(F.concat(F.lit(" "), "symbol")).alias(key)))
    return e.select(value.alias("value"), F.lit("stock_market").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"),
                    F.col("event_id").alias("offset"))


def _news_payloads(spark, sf):
    """Even documents travel as one object, odd ones as an array of one."""
    n = st.news(spark, sf)
    item = F.to_json(F.struct(
        F.concat(F.lit(" "), F.upper("lang")).alias("category"), F.unix_timestamp(F.col("day").cast("timestamp")).alias("datetime"),
        F.when(F.col("id") % 29 == 0, " ").otherwise(F.col("headline")).alias("headline"), "id", F.col("symbol").alias("related"),
        F.lit(" wire ").alias("source"), F.col("headline").alias("summary"), "url",
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("S"), "symbol")).alias("Symbol")))
    value = F.when(F.col("id") % 2 == 0, item).otherwise(F.concat(F.lit("["), item, F.lit("]")))
    return n.select(value.alias("value"), F.lit("stock_news").alias("topic"), (F.col("id") % 4).cast("int").alias("partition"),
                    F.col("id").alias("offset"))


def _ntz(df, *cols):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in cols else F.col(c) for c in df.columns])


def decoded_market(spark, sf):
    return _ntz(dc.market_messages(_payloads(spark, sf), NOW), "ts", "etl_load")


def decoded_indicators(spark, sf):
    return _ntz(dc.known_time(dc.indicator_messages(_payloads(spark, sf, "Indicator"), NOW)), "ts", "etl_load")


def decoded_news(spark, sf):
    rows = dc.news_messages(_news_payloads(spark, sf), NOW)
    return _ntz(rows.select("ts", "symbol", "event_timestamp", "category", "id", "related", "url", F.md5("headline").alias("digest"),
                            "partition", "offset"), "ts")


def silver_market(spark, sf):
    rows = ql.clean_intraday(dc.market_messages(_payloads(spark, sf), NOW), now=NOW)
    return _ntz(rounded(rows.drop("etl_load", "process_date")), "ts")


def silver_indicators(spark, sf):
    """Without the volume rule, for series that have none."""
    rows = ql.clean_intraday(dc.indicator_messages(_payloads(spark, sf, "Indicator"), NOW), "indicator", need_volume=False, now=NOW)
    return rows.groupBy("indicator").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("close_position"), 6).alias("mean_position"))


def silver_indicator_rows(spark, sf):
    rows = ql.clean_intraday(dc.indicator_messages(_payloads(spark, sf, "Indicator"), NOW), "indicator", need_volume=False, now=NOW)
    return _ntz(rounded(rows), "ts", "etl_load", "process_date")


def silver_news(spark, sf):
    rows = ql.clean_news(dc.news_messages(_news_payloads(spark, sf), NOW), NOW)
    return _ntz(rows.select("ts", "symbol", "id", "category", F.md5("headline").alias("digest"), "source",
                            F.md5("summary").alias("summary_digest"), "url"), "ts")


def rejected_market_rows(spark, sf):
    return ql.rejected_counts(dc.market_messages(_payloads(spark, sf), NOW), ql.intraday_rules())


def _landed(spark, sf):
    """Line items as landed vendor rows: text numbers, some unreadable, padded symbols."""
    t = st.table(spark, sf, "lineitem").join(st.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    text = lambda c: c.cast("string")
    return t.select(
        F.col("l_shipdate").alias("Datetime"), F.concat(F.lit(" "), F.lower("p_brand")).alias("Symbol"),
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(text(price)).alias("Open"), text(price + 1).alias("High"),
        F.when(F.col("l_linenumber") == 6, text(price + 2)).otherwise(text(price)).alias("Low"), text(price).alias("Close"),
        text(price).alias("Adj Close"), F.when(F.col("l_linenumber") == 5, "").otherwise(text(F.col("l_quantity"))).alias("Volume"),
        F.lit("0").alias("Dividends"), text(F.col("l_discount")).alias("Stock Splits"))


def raw_prices(spark, sf):
    rows = dc.raw_eod(_landed(spark, sf), now=NOW)
    return rounded(rows.groupBy("symbol", "source").agg(
        F.count(F.lit(1)).alias("rows"), F.count("open").alias("opens"), F.sum("volume").alias("volume"),
        F.count_if(F.col("volume") == 0).alias("no_volume"), F.avg("stock_splits").alias("mean_splits")))


def raw_price_rows(spark, sf):
    return _ntz(rounded(dc.raw_eod(_landed(spark, sf), now=NOW), adj_close=None), "etl_load")


def clean_prices(spark, sf):
    rows = ql.clean_eod(dc.raw_eod(_landed(spark, sf), now=NOW), "2000-06-30", NOW)
    return rounded(rows.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("rows"), F.sum("daily_range").alias("ranges"),
                                                     F.avg("close_position").alias("mean_position")))


def price_history_gate(spark, sf):
    """Brands and part types are wanted; only brands have bars, the minimum separates them."""
    part = st.table(spark, sf, "part")
    wanted = part.select(F.col("p_brand").alias("symbol")).union(part.select("p_type"))
    return ql.history_gate(st.eod(spark, sf), wanted, 1500)


def current_tickers(spark, sf):
    """Part names prefixed with legacy tickers in turn."""
    legacy = F.array(*[F.lit(f" {k.lower()}") for k in SYMBOL_ALIASES])
    part = st.table(spark, sf, "part")
    pick = F.element_at(legacy, (F.col("p_partkey") % len(SYMBOL_ALIASES) + 1).cast("int"))
    return dc.normalized_symbols(part.select(F.when(F.col("p_size") > 25, pick).otherwise(F.col("p_brand")).alias("symbol")))


def canonical_bars(spark, sf):
    rows = st.eod(spark, sf).select(F.col("day").alias("DATETIME"), F.col("symbol").alias("SyMbOl"), F.col("close").alias("CLOSE"),
                                    "volume")
    return dc.canonical_columns(rows, ["Datetime", "Symbol", "Close"])


def typed_context(spark, sf):
    """Order dates as text, every seventh unreadable."""
    text = F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = st.table(spark, sf, "orders").select("o_orderkey", text.alias("as_of_date"), F.concat(text, F.lit(" 10:30:00"))
                                                .alias("process_date"))
    return _ntz(dc.typed_context(rows), "process_date")


def merged_prices(spark, sf):
    """Bars up to 2000 as the table, later bars and corrected ones of 2000 as updates with a new column."""
    bars = st.eod(spark, sf).select("day", "symbol", "close", "volume")
    updates = bars.where("day >= date'2000-01-01'").withColumn("close", F.col("close") * 2).withColumn("note", F.lit("fixed"))
    return tb.merge_rows(bars.where("day < date'2000-07-01'"), updates, ["day", "symbol"])


def load_windows(spark, sf):
    part = st.table(spark, sf, "part")
    wanted = part.select(F.col("p_brand").alias("symbol")).union(part.select("p_type"))
    bars = st.eod(spark, sf)
    kinds = [tb.load_windows(wanted, bars, "2001-01-31", "1992-01-01", 10, m).withColumn("rule", F.lit(m))
             for m in ("incremental", "rolling")]
    return kinds[0].unionByName(kinds[1])


def table_state(spark, sf):
    part = st.table(spark, sf, "part")
    return tb.table_state(st.eod(spark, sf), part.select(F.col("p_brand").alias("symbol")).union(part.select("p_type")))


def run_manifest(spark, sf):
    return tb.run_manifest(st.eod(spark, sf), "r1", "clean")


def prediction_preview(spark, sf):
    return rounded(tb.preview(predictions(spark, sf).withColumn("entry_price", F.col("close"))), entry_price=None)


def _price_summary(spark, sf):
    """Bars as a table by year: those before 2000 appended, later ones appended in part and then upserted; the summary follows."""
    path = f"{checkpoint_dir(spark)}/prices-{uuid.uuid4().hex}"
    bars = st.eod(spark, sf).select("day", "symbol", "close", F.trunc("day", "year").alias("year"))
    for rows in (bars.where("day < date'2000-01-01'"), bars.where("day between date'2000-01-01' and date'2000-03-31'")):
        tb.append(rows, path, ("year",))
        sm.refresh(spark, path, bars.schema, "year")
    tb.upsert(bars.where("day >= date'2000-03-01'"), path, bars.schema, ["day", "symbol"], part="year")
    sm.refresh(spark, path, bars.schema, "year")
    return sm.read_summary(spark, path, bars.schema["year"])


def _now(spark):
    return spark.range(1).select(F.lit(NOW).cast("timestamp_ntz").alias("now"))


def summarised_state(spark, sf):
    part = st.table(spark, sf, "part")
    return sm.state_from_summary(_price_summary(spark, sf), part.select(F.col("p_brand").alias("symbol")).union(part.select("p_type")))


def summarised_health(spark, sf):
    return sm.health_from_summary({"prices": _price_summary(spark, sf)}, _now(spark))


def summarised_freshness(spark, sf):
    return sm.freshness_from_summary({"prices": _price_summary(spark, sf)}, _now(spark))


QUERIES = {f.__name__: f for f in (
    decoded_market, decoded_indicators, decoded_news, silver_market, silver_indicators, silver_indicator_rows, silver_news,
    rejected_market_rows, raw_prices, raw_price_rows, clean_prices, price_history_gate, current_tickers, canonical_bars, typed_context, merged_prices, load_windows,
    table_state, run_manifest, prediction_preview, summarised_state, summarised_health, summarised_freshness)}
