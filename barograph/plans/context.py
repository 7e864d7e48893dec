"""Registered queries: news, sentiment, valuation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.operators import news as nw, valuation as vl
from barograph.plans.common import rounded
from barograph.sources import standins as st

AS_OF = "2024-02-20 00:00:00"


def _stories(spark, sf, with_url=True):
    """News items with a publication time; only every third one has an address."""
    n = st.news(spark, sf).select("symbol", "id", "headline", "lang", "polarity", "url",
                                  F.col("day").cast("timestamp").alias("published_at"))
    return n if with_url else n.withColumn("url", F.when(F.col("id") % 3 == 0, F.col("url")))


def _aliases(spark, sf):
    """Names per symbol: each benchmark passage stands for one symbol, and its longer words are the symbol's names."""
    words = st.table(spark, sf, "benchmark").select(
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("symbol"), F.explode(F.split("text", r"\s+")).alias("_w"))
    return words.select("symbol", F.lower(F.btrim("_w", F.lit(".,"))).alias("alias")).where("length(alias) >= 6").distinct()


def _scored(spark, sf):
    merged = nw.merge_sources([("yfinance", _stories(spark, sf, False)), ("finnhub", _stories(spark, sf))])
    merged = merged.withColumn("text", F.col("headline"))
    return nw.score_items(nw.in_window(nw.relevant(nw.newest_items(merged), _aliases(spark, sf)), AS_OF))


def sentiment(spark, sf):
    return nw.sentiment_snapshot(_scored(spark, sf), AS_OF)


def valuation(spark, sf):
    return vl.valuation_snapshot(st.fundamentals(spark, sf), AS_OF)


def daily_news(spark, sf):
    return rounded(nw.daily_news(st.news(spark, sf)))


def news_dynamics(spark, sf):
    return rounded(nw.news_dynamics(nw.daily_news(st.news(spark, sf))))


def merged_news(spark, sf):
    rows = nw.merge_sources([("yfinance", _stories(spark, sf, False)), ("finnhub", _stories(spark, sf))])
    return rows.select("symbol", "id", "data_source", "published_at", F.length("headline").alias("chars"),
                       F.md5("headline").alias("digest"), "url")


def flattened_payloads(spark, sf):
    """Documents as nested vendor items, times as epoch seconds or ISO text, and back."""
    n = st.news(spark, sf)
    when = F.when(F.col("id") % 2 == 0, F.unix_timestamp(F.col("day").cast("timestamp")).cast("string")).otherwise(
        F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    nested = F.to_json(F.struct("id", F.struct(
        F.col("headline").alias("title"), when.alias("pubDate"),
        F.when(F.col("id") % 3 == 0, F.struct("url")).alias("canonicalUrl"),
        F.concat(F.lit("plain/"), "url").alias("url")).alias("content")))
    flat = nw.flatten_payload(n.select("symbol", nested.alias("payload")))
    return flat.select("symbol", "id", "url", "published_at", F.md5("headline").alias("digest"))


def relevant_news(spark, sf):
    n = _stories(spark, sf).withColumn("text", F.col("headline"))
    return nw.relevant(n, _aliases(spark, sf)).select("symbol", "id", "lang")


def sentiment_snapshot(spark, sf):
    s = sentiment(spark, sf)
    return rounded(s.select(*[c for c in s.columns if c != "top_drivers"],
                            F.transform("top_drivers", F.md5).alias("driver_digests")))


def sector_price_earnings(spark, sf):
    f = st.fundamentals(spark, sf).select("sector", F.coalesce(vl.positive("trailing_pe"), vl.positive("forward_pe"))
                                          .alias("pe_ratio"))
    return rounded(vl.sector_pe(f))


def valuation_snapshot(spark, sf):
    return rounded(valuation(spark, sf), 6)


QUERIES = {f.__name__: f for f in (daily_news, news_dynamics, merged_news, flattened_payloads, relevant_news,
                                   sentiment_snapshot, sector_price_earnings, valuation_snapshot)}
