"""News: dynamics per day, merging and duplicate removal, relevance, window, sentiment roll-up."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from barograph.config import NewsRules

# fixed values: reference strings of the news sources and of the scoring model
SOURCE_REFS = {"yfinance": "yfinance.news", "finnhub": "finnhub.company_news"}
SCORER_REF = "finbert:ProsusAI/finbert"
# fixed values: length of the pieces by which long lists of aliases are looked up, and the aliases of a short list
_PIECE, _FEW_ALIASES = 6, 32


def daily_news(news: DataFrame) -> DataFrame:
    """Mean polarity and number of headlines per symbol and day; a missing polarity counts as zero."""
    return news.groupBy("symbol", "day").agg(F.avg(F.coalesce(F.col("polarity"), F.lit(0.0))).alias("S_it"),
                                             F.count("headline").alias("N_it"))


def news_dynamics(daily: DataFrame) -> DataFrame:
    """Change, speed and acceleration of sentiment, news volume against its history, and their product."""
    w = "over (partition by symbol order by day"
    rows = daily.selectExpr(
        "*", f"greatest(coalesce(datediff(day, lag(day) {w})), 1), 1) as delta_t",
        f"S_it - coalesce(lag(S_it) {w}), 0.0d) as delta_S",
        f"N_it / coalesce(avg(N_it) {w} rows between 20 preceding and 1 preceding), 1.0d) as Z")
    rows = rows.selectExpr("*", "delta_S / delta_t as V")
    rows = rows.selectExpr("*", f"V - coalesce(lag(V) {w}), 0.0d) as A")
    return rows.selectExpr("symbol", "day", "S_it", "N_it", "delta_t", "delta_S", "V", "A", "Z",
                           "delta_S * log1p(Z) * (1 + A) as M")


def published_time(value: str) -> Column:
    """Epoch seconds or an ISO text."""
    return F.coalesce(F.timestamp_seconds(F.expr(f"try_cast({value} as double)")), F.try_to_timestamp(F.col(value)))


_CONTENT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("content", T.StructType([
        T.StructField("title", T.StringType()), T.StructField("summary", T.StringType()),
        T.StructField("pubDate", T.StringType()), T.StructField("url", T.StringType()),
        T.StructField("canonicalUrl", T.StructType([T.StructField("url", T.StringType())]))]))])


def flatten_payload(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Nested vendor items to flat rows; the nested content wins over the outer fields."""
    doc = raw.withColumn("_d", F.from_json(payload, _CONTENT))
    return doc.select(
        *[c for c in raw.columns if c != payload], F.col("_d.id").alias("id"),
        F.coalesce("_d.content.title", "_d.title").alias("headline"), F.col("_d.content.summary").alias("summary"),
        F.coalesce("_d.content.canonicalUrl.url", "_d.content.url", "_d.url").alias("url"),
        F.coalesce("_d.content.pubDate", "_d.pubDate").alias("_published")
    ).withColumn("published_at", published_time("_published")).drop("_published")


def merge_sources(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union of sources with one row per story: same URL, else same title and day. Earlier sources win.

    The winner is a minimum of structs, combined on the map side, so many copies of one story stay cheap.
    """
    tagged = [df.withColumn("data_source", F.lit(name)).withColumn("_prio", F.lit(i))
              for i, (name, df) in enumerate(sources)]
    rows = tagged[0]
    for df in tagged[1:]:
        rows = rows.unionByName(df, allowMissingColumns=True)
    url, title = F.lower(F.trim("url")), F.lower(F.trim(F.coalesce("headline", F.lit(""))))
    day = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("unknown"))
    key = F.when(F.length(url) > 0, F.concat(F.lit("url:"), url)).otherwise(F.concat(F.lit("title:"), title, F.lit(":"), day))
    fields = [c for c in rows.columns if c not in ("symbol", "_prio", "id")]
    best = rows.withColumn("_key", F.sha2(key, 256)).groupBy("symbol", "_key").agg(
        F.min(F.struct("_prio", "id", *fields)).alias("_b"))
    return best.select("symbol", "_b.id", *[F.col(f"_b.{c}").alias(c) for c in fields])


def symbol_aliases(symbols: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(symbol, alias): the symbols themselves and, from (symbol, name), their names with and without "Inc."."""
    own = symbols.select("symbol").distinct().select("symbol", F.col("symbol").alias("alias"))
    if names is not None:
        for name in (F.trim("name"), F.trim(F.regexp_replace("name", r"Inc\.?", ""))):
            own = own.unionByName(names.select("symbol", name.alias("alias")))
    return own.where(F.length("alias") > 0).distinct()


def story_text(news: DataFrame) -> Column:
    """Headline and, where there is one, summary."""
    parts = [F.trim(F.coalesce(c, F.lit(""))) for c in ("headline", "summary") if c in news.columns]
    return F.trim(F.concat_ws(" ", *parts))


def relevant(news: DataFrame, aliases: DataFrame, text: str = "text") -> DataFrame:
    """Keep items whose text has an alias of the symbol as a word or as a part. Aliases are a small dimension.

    A word is a part of the text, so parts decide. A text is lowered once and searched for a few aliases one by one. For
    more, its own pieces (runs of ``_PIECE`` characters inside its distinct words) are first met with the aliases' pieces as
    sets, and only aliases whose piece is there are searched, so a text does not cost its length times all aliases.
    """
    lowered = aliases.select("symbol", F.lower("alias").alias("_alias")).where(F.length("_alias") > 0).distinct()
    piece = F.col("_piece")
    names = lowered.withColumn("_piece", F.nullif(F.regexp_extract("_alias", rf"\S{{{_PIECE}}}", 0), F.lit(""))).groupBy("symbol").agg(
        F.collect_list(F.when(piece.isNull(), F.col("_alias"))).alias("_short"),
        F.collect_list(F.when(piece.isNotNull(), F.struct("_alias", "_piece"))).alias("_long"), F.collect_set(piece).alias("_pieces"))

    def hit(low: Column) -> Column:
        words = F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: F.length(w) >= _PIECE))
        own = F.regexp_extract_all(F.array_join(words, " "), F.lit(rf"(?=(\S{{{_PIECE}}}))"), F.lit(1))
        met = F.array(F.array_intersect("_pieces", own))
        return F.exists("_short", lambda a: low.contains(a)) | F.when(
            F.size("_long") <= _FEW_ALIASES, F.exists("_long", lambda a: low.contains(a["_alias"]))).otherwise(
            F.exists(met, lambda m: F.exists("_long", lambda a: F.array_contains(m, a["_piece"]) & low.contains(a["_alias"]))))

    # What a lambda takes in from outside is evaluated for every element; arrays of one element bind it once a row.
    return news.join(names, "symbol").where(F.exists(F.array(F.lower(text)), hit)).drop("_short", "_long", "_pieces")


def newest_items(news: DataFrame, rules: NewsRules = NewsRules()) -> DataFrame:
    """The newest items per symbol, with their ``rank``. The cap is the feature; the window group limit applies it
    before the shuffle."""
    newest = Window.partitionBy("symbol").orderBy(F.col("published_at").desc_nulls_last(), "id")
    return news.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= rules.max_articles)


def in_window(ranked: DataFrame, as_of: str, rules: NewsRules = NewsRules()) -> DataFrame:
    """Items inside the look-back window; a symbol without any keeps its first ones. Adds ``stale``.

    Input groups are capped lists (``newest_items``), so the windows here are small.
    """
    start = F.expr(f"timestamp'{as_of}' - interval {rules.lookback_days} days")
    end = F.expr(f"timestamp'{as_of}' + interval 1 day")
    fresh = F.col("published_at").isNull() | ((F.col("published_at") >= start) & (F.col("published_at") < end))
    marked = ranked.withColumn("_fresh", fresh).withColumn(
        "_any", F.max("_fresh").over(Window.partitionBy("symbol"))).withColumn(
        "_pos", F.row_number().over(Window.partitionBy("symbol").orderBy("rank")))
    return (marked.where(F.col("_fresh") | (~F.col("_any") & (F.col("_pos") <= rules.fallback_articles)))
            .withColumn("stale", F.coalesce(F.col("published_at") < start, F.lit(False))).drop("_fresh", "_any", "_pos"))


def score_items(news: DataFrame, scorer: Callable[[Iterator], Iterator] | None = None) -> DataFrame:
    """Score in [-1, 1]. A scorer maps batches of pandas frames and adds ``score``; the default reads ``polarity``.

    Without a score, positive minus negative probability is used where those columns exist.
    """
    if scorer is not None:
        schema = T.StructType([*news.schema.fields, T.StructField("score", T.DoubleType())])
        scored = news.mapInPandas(scorer, schema)
    elif "positive_prob" in news.columns:
        scored = news.withColumn("score", F.coalesce("polarity", F.coalesce("positive_prob", F.lit(0.0))
                                                     - F.coalesce("negative_prob", F.lit(0.0))))
    else:
        scored = news.withColumn("score", F.coalesce("polarity", F.lit(0.0)))
    return scored.withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score")))


def sentiment_snapshot(scored: DataFrame, as_of: str, rules: NewsRules = NewsRules()) -> DataFrame:
    """One sentiment row per symbol from at most ``max_articles`` scored items."""
    cut = rules.label_cut
    source = F.lower("data_source")
    drivers = F.slice(F.array_sort(F.collect_list(F.struct((-F.abs("score")).alias("k"), "rank", "headline"))), 1,
                      rules.top_drivers)
    agg = scored.groupBy("symbol").agg(
        F.avg("score").alias("_mean"), F.count(F.lit(1)).cast("int").alias("article_count"),
        F.max("published_at").alias("latest_article_published_at"),
        F.min("published_at").alias("oldest_article_published_at"),
        F.count_if(F.col("stale")).cast("int").alias("stale_article_count"),
        F.max(F.col("score") > cut).alias("_pos"), F.max(F.col("score") < -cut).alias("_neg"), drivers.alias("_drivers"),
        *[F.max(source == s).alias(f"_has_{s}") for s in SOURCE_REFS])
    label = (F.when(F.col("_pos") & F.col("_neg"), "MIXED").when(F.col("_mean") >= cut, "BULLISH")
             .when(F.col("_mean") <= -cut, "BEARISH").otherwise("NEUTRAL"))
    refs = F.filter(F.array(*[F.when(F.col(f"_has_{s}"), F.concat(F.lit(f"{ref}:"), "symbol"))
                              for s, ref in SOURCE_REFS.items()], F.lit(SCORER_REF)), lambda r: r.isNotNull())
    return agg.select(
        F.to_date(F.lit(as_of)).alias("as_of_date"), "symbol",
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "_mean")).alias("sentiment_score"), label.alias("sentiment_label"),
        "article_count", "latest_article_published_at", "oldest_article_published_at", "stale_article_count",
        F.transform("_drivers", lambda d: d["headline"]).alias("top_drivers"), refs.alias("source_refs"))
