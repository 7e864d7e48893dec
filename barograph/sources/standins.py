"""Maps the given parquet tables to the market domain: ticks, bars, news, fundamentals, positions, messages.

Everything here is a lazy projection, join or aggregation of the given tables; nothing is generated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barograph.config import LinearScorer
from barograph.operators.bars import daily_bars, resample


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick per line item. ``seq`` packs the tick order into one long, so first/last aggregate by hash."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "symbol", "l_shipdate as ts", "l_extendedprice / l_quantity as price", "l_quantity as volume",
        "(l_orderkey * 8 + l_linenumber) * 1048576 + pmod(cast(round(l_extendedprice * 100) as bigint) * 64 "
        "+ cast(l_quantity as bigint), 1048576) as seq")


def eod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV bars per brand."""
    ticks = trades(spark, sf_dir)
    return daily_bars(ticks.select("symbol", "ts", F.col("price").alias("open"), F.col("price").alias("high"),
                                   F.col("price").alias("low"), F.col("price").alias("close"), "volume", "seq"),
                      order="seq")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market series: mean price of all line items of a day."""
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday ticks from the event stream: one price per event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1).cast("bigint").alias("volume"),
        F.col("event_id"), F.col("user_id"))


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return resample(t.select("symbol", "ts", *[F.col("price").alias(c) for c in ("open", "high", "low", "close")],
                             "volume"), "1 hour")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news items; the label table gives the polarity."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).cast("double")
                                                   .alias("polarity"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("source").alias("symbol"), F.col("doc_id").alias("id"), F.col("text").alias("headline"), "lang",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("day"),
        F.col("polarity"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("symbol"), F.col("p_type").alias("sector"),
        F.col("p_retailprice").alias("current_price"),
        F.when(size % 7 != 0, size.cast("double")).alias("trailing_pe"),
        F.when(size % 5 != 0, (size + 1).cast("double")).alias("forward_pe"),
        F.when(size % 3 == 0, F.col("p_retailprice") * (F.lit(0.8) + size / F.lit(100.0))).alias("target_mean_price"),
        (size % 10).cast("double").alias("analyst_count"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings per customer: value of everything ordered by brand, cash from the account balance."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    held = (line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("o_custkey").alias("account_id"), F.col("p_brand").alias("symbol"))
            .agg(F.sum("l_extendedprice").alias("market_value")))
    return held.join(cust, F.col("account_id") == F.col("c_custkey")).select(
        "account_id", F.col("c_mktsegment").alias("tenant_id"), "symbol", "market_value",
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("cash"))


def scored(features: DataFrame, scorer: LinearScorer = LinearScorer()) -> DataFrame:
    """Predictions by the fixed-coefficient stand-in model; rows with a missing input are not scored."""
    up, risk = F.lit(scorer.upside_bias), F.lit(scorer.risk_bias)
    for name, weight in scorer.upside.items():
        up = up + F.lit(weight) * F.col(name)
    for name, weight in scorer.risk.items():
        risk = risk + F.lit(weight) * F.col(name)
    out = features.withColumn("pred_a", up).withColumn("risk_prob", F.lit(1.0) / (F.lit(1.0) + F.exp(-risk)))
    return out.where(F.col("pred_a").isNotNull() & F.col("risk_prob").isNotNull())
