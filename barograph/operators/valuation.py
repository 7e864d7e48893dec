"""Relative valuation from fundamentals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barograph.config import SECTOR_PE
from barograph.functions.ranks import quantiles
from barograph.session import materialized

#: Rows of a broadcast table of sectors.
MOST_BROADCAST = 100_000


def positive(name: str) -> Column:
    """A positive finite number, else null."""
    x = F.expr(f"try_cast({name} as double)")
    return F.when((x > 0) & (x < float("inf")), x)


def sector_pe(fundamentals: DataFrame) -> DataFrame:
    """Exact median price/earnings and sample size per sector, counted before shuffling."""
    return quantiles(fundamentals, "pe_ratio", {"sector_median": 0.5}, ["sector"]).withColumnRenamed("n", "sector_sample_count")


def valuation_snapshot(raw: DataFrame, as_of: str, fallback: dict[str, float] = SECTOR_PE) -> DataFrame:
    """Fair value from the analyst target, else from the sector's ratio; label, method and quality."""
    rows = raw.select(
        "symbol", F.coalesce(F.nullif(F.trim("sector"), F.lit("")), F.lit("Unknown")).alias("sector"),
        positive("current_price").alias("current_price"),
        F.coalesce(positive("trailing_pe"), positive("forward_pe")).alias("pe_ratio"),
        positive("target_mean_price").alias("target"), positive("analyst_count").alias("analyst_count"))
    table = F.create_map(*[F.lit(x) for pair in fallback.items() for x in pair])
    # A sector is one row; a list of sectors that is short, once counted, is broadcast, so a hot sector isn't moved.
    medians = materialized(sector_pe(rows))
    medians = F.broadcast(medians) if medians.count() <= MOST_BROADCAST else medians
    rows = rows.join(medians, "sector", "left").selectExpr("*").withColumn(
        "sector_pe_ratio", F.coalesce("sector_median", F.element_at(table, F.col("sector"))))
    method = (F.when(F.col("sector_median").isNull(), "fallback_sector_pe")
              .when(F.col("target").isNotNull(), "analyst_target").otherwise("sector_pe_relative"))
    rows = rows.select(
        "*", method.alias("_method"), F.coalesce("target", F.col("current_price") * F.col("sector_pe_ratio")
                                                 / F.col("pe_ratio")).alias("fair_value_estimate"),
        F.coalesce("sector_sample_count", F.lit(0)).cast("int").alias("_n"))
    rows = rows.withColumn("upside_downside_pct",
                           (F.col("fair_value_estimate") - F.col("current_price")) / F.col("current_price") * 100)
    up, fair = F.col("upside_downside_pct"), F.col("fair_value_estimate")
    label = (F.when(up.isNull(), "UNKNOWN").when(up >= 10, "UNDERVALUED").when(up <= -10, "OVERVALUED")
             .otherwise("FAIRLY_VALUED"))
    good = (((F.col("_method") == "analyst_target") & (F.col("analyst_count") >= 5))
            | ((F.col("_method") == "sector_pe_relative") & F.col("pe_ratio").isNotNull() & (F.col("_n") >= 10)))
    quality = F.when(fair.isNull(), "UNKNOWN").when(F.coalesce(good, F.lit(False)), "MEDIUM").otherwise("LOW")
    return rows.select(
        F.to_date(F.lit(as_of)).alias("as_of_date"), "symbol", label.alias("valuation_label"), "pe_ratio",
        "sector_pe_ratio", "fair_value_estimate", "upside_downside_pct",
        F.when(fair.isNull(), "unavailable").otherwise(F.col("_method")).alias("valuation_method"),
        quality.alias("valuation_quality"), F.col("_n").alias("sector_sample_count"), "analyst_count",
        F.array(F.concat(F.lit("yfinance.fundamentals:"), F.col("symbol").cast("string"))).alias("source_refs"))
