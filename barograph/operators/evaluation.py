"""Model evaluation: daily hit rates, classification figures, summaries, comparison with stored scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barograph.functions.ranks import auc, quantiles


def daily_top_share(rows: DataFrame, score: str, hit: str, share: float = 0.1, min_names: int = 10) -> DataFrame:
    """Per day: share of hits among the best tenth. A day's group is bounded by the universe, not by the history."""
    best = Window.partitionBy("day").orderBy(F.desc(score), "symbol")
    ranked = rows.select("day", "symbol", F.expr(hit).alias("_hit"), F.row_number().over(best).alias("_rk"),
                         F.count(F.lit(1)).over(Window.partitionBy("day")).alias("_n"))
    take = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    return (ranked.where((F.col("_n") >= min_names) & (F.col("_rk") <= take)).groupBy("day")
            .agg(F.count(F.lit(1)).alias("picked"), F.avg(F.col("_hit").cast("double")).alias("hit_share")))


def classification(rows: DataFrame, prob: str = "risk_prob", label: str = "label_risk", cut: float = 0.5) -> DataFrame:
    """Precision and recall at a cut, and the area under the curve: one row."""
    said, true = F.col(prob) >= cut, F.col(label) == 1
    both = F.count_if(said & true)
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.try_divide(both, F.count_if(said)).alias("precision"),
                      F.try_divide(both, F.count_if(true)).alias("recall"))
    return counts.crossJoin(auc(rows, prob, label))


def prediction_summary(rows: DataFrame, columns=("pred_a", "risk_prob", "final_score")) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles per score column."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in columns])))
    long = long.where(F.col("value").isNotNull())
    basic = long.groupBy("measure").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                        F.min("value").alias("min"), F.max("value").alias("max"))
    marks = quantiles(long, "value", {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}, ["measure"])
    return basic.join(marks, "measure")


def upside_buckets(rows: DataFrame) -> DataFrame:
    p = F.col("pred_a")
    share = lambda c: F.avg(c.cast("double"))
    return rows.where(p.isNotNull()).agg(
        share(p < 0.05).alias("below_005"), share((p >= 0.05) & (p < 0.1)).alias("from_005"),
        share((p >= 0.1) & (p < 0.2)).alias("from_010"), share(p >= 0.5).alias("from_050"))


def compare_scores(recomputed: DataFrame, stored: DataFrame, columns=("pred_a", "risk_prob", "final_score")) -> DataFrame:
    """Largest and mean absolute difference per score, over the (day, symbol) pairs both sides have."""
    left = recomputed.select("day", "symbol", *columns)
    right = stored.select("day", "symbol", *[F.col(c).alias(f"_{c}") for c in columns])
    both = left.join(right, ["day", "symbol"])
    long = both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.abs(F.col(c) - F.col(f"_{c}"))
                                                   .alias("diff")) for c in columns])))
    return long.groupBy("measure").agg(F.count("diff").alias("rows"), F.max("diff").alias("max_diff"),
                                       F.avg("diff").alias("mean_diff"))


def context_join(predictions: DataFrame, features: DataFrame, sentiment: DataFrame, valuation: DataFrame,
                 source_ref: str) -> DataFrame:
    """Predictions with features (three keys), sentiment and valuation; which optional sections have any data."""
    context = (predictions.join(features, ["day", "symbol", "feature_version"], "left")
               .join(sentiment, "symbol", "left").join(valuation, "symbol", "left"))
    # Two one-row flags instead of a window over everything.
    have = sentiment.join(predictions.select("symbol"), "symbol", "left_semi").agg(
        F.coalesce(F.max(F.col("sentiment_score").isNotNull()), F.lit(False)).alias("has_sentiment"))
    worth = valuation.join(predictions.select("symbol"), "symbol", "left_semi").agg(
        F.coalesce(F.max(F.col("valuation_label").isNotNull()), F.lit(False)).alias("has_valuation"))
    return context.crossJoin(F.broadcast(have)).crossJoin(F.broadcast(worth)).select(
        "*", F.concat(F.lit(f"{source_ref}:"), "symbol").alias("source_ref"),
        F.when(F.col("maxdd90").isNotNull(), "90d").otherwise("20d_proxy").alias("risk_window"),
        F.lit("SPY").alias("market_context_symbol"))


def universe_ranking(rows: DataFrame, n: int = 20) -> DataFrame:
    """Best names by final score on each symbol's latest day: a top-k sort, not a window over everything."""
    latest = rows.groupBy("symbol").agg(F.max_by(F.struct("day", "pred_a", "risk_prob", "final_score"), "day").alias("l"))
    return (latest.select("symbol", "l.day", (F.col("l.pred_a") * 100).alias("upside_pct"),
                          (F.col("l.risk_prob") * 100).alias("risk_pct"), (F.col("l.final_score") * 100).alias("final_pct"))
            .orderBy(F.desc_nulls_last("final_pct"), "symbol").limit(n))
