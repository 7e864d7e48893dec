"""Registered queries: labels, training, scoring, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from barograph.functions.ranks import spearman
from barograph.operators import evaluation as ev, labels as lb, models as md
from barograph.plans.common import features, predictions, rounded
from barograph.session import materialized
from barograph.sources import standins as st

SPLIT = ("2000-06-30", "2000-07-01")


def _judged(spark, sf):
    """Scores with their later outcome labels; rank statistics read them several times."""
    return materialized(predictions(spark, sf).select("day", "symbol", "pred_a", "risk_prob", "final_score").join(
        lb.labels(st.eod(spark, sf)), ["symbol", "day"]).dropna(subset=["label_upside"]))


def forward_labels(spark, sf):
    return rounded(lb.labels(st.eod(spark, sf)))


def trailing_risk_labels(spark, sf):
    return rounded(lb.labels(st.eod(spark, sf), mode="trailing").select("symbol", "day", "label_risk"))


def win_labels(spark, sf):
    rows = lb.outcomes(st.eod(spark, sf)).where("ahead > 0")
    return rounded(rows.select("symbol", "day", "max_return", "drawdown", F.expr(lb.win()).cast("int").alias("win")))


def _split_set(spark, sf):
    bars = st.eod(spark, sf)
    rows = lb.training_set(features(spark, sf), lb.labels(bars))
    return lb.time_split(rows, *SPLIT, purge_days=20)


def training_set_split(spark, sf):
    return rounded(_split_set(spark, sf).groupBy("part", "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.avg("label_upside").alias("mean_upside"), F.sum("label_risk").alias("risky"), F.avg("RSI14").alias("mean_rsi")))


def _fitted(spark, sf):
    rows = materialized(_split_set(spark, sf))
    train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
    return md.fit_upside(train), md.fit_risk(train), test


def trained_model_quality(spark, sf):
    """Boosted trees fitted on the earlier part and judged on the later one."""
    upside, risk, test = _fitted(spark, sf)
    scored = md.score(test, upside, risk)
    return (spearman(scored, "pred_a", "label_upside").withColumnRenamed("n", "pairs")
            .crossJoin(ev.classification(scored)).crossJoin(md.output_faults(scored).drop("rows")))


def feature_importance(spark, sf):
    upside, risk, _ = _fitted(spark, sf)
    return md.importances(spark, upside, "upside").unionByName(md.importances(spark, risk, "risk"))


def scored_predictions(spark, sf):
    p = md.final_score(predictions(spark, sf)).withColumn("model_version", F.lit(md.model_version("linear-a", "logit-c")))
    return rounded(p.select("day", "symbol", "model_version", F.col("close").alias("entry_price"), "pred_a", "risk_prob",
                            "final_score"), entry_price=None)


def score_contract(spark, sf):
    return md.output_faults(predictions(spark, sf))


def score_rank_correlation(spark, sf):
    return rounded(spearman(_judged(spark, sf), "pred_a", "label_upside"))


def daily_hit_rate(spark, sf):
    return rounded(ev.daily_top_share(_judged(spark, sf), "pred_a", "label_upside > 0"))


def daily_risk_capture(spark, sf):
    return rounded(ev.daily_top_share(_judged(spark, sf), "risk_prob", "label_risk = 1"))


def risk_classification(spark, sf):
    return rounded(ev.classification(_judged(spark, sf)))


def prediction_summary(spark, sf):
    return rounded(ev.prediction_summary(materialized(predictions(spark, sf).select("pred_a", "risk_prob", "final_score"))))


def upside_buckets(spark, sf):
    return rounded(ev.upside_buckets(predictions(spark, sf)))


def stored_score_differences(spark, sf):
    """Recomputed scores against a stored copy kept with three digits."""
    p = predictions(spark, sf)
    stored = p.select("day", "symbol", *[(F.floor(F.col(c) * 1000) / 1000).alias(c) for c in ("pred_a", "risk_prob", "final_score")])
    return rounded(ev.compare_scores(p, stored))


def upstream_context(spark, sf):
    """Scores of the last day joined with features, news sentiment and valuation."""
    f = features(spark, sf).withColumn("feature_version", F.lit("v1"))
    p = predictions(spark, sf)
    p = p.join(p.agg(F.max("day").alias("_d")), F.col("day") == F.col("_d")).select(
        "day", "symbol", "pred_a", "risk_prob", "final_score", F.lit("v1").alias("feature_version"))
    news = st.news(spark, sf).withColumn("symbol", F.concat(F.lit("Brand#"), F.regexp_extract("symbol", r"(\d+)", 1)))
    score = news.groupBy("symbol").agg(F.avg(F.coalesce("polarity", F.lit(0.0))).alias("sentiment_score"))
    worth = st.table(spark, sf, "part").groupBy(F.col("p_brand").alias("symbol")).agg(
        F.max(F.when(F.col("p_size") > 48, "OVERVALUED")).alias("valuation_label"))
    ctx = ev.context_join(p, f.select("day", "symbol", "feature_version", "close", "vol20", "maxdd90"), score, worth,
                          "ml.predictions")
    return rounded(ctx.select("day", "symbol", "pred_a", "final_score", "close", "vol20", "risk_window", "sentiment_score",
                              "valuation_label", "has_sentiment", "has_valuation", "source_ref", "market_context_symbol"))


def universe_ranking(spark, sf):
    return rounded(ev.universe_ranking(predictions(spark, sf)))


QUERIES = {f.__name__: f for f in (
    forward_labels, trailing_risk_labels, win_labels, training_set_split, trained_model_quality, feature_importance,
    scored_predictions, score_contract, score_rank_correlation, daily_hit_rate, daily_risk_capture, risk_classification,
    prediction_summary, upside_buckets, stored_score_differences, upstream_context, universe_ranking)}
