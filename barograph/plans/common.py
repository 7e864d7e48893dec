"""Helpers for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from barograph.operators.daily_features import price_features
from barograph.sources import standins as st


# Prices are plain quotients and compare exactly; rounding them would only create ties.
EXACT = {"open": None, "high": None, "low": None, "close": None}


def rounded(df: DataFrame, digits: int = 6, **special: int | None) -> DataFrame:
    """Round double columns, so sums in another order compare equal. ``None`` keeps a column as it is."""
    places = {f.name: {**EXACT, **special}.get(f.name, digits) for f in df.schema.fields
              if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[F.col(c) if places.get(c) is None else F.round(c, places[c]).alias(c) for c in df.columns])


def features(spark, sf_dir: str, complete: bool = False) -> DataFrame:
    return price_features(st.eod(spark, sf_dir), st.benchmark(spark, sf_dir), drop_incomplete=complete)


def predictions(spark, sf_dir: str) -> DataFrame:
    """Scored rows of all days, with the features they came from."""
    return (st.scored(features(spark, sf_dir))
            .withColumn("final_score", F.col("pred_a") * (1 - F.col("risk_prob"))))


def last_moment(spark, sf_dir: str) -> DataFrame:
    """One row: the newest event time, the stand-in for the current time."""
    return st.ticks(spark, sf_dir).agg(F.max("ts").alias("now"))
