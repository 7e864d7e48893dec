"""Exact ranks, quantiles and rank statistics without a global sort in one task.

Values are first counted, so ties collapse before any shuffle of rows. The distinct values are range-partitioned, which
samples its bounds from the values themselves, so the pieces are of about equal size also when all values lie in a narrow
band. Inside a piece a window counts the smaller values; offsets come from the pieces' sums, a few per group. The pieces
are written before they are summed: bounds sampled a second time could differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from barograph.session import materialized


def value_ranks(df: DataFrame, value: str, groups: Sequence[str] = (), sums: Sequence[str] = (),
                weight: str | None = None) -> DataFrame:
    """(groups, value, n, before, total[, sums]): how often a value occurs and how many rows are smaller.

    ``weight`` counts a row several times.
    """
    groups = list(groups)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*groups, value)
              .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"), *[F.sum(s).alias(s) for s in sums]))
    cut = counts.repartitionByRange(*groups, value).withColumn("_piece", F.spark_partition_id())
    inside = Window.partitionBy(*groups, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    cut = materialized(cut.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))))
    by_group = Window.partitionBy(*(groups or [F.lit(0)]))
    pieces = (cut.groupBy(*groups, "_piece").agg(F.sum("n").alias("_n"))
              .select(*groups, "_piece", F.sum("_n").over(by_group).alias("total"),
                      F.coalesce(F.sum("_n").over(by_group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)),
                                 F.lit(0)).alias("_off")))
    return (cut.join(pieces, [*groups, "_piece"])
            .select(*groups, value, "n", (F.col("_off") + F.col("_in")).alias("before"), "total", *sums))


def quantiles(df: DataFrame, value: str, probs: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles, one column per entry, and the number of values as ``n``."""
    ranked = value_ranks(df, value, groups)
    aggs = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("total") - 1)
        pick = lambda pos: F.max(F.when((F.col("before") <= pos) & (pos < F.col("before") + F.col("n")), F.col(value)))
        low, high, share = pick(F.floor(at)), pick(F.ceil(at)), F.max(at - F.floor(at))
        aggs.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*groups).agg(*aggs, F.max("total").alias("n"))


def spearman(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of two columns over the pairs without nulls, per group or as one row."""
    groups = list(groups)
    pairs = materialized(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*groups, x, y).agg(F.count(F.lit(1)).alias("_w")))
    # Both columns are ranked in one pass, as values of two sides.
    both = pairs.select(*groups, "_w", F.inline(F.array(*[F.struct(F.lit(k).alias("_side"), F.col(c).cast("double").alias("_value"))
                                                        for k, c in enumerate((x, y))])))
    ranks = value_ranks(both, "_value", [*groups, "_side"], weight="_w")
    # ranks are centred before they are multiplied, so large tables keep their precision
    centred = (F.col("before") + (F.col("n") - F.col("total")) / 2)
    side = lambda k, name: ranks.where(F.col("_side") == k).select(*groups, F.col("_value").alias(f"_v_{k}"), centred.alias(name))
    keyed = pairs.select(*groups, "_w", F.col(x).cast("double").alias("_v_0"), F.col(y).cast("double").alias("_v_1"))
    joined = keyed.join(side(0, f"_r_{x}"), [*groups, "_v_0"]).join(side(1, f"_r_{y}"), [*groups, "_v_1"])
    rx, ry, w = F.col(f"_r_{x}"), F.col(f"_r_{y}"), F.col("_w")
    return joined.groupBy(*groups).agg(
        F.try_divide(F.sum(w * rx * ry), F.sqrt(F.sum(w * rx * rx) * F.sum(w * ry * ry))).alias("spearman"),
        F.sum("_w").alias("n"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from the rank sum of the positives; ties share their mean rank."""
    ranked = value_ranks(df.select(score, F.col(label).cast("double").alias("_pos")), score, sums=["_pos"])
    pos, rank = F.sum("_pos"), F.col("before") + (F.col("n") + 1) / 2
    n = F.max("total")
    return ranked.agg(F.try_divide(F.sum(F.col("_pos") * rank) - pos * (pos + 1) / 2, pos * (n - pos)).alias("auc"))
