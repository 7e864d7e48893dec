"""Forward labels, outcomes and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barograph.operators.daily_features import complete_rows


def outcomes(bars: DataFrame, horizon: int = 14, key: str = "symbol") -> DataFrame:
    """Best and worst close of the next ``horizon`` bars relative to today's, and how many bars there are."""
    frame = f"over (partition by {key} order by day rows between 1 following and {horizon} following)"
    return (bars.selectExpr(key, "day", "close", f"max(close) {frame} as _hi", f"min(close) {frame} as _lo",
                            f"count(close) {frame} as ahead")
            .selectExpr(key, "day", "close as entry_close", "ahead", "try_divide(_hi - close, close) as max_return",
                        "try_divide(_lo - close, close) as drawdown"))


def labels(bars: DataFrame, horizon: int = 14, threshold: float = 0.06, mode: str = "forward",
           key: str = "symbol") -> DataFrame:
    """Upside label and risk label. ``mode='trailing'`` puts the risk frame at rows -12..+1 and reads missing as 0."""
    base = outcomes(bars, horizon, key)
    full = F.col("ahead") == horizon
    upside = F.when(full, F.col("max_return")).alias("label_upside")
    if mode == "forward":
        risk = F.when(full, (F.col("drawdown") <= -threshold).cast("int"))
        return base.select(key, "day", upside, risk.alias("label_risk"))
    if mode != "trailing":
        raise ValueError(mode)
    frame = f"over (partition by {key} order by day rows between {horizon - 2} preceding and 1 following)"
    low = (f"if(count(entry_close) {frame} = {horizon} and lead(day) over (partition by {key} order by day) is not null, "
           f"min(entry_close) {frame}, null)")
    return (base.selectExpr("*", f"{low} as _low")
            .select(key, "day", upside, F.coalesce((F.try_divide(F.col("_low") - F.col("entry_close"), F.col("entry_close"))
                                                    <= -threshold).cast("int"), F.lit(0)).alias("label_risk")))


def win(max_return: str = "max_return", drawdown: str = "drawdown", limit: float = -0.05) -> str:
    """SQL predicate: the price rose and never fell below the limit."""
    return f"({max_return} > 0 and {drawdown} > {limit}d)"


def training_set(features: DataFrame, labelled: DataFrame, min_rows: int = 50, key: str = "symbol") -> DataFrame:
    """Complete rows with both labels, of symbols with enough bars. The row count per symbol is bounded by its days."""
    enough = features.withColumn("_bars", F.count(F.lit(1)).over(Window.partitionBy(key))).where(F.col("_bars") >= min_rows)
    return (complete_rows(enough.drop("_bars")).join(labelled, [key, "day"])
            .dropna(subset=["label_upside", "label_risk"]))


def time_split(rows: DataFrame, train_end: str, test_start: str, purge_days: int = 0) -> DataFrame:
    """Adds ``part``. Rows between the bounds, or in the purge zone before the end of training, are left out."""
    day = F.col("day")
    last = F.date_sub(F.to_date(F.lit(train_end)), purge_days)
    part = F.when(day <= last, "train").when(day >= F.to_date(F.lit(test_start)), "test")
    return rows.withColumn("part", part).where(F.col("part").isNotNull())
