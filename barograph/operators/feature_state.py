"""Daily features that go on from a stored state: a new day reads one state row per symbol and its own bars.

A state holds the last HALO bars of a symbol with the benchmark aligned to them, and the running values (row number, peak,
sums, exponential means) at the first of these bars. Rows made of the stored bars and the new ones give the new bars the
same features as the whole history does: every look-back of the contract ends inside the stored bars, and whatever has
no end is in the running values. ``operators.daily_features`` has the only definition of the features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barograph.functions.rolling import Series
from barograph.operators.daily_features import indicator_rows
from barograph.schemas import CARRIED, FEATURE_STATE

#: Bars in a state: the longest look-back of the contract, the 52-week high, has 252 rows with its own.
HALO = 252
_BAR = ("day", "high", "low", "close", "volume", "bench")


def resumed_rows(states: DataFrame, bars: DataFrame, bench: DataFrame, adjust: bool = True) -> DataFrame:
    """Indicator rows of the states' bars (``new`` is false) and the bars after them, in one series per symbol.

    ``states`` has one row per symbol at most; bars of a symbol without one begin its series. Columns that a later state
    needs (CARRIED) are among the rows.
    """
    w = Series(["symbol"], "day")
    halo = states.select("symbol", "carry", F.posexplode("halo").alias("_at", "_bar"))
    first = F.col("_at") == 0
    kinds = {f.name: f.dataType for f in FEATURE_STATE["carry"].dataType.fields}
    old = halo.select("symbol", *[F.col(f"_bar.{c}").alias(c) for c in _BAR],
                      *[F.when(first, F.col(f"carry.{c}")).alias(f"c_{c}") for c in CARRIED], F.lit(False).alias("new"))
    late = bars.select("symbol", "day", *[F.col(c).cast("double").alias(c) for c in _BAR[1:5]]).join(
        bench.select("day", F.col("close").alias("bench")), "day", "left")
    late = late.select("symbol", *_BAR, *[F.lit(None).cast(kinds[c]).alias(f"c_{c}") for c in CARRIED], F.lit(True).alias("new"))
    rows = old.unionByName(late).withColumn("bench", F.expr(w.so_far("last(bench, true)")))
    rows = indicator_rows(rows, adjust=adjust, resumed=True)
    return rows.selectExpr(
        "*", f"{w.so_far('sum(coalesce(c_seen, if(bench is null, 0, 1)))')} as seen",
        f"pos - {w.so_far('last(if(c_dx_gap is not null, pos - c_dx_gap, if(dx is not null, pos, null)), true)')} as dx_gap")


def kept_days(rows: DataFrame) -> DataFrame:
    """(symbol, rn) of the new rows that leave a state: each symbol's last row, and its first row of every month."""
    w = "partition by symbol order by day"
    flagged = rows.selectExpr("symbol", "rn", "new", f"lead(day) over ({w}) is null as _last",
                              f"coalesce(trunc(lag(day) over ({w}), 'month') <> trunc(day, 'month'), true) as _first")
    return flagged.where("new and (_last or _first)").select("symbol", "rn")


def next_states(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """States after the wanted rows. A bar goes to the few wanted rows whose look-back it is in, not to every later row."""
    ends = wanted.groupBy("symbol").agg(F.collect_list("rn").alias("_ends"))
    kinds = {f.name: f.dataType for f in FEATURE_STATE["carry"].dataType.fields}
    near = rows.select("symbol", "rn", F.struct(*_BAR).alias("_bar"), F.struct(*[F.col(c).cast(kinds[c]).alias(c) for c in CARRIED]).alias("_carry"))
    near = near.join(ends, "symbol").withColumn(
        "_end", F.explode(F.filter("_ends", lambda q: (q >= F.col("rn")) & (q < F.col("rn") + HALO))))
    begins = (F.col("rn") == F.col("_end") - HALO + 1) & (F.col("rn") > 1)
    states = near.groupBy("symbol", "_end").agg(F.max("_bar.day").alias("day"), F.max(F.when(begins, F.col("_carry"))).alias("carry"),
                                                F.array_sort(F.collect_list("_bar")).alias("halo"))
    return states.select("day", "symbol", F.col("_end").cast("long").alias("rn"), "carry", "halo")


def thinned(states: DataFrame) -> DataFrame:
    """Of each symbol and month only the first state: enough to replay from for days that seldom change."""
    return states.groupBy("symbol", F.trunc("day", "month").alias("_m")).agg(F.min("day").alias("day")).drop("_m").join(
        states, ["symbol", "day"]).select(states.columns)
