"""Splitting long time series into overlapping blocks.

A window over one key runs in one task, so a key that holds a third of all rows would make one task do a third of the
work. Operators with a finite look-back do not need the whole series: rows are numbered per key in two steps (inside a
time slice, then by slice offsets), cut into blocks, and each block also gets the last ``halo`` rows before it. Windows
over (key, block) then give the same values as windows over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def number_rows(df: DataFrame, key: str = "symbol", ts: str = "ts", slice_unit: str = "day",
                slice_by: Column | None = None) -> DataFrame:
    """Row number per key in time order, without a window over the whole key. ``ts`` must be unique per key.

    Only the slice counts (one row per key and slice) are windowed by key. ``slice_by`` replaces the time unit by any
    expression that does not decrease along ``ts``.
    """
    sliced = df.withColumn("_slice", F.date_trunc(slice_unit, F.col(ts)) if slice_by is None else slice_by)
    counts = sliced.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(key, "_slice").orderBy(ts)
    return (sliced.join(offsets, [key, "_slice"])
            .withColumn("rn", F.col("_off") + F.row_number().over(inside)).drop("_slice", "_off"))


def with_halo(numbered: DataFrame, halo: int, block: int) -> DataFrame:
    """Copy the last ``halo`` rows of a block to the next one. ``_own`` marks a row's home block."""
    if halo > block:
        raise ValueError("the halo must not be longer than a block")
    home = F.floor((F.col("rn") - 1) / block)
    place = (F.col("rn") - 1) % block
    homes = F.when(place >= block - halo, F.array(home, home + 1)).otherwise(F.array(home))
    return numbered.withColumn("block", F.explode(homes)).withColumn("_own", F.col("block") == home)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "block")
