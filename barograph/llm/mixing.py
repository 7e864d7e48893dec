"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / source size copies. Documents are laid out by falling size, expected
copies are summed up in that order, one random offset per source is added, and a document is emitted once for each
integer boundary that its part of the sum crosses. Laying out by size keeps the taken words near the target.

Prefix sums are distributed: rows are range-partitioned, counted per partition and source, and offset by the counts of
the partitions before; no task sees a whole source.

Defined results: a null text has no words; null is a source of its own, the last; repeated rows are drawn each for
itself; sources without words have target 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.llm.staging import staged

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0


def n_words(text: Column) -> Column:
    """Number of runs outside space and tab to carriage return; counted where such a run begins."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    spaces = F.length(squeezed) - F.length(F.translate(squeezed, " ", ""))
    return F.when(F.length(squeezed) == 0, 0).otherwise(spaces + 1).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size -> target: `share` of all words by weight, filled up to `cap` times a source's size.

    Sources in the order of cap / weight fill first; a source is full if the level that the others reach is above it.
    One row per source comes in, so the windows without a key are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    which = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (which % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*", F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("filled"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
        (F.lit(share) * F.sum("source_size").over(everything)).alias("budget"))
    rows = rows.withColumn("level", (F.col("budget") - F.col("filled")) / F.col("weight_left"))
    fits = F.col("level") * F.col("weight") <= F.col("most")
    rows = rows.withColumn("open_level", F.max(F.when(fits, F.struct(-F.col("filled"), "level"))).over(everything)["level"])
    return rows.select("source", "source_size", F.when(fits, F.col("open_level") * F.col("weight"))
                       .otherwise(F.col("most")).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(source, F.lit("/none"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(docs: DataFrame, seed: int = 0, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document; with carry, the whole row as struct `row`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"),
                       *([F.struct(*docs.columns).alias("row")] if carry else []))
    if not carry:  # the range partitioning samples its input first; words are counted once for both passes
        rows = staged(rows, "mixing-sizes")
    rows = rows.withColumn("tie", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("tie")]
    laid_out = rows.repartitionByRange(*order).sortWithinPartitions(*order, "doc_id")
    place = F.monotonically_increasing_id()
    rows = staged(laid_out.select("*", F.shiftright(place, 33).alias("partition"),
                                  place.bitwiseAND((1 << 33) - 1).alias("place")).drop("tie"), "mixing-order")
    counts = rows.groupBy("source", "partition").agg(F.count("*").alias("n"), F.min("place").alias("first"),
                                                     F.sum("size").alias("words"))
    filled = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")))
    before = Window.partitionBy("source").orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", F.col("partition").alias("p"),
                           (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    filled = filled.withColumnRenamed("source", "named")
    starts = starts.join(filled, F.col("source").eqNullSafe(F.col("named"))).drop("named").withColumnRenamed("source", "s")
    rows = rows.join(starts, (F.col("partition") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank, shift = F.col("start") + F.col("place"), offset(F.col("source"), seed)
    crossed = F.floor((rank + 1) * rate + shift) - F.floor(rank * rate + shift)
    return rows.select("doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"),
                       *(["row"] if carry else []))


def mixed_sizes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document, also of those that the mix leaves out."""
    return copies(docs, seed).select("doc_id", "size", "source_size", "target",
                                     (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: each row of docs as often as it is emitted, with the columns of docs."""
    drawn = copies(docs, seed, carry=True).where(F.col("copies") > 0)
    return drawn.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
