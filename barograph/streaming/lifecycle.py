"""Opening sources, writing sinks, and running several queries together."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from barograph.schemas import RAW_STREAM
from barograph.sources.tables import table_schema, with_day


@dataclass(frozen=True)
class StreamSource:
    """``kind`` is ``kafka`` (options: bootstrap servers) or a file format with the same four columns."""

    kind: str
    topic: str
    path: str = ""
    options: dict[str, str] = field(default_factory=dict)


def open_stream(spark: SparkSession, source: StreamSource) -> DataFrame:
    """(value, topic, partition, offset); new messages only for a topic."""
    if source.kind == "kafka":
        raw = (spark.readStream.format("kafka").option("subscribe", source.topic).option("startingOffsets", "latest")
               .options(**source.options).load())
        return raw.select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset")
    raw = spark.readStream.schema(RAW_STREAM).options(**source.options).format(source.kind).load(source.path)
    return raw.where(F.col("topic") == source.topic)


def open_table(spark: SparkSession, base: str, name: str, **options: str) -> DataFrame:
    """A lake table as a stream of its new files."""
    return spark.readStream.schema(table_schema(name)).options(**options).parquet(f"{base}/{name.replace('.', '/')}")


def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def append_stream(rows: DataFrame, path: str, checkpoint: str, every: str | None = None, name: str | None = None) -> StreamingQuery:
    """Exactly-once append to files by day."""
    writer = (with_day(rows).writeStream.format("parquet").partitionBy("day").option("path", path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    return _trigger(writer.queryName(name) if name else writer, every).start()


Sink = Callable[[DataFrame, int], None]


def lake_sink(path: str) -> Sink:
    """Append by batch: a repeated batch replaces its own partition and nothing else."""
    def write(rows: DataFrame, batch_id: int) -> None:
        (with_day(rows).withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(path))
    return write


def to_sinks(rows: DataFrame, sinks: Sequence[Sink], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each micro-batch goes to every sink; it is computed once and kept for the second sink."""
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for sink in sinks:
                sink(kept, batch_id)
        finally:
            kept.unpersist()
    return _trigger(rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append"), every).start()


def without_repeats(rows: DataFrame, delay: str = "10 minutes", keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Drop repeats of a key that arrive within the delay; the state is bounded by the watermark."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def run_together(spark: SparkSession, started: Sequence[StreamingQuery]) -> None:
    """Wait until all end; when one fails, stop the others and raise."""
    try:
        for query in started:
            while query.isActive:
                spark.streams.awaitAnyTermination()
                spark.streams.resetTerminated()
            if query.exception():
                raise query.exception()
    finally:
        for query in started:
            if query.isActive:
                query.stop()
