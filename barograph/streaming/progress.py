"""Progress of running queries as a table, and the lag between a source and what has been stored."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from barograph.schemas import PROGRESS
from barograph.sources.tables import append
from barograph.streaming.lifecycle import StreamSource


def progress_rows(progress: Mapping) -> list[tuple]:
    """One row per source of a progress report (as its JSON has it)."""
    moment = datetime.fromisoformat(progress["timestamp"].replace("Z", "+00:00"))
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x, sort_keys=True)
    return [(progress.get("name") or progress["id"], progress["runId"], progress["batchId"], s["description"], text(s.get("startOffset")),
             text(s.get("endOffset")), text(s.get("latestOffset")), s["numInputRows"], float(s.get("processedRowsPerSecond") or 0.0),
             moment, moment.date()) for s in progress["sources"]]


class ProgressLog(StreamingQueryListener):
    """Keeps the reports of all queries of a session until they are written; the oldest go first beyond ``most``."""

    def __init__(self, most: int = 10_000):
        self.rows: deque[tuple] = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows.extend(progress_rows(json.loads(event.progress.json)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def flush(self, spark: SparkSession, base: str) -> int:
        """Append what has been reported since the last call to the table of progress."""
        rows = [self.rows.popleft() for _ in range(len(self.rows))]
        if rows:
            append(spark.createDataFrame(rows, PROGRESS).coalesce(1), f"{base}/ops/progress")
        return len(rows)


def newest_offsets(progress: DataFrame) -> DataFrame:
    """(topic, partition, latest_offset) from the newest report of each topic source: the last message it then had."""
    kafka = progress.where(F.col("latest_offset").isNotNull())
    newest = kafka.groupBy("query", "source").agg(F.max_by("latest_offset", F.struct("ts", "batch_id")).alias("_o"))
    topics = newest.select(F.explode(F.from_json("_o", "map<string,map<string,bigint>>")).alias("topic", "_p"))
    return topics.select("topic", F.explode("_p").alias("partition", "_n")).groupBy(
        "topic", F.col("partition").cast("int").alias("partition")).agg((F.max("_n") - 1).alias("latest_offset"))


def source_offsets(spark: SparkSession, source: StreamSource) -> DataFrame:
    """The same for a source of files, from the files it has now."""
    rows = spark.read.format(source.kind).options(**source.options).load(source.path)
    return rows.where(F.col("topic") == source.topic).groupBy("topic", "partition").agg(F.max("offset").alias("latest_offset"))


def with_lag(report: DataFrame, latest: DataFrame) -> DataFrame:
    """An offset report with the source's newest offset and how many offsets are still to come; also of partitions not read yet."""
    both = report.join(latest, ["topic", "partition"], "full")
    return both.withColumn("lag", F.greatest(F.col("latest_offset") - F.coalesce("last_offset", F.lit(-1)), F.lit(0)))


def throughput(progress: DataFrame) -> DataFrame:
    """Per query: batches, rows, and when it last made progress."""
    return progress.groupBy("query").agg(F.count_distinct("run_id", "batch_id").alias("batches"), F.sum("input_rows").alias("rows"),
                                         F.max("ts").alias("last_progress"))


def stalled(progress: DataFrame, names: Iterable[str], now: str, minutes: int) -> DataFrame:
    """Of the named queries those without any progress in the last minutes."""
    seen = throughput(progress)
    wanted = progress.sparkSession.createDataFrame([(n,) for n in names], "query string")
    late = F.col("last_progress").isNull() | (F.col("last_progress") < F.expr(f"timestamp'{now}' - interval {minutes} minutes"))
    return wanted.join(seen, "query", "left").where(late).select("query", "last_progress")
