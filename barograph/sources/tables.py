"""Lake tables: layout, append, keyed upsert, schema growth, staging, exports, load state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql import types as T

from barograph.operators.bars import latest_version
from barograph.schemas import TABLES


def table_ddl(name: str, path: str, catalog_format: str = "parquet") -> str:
    """CREATE TABLE text of a registered table; the ``day`` partition column is added where the schema lacks it."""
    schema, parts = TABLES[name]
    fields = list(schema.fields) + [T.StructField(p, T.DateType()) for p in parts if p not in schema.fieldNames()]
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return (f"CREATE TABLE IF NOT EXISTS {name.replace('.', '_')} ({cols}) USING {catalog_format} "
            f"PARTITIONED BY ({', '.join(parts)}) LOCATION '{path}'")


def ensure_tables(spark: SparkSession, base: str, names: Sequence[str] = tuple(TABLES)) -> dict[str, str]:
    paths = {n: f"{base}/{n.replace('.', '/')}" for n in names}
    for name, path in paths.items():
        spark.sql(table_ddl(name, path))
    return paths


def refresh_tables(spark: SparkSession, base: str, names: Sequence[str] = tuple(TABLES)) -> None:
    """Catalog tables show the partitions that their folders have by now; call it after writes."""
    for name in names:
        if exists(spark, f"{base}/{name.replace('.', '/')}"):
            spark.sql(f"ALTER TABLE {name.replace('.', '_')} RECOVER PARTITIONS")
            spark.catalog.refreshTable(name.replace(".", "_"))


def table_schema(name: str) -> T.StructType:
    schema, parts = TABLES[name]
    return T.StructType(list(schema.fields) + [T.StructField(p, T.DateType()) for p in parts if p not in schema.fieldNames()])


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.schema(table_schema(name)).parquet(f"{base}/{name.replace('.', '/')}")


def with_day(rows: DataFrame) -> DataFrame:
    if "day" in rows.columns:
        return rows
    time = next(c for c in ("ts", "event_time") if c in rows.columns)
    return rows.withColumn("day", F.to_date(time))


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the target in its order; absent ones are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in schema.fields])


def grown_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    """The old columns, then those only the new rows have."""
    return T.StructType(list(old.fields) + [f for f in new.fields if f.name not in old.fieldNames()])


def write_partitions(rows: DataFrame, path: str, parts: Sequence[str] = ("day",)) -> None:
    """Replace only the partitions that occur in the rows. Rebalancing splits a hot day and merges small ones."""
    (rows.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*parts).parquet(path))


def append(rows: DataFrame, path: str, parts: Sequence[str] = ("day",)) -> None:
    rows.hint("rebalance", *parts).write.mode("append").partitionBy(*parts).parquet(path)


def merge_rows(target: DataFrame, updates: DataFrame, keys: Sequence[str], version: Sequence[str] = ()) -> DataFrame:
    """Target rows with updates on top; keys compare null-safe, one row per key. Both schemas may have grown."""
    schema = grown_schema(target.schema, updates.schema)
    both = conform(target, schema).withColumn("_v", F.lit(0)).unionByName(conform(updates, schema).withColumn("_v", F.lit(1)))
    return latest_version(both, list(keys), ["_v", *version]).drop("_v")


def upsert(updates: DataFrame, path: str, schema: T.StructType, keys: Sequence[str], *, version: Sequence[str] = (),
           part: str = "day", cleared: DataFrame | None = None, write: Callable[[DataFrame], None] | None = None) -> None:
    """Keyed upsert into a partitioned parquet table; rows with a key of ``cleared`` go first (it has ``part``, too).

    ``write`` replaces the partitions that occur in its rows, where a table has a layout of its own.

    Only partitions that the updates touch are read and replaced. The merged rows are staged under an id of their own,
    with the list of touched partitions written last; then they replace the partitions, and the stage goes. A stage that
    is complete when the next upsert begins belongs to a run that broke off, and is replayed first. So the table is never
    left without rows that it had, and running the same updates again gives the same table.
    """
    spark = updates.sparkSession
    replay_stages(spark, path, schema, part, write)
    stage_upsert(updates, path, schema, keys, version=version, part=part, cleared=cleared)
    replay_stages(spark, path, schema, part, write)


def stage_upsert(updates: DataFrame, path: str, schema: T.StructType, keys: Sequence[str], *, version: Sequence[str] = (),
                 part: str = "day", cleared: DataFrame | None = None) -> str:
    """The first half of an upsert: merged rows and touched partitions as files."""
    spark = updates.sparkSession
    updates = conform(updates if part in updates.columns else with_day(updates), schema)
    days = updates.select(part)
    if cleared is not None:
        days = days.unionByName(cleared.select(part))
    days = days.distinct()
    target = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    target = target.join(days, part, "left_semi")
    if cleared is not None:
        target = target.join(cleared, cleared.columns, "left_anti")
    stage = f"{path.rstrip('/')}_stage/{uuid.uuid4().hex}"
    merge_rows(target, updates, keys, version).hint("rebalance", part).write.partitionBy(part).parquet(f"{stage}/rows")
    days.coalesce(1).write.parquet(f"{stage}/parts")
    return stage


def replay_stages(spark: SparkSession, path: str, schema: T.StructType, part: str = "day",
                  write: Callable[[DataFrame], None] | None = None) -> None:
    """Swap complete stages in; incomplete ones were never visible and stay where they are."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}_stage")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return
    found = sorted(fs.listStatus(root), key=lambda x: x.getModificationTime())
    for stage in [x.getPath() for x in found]:
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(stage, "parts/_SUCCESS")):
            continue
        rows = spark.read.schema(schema).parquet(f"{stage}/rows")
        if write:
            write(rows)
        else:
            write_partitions(rows, path, (part,))
        # Partitions that lost all their rows; a list of touched partitions is short.
        gone = spark.read.parquet(f"{stage}/parts").join(rows.select(part).distinct(), part, "left_anti").collect()
        for row in gone:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}={row[0]}"), True)
        fs.delete(stage, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def merge_statement(table: str, view: str, keys: Sequence[str]) -> str:
    """The same upsert for catalogs with MERGE."""
    on = " AND ".join(f"t.`{k}` <=> u.`{k}`" for k in keys)
    return f"MERGE INTO {table} AS t USING {view} AS u ON {on} WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *"


def stage_run(rows: DataFrame, base: str, run_id: str, stage: str) -> DataFrame:
    """Write a stage's rows under the run and read them back: later stages start from files, not from lineage."""
    path = f"{base}/runs/{run_id}/{stage}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def stage_metrics(day: str = "day") -> dict[str, Column]:
    """What a manifest says about a stage's rows. The set of symbols, a dimension, is the only metric that is not a number."""
    return {"rows": F.count(F.lit(1)), "first_day": F.min(day), "last_day": F.max(day), "symbols": F.size(F.collect_set("symbol"))}


def observed(rows: DataFrame, metrics: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows, and metrics that are there once the rows have been written."""
    seen = Observation(f"m{uuid.uuid4().hex}")
    return rows.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen


def measured_run(rows: DataFrame, base: str, run_id: str, stage: str, metrics: Mapping[str, Column]) -> tuple[DataFrame, dict]:
    """A stage's rows read back from the run, and metrics taken while they were written: the rows are passed once."""
    watched, seen = observed(rows, metrics)
    return stage_run(watched, base, run_id, stage), seen.get


def manifest_table(spark: SparkSession, run_id: str, stages: Sequence[tuple[str, Sequence[str], Mapping]]) -> DataFrame:
    """One row per stage, with its columns, from measured metrics; as long as the job has stages."""
    rows = [(run_id, stage, m["rows"], m["first_day"], m["last_day"], m["symbols"], list(columns), m.get("rejected")) for stage, columns, m in stages]
    return spark.createDataFrame(rows, "run_id string, stage string, rows long, first_day date, last_day date, symbols long, "
                                       "columns array<string>, rejected long").coalesce(1)


def run_manifest(rows: DataFrame, run_id: str, stage: str, day: str = "day") -> DataFrame:
    """One row about a stage's output, for the table of runs."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
                    F.count_distinct("symbol").alias("symbols")).select(
        F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"), "*",
        F.array(*[F.lit(c) for c in rows.columns]).alias("columns"))


def preview(predictions: DataFrame) -> DataFrame:
    """Prediction table for people: percentages, newest day and best score first."""
    up, risk = F.col("pred_a") * 100, F.col("risk_prob") * 100
    return predictions.select(
        "day", "symbol", "entry_price", "pred_a", up.alias("upside_pct"), "risk_prob", risk.alias("risk_prob_pct"), "final_score",
        (up * (1 - risk / 100)).alias("final_score_pct")).orderBy(F.desc("day"), F.desc("final_score"), "symbol")


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_jdbc(rows: DataFrame, options: Mapping[str, str], table: str) -> None:
    """Append to a relational table; the driver jar and its options come from the caller."""
    rows.write.format("jdbc").options(**options).option("dbtable", table).mode("append").save()


def sink_jdbc(options: Mapping[str, str], table: str) -> Callable[[DataFrame, int], None]:
    return lambda rows, batch_id: write_jdbc(rows.withColumn("source_batch_id", F.lit(batch_id)), options, table)


def load_windows(symbols: DataFrame, stored: DataFrame, as_of: str, initial_start: str, backfill_days: int,
                 mode: str = "incremental") -> DataFrame:
    """First and last day to load per symbol.

    ``incremental`` starts some days before the newest stored day and at the initial date for unknown symbols;
    ``rolling`` always starts the same number of days before the target.
    """
    newest = stored.groupBy("symbol").agg(F.max("day").alias("max_day"))
    day = F.to_date(F.lit(as_of))
    rows = symbols.select("symbol").distinct().join(newest, "symbol", "left")
    known = F.lit(mode == "rolling") | F.col("max_day").isNotNull()
    base = day if mode == "rolling" else F.least(F.col("max_day"), day)
    return rows.select(
        "symbol", "max_day", F.when(known, F.date_sub(base, backfill_days)).otherwise(F.to_date(F.lit(initial_start)))
        .alias("start_day"), F.date_add(day, 1).alias("end_day"),
        F.when(known, "rolling_overwrite").otherwise("initial_load").alias("load_mode"))


def table_state(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct days and newest day per wanted symbol; zero where there are none."""
    state = rows.groupBy("symbol").agg(F.count_distinct("day").alias("days"), F.max("day").alias("last_day"))
    return symbols.select("symbol").distinct().join(state, "symbol", "left").select(
        "symbol", F.coalesce("days", F.lit(0)).alias("days"), "last_day")
