"""The corpus pipeline: documents without toxic texts, near copies and benchmark passages, mixed and dealt to shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet to the shared folder and
read again as the next stage's docs. All but the last return the columns of documents; the last adds virtual_slot and
shard. Nulls, empty tables, repeated rows and extra columns are treated as the operators' own texts say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barograph.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from barograph.llm.staging import staged

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted to the labels of these documents, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the least doc_id, of each group linked at 0.8 on shingles of five words; null and repeated ids, too."""
    return near_dedup.deduplicated(docs, size=5)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item.

    An item of fewer words takes away only documents that it makes up by half or more: "yes" alone is no evidence.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_share=0.5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as systematic sampling to the sources' targets emits it."""
    return mixing.mixed(docs)


def deal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their virtual slot and shard."""
    return sharding.repartitioned(docs, SHARDS)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark),
          ("mixing", mix), ("sharding", deal)]

#: SQL can't express the toxicity grammar; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
