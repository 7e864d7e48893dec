"""Exact de-duplication by an extendible-hash index.

A 64-bit hash of each text is its key. A directory of 2**depth slots, addressed by the leading bits, points to buckets;
an overfull bucket is split by one more bit, and the directory doubles when a bucket needs more bits than it has. Each
bucket belongs to one owner task, owners hold consecutive buckets (key ranges). Within a bucket, entries with the same
key form a chain, and texts are equal only if their bytes are. The index is a table in the shared folder.

Defined results: a null text counts as empty; equal empty texts are one group; a null doc_id is smaller than any other;
rows repeated with the same doc_id and text are kept or dropped together; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm.staging import partitions, staged

#: The histogram that the directory grows from has 2**MAX_DEPTH counters, whatever the input; deeper keys are chained.
MAX_DEPTH = 14


@dataclass(frozen=True)
class Directory:
    """slots[leading bits] is the bucket; buckets are numbered in key order."""

    depth: int
    slots: np.ndarray

    @property
    def buckets(self) -> int:
        return int(self.slots[-1]) + 1


def grow_directory(weights: np.ndarray, capacity: float) -> Directory:
    """Split every bucket whose weight is over capacity; weights has one counter for each MAX_DEPTH-bit prefix."""
    full_depth = int(np.log2(len(weights)))
    sums = np.concatenate([[0], np.cumsum(weights, dtype=np.float64)])
    depth, done, todo = 0, [], [(0, 0)]
    while todo:
        local, prefix = todo.pop()
        width = 1 << (full_depth - local)
        if sums[(prefix + 1) * width] - sums[prefix * width] > capacity and local < full_depth:
            depth = max(depth, local + 1)
            todo += [(local + 1, 2 * prefix), (local + 1, 2 * prefix + 1)]
        else:
            done.append((prefix * width, width))
    slots = np.zeros(1 << depth, np.int32)
    for number, (start, width) in enumerate(sorted(done)):
        step = 1 << (full_depth - depth)
        slots[start // step : (start + width) // step] = number
    return Directory(depth, slots)


def _leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies inside a batch become one entry before anything is moved."""
    for batch in batches:
        seen: dict[bytes, list] = {}
        keys, owners, texts = (batch.column(i) for i in (0, 1, 3))
        for row, (text, doc_id) in enumerate(zip(texts.cast(pa.binary()).to_pylist(), batch.column(2).to_pylist())):
            entry = seen.setdefault(text, [row, doc_id, 0])
            entry[1] = doc_id if entry[1] is None or (doc_id is not None and doc_id > entry[1]) else entry[1]
            entry[2] += 1
        rows = pa.array([e[0] for e in seen.values()], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [keys.take(rows), owners.take(rows), pa.array([e[1] for e in seen.values()], pa.int64()),
             pa.array([e[2] for e in seen.values()], pa.int64()), texts.take(rows)],
            names=["key", "owner", "keep_id", "copies", "text"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one owner, sorted by key: entries of a key are a chain, compared byte by byte."""
    names = ["key", "text_sha256", "keep_id", "group_size"]
    key, chain = None, []

    def closed(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, *_ in found], pa.int64()), pa.array([d for _, d, *_ in found], pa.binary()),
             pa.array([i for *_, i, _ in found], pa.int64()), pa.array([n for *_, n in found], pa.int64())], names=names)

    for batch in batches:
        found = []
        for k, doc_id, copies, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(),
                                           batch.column(3).to_pylist(), batch.column(4).cast(pa.binary()).to_pylist()):
            if k != key:
                found += [(key, hashlib.sha256(t).digest(), i, n) for t, i, n in chain]
                key, chain = k, []
            for entry in chain:
                if entry[0] == text:
                    entry[1] = doc_id if entry[1] is None or (doc_id is not None and doc_id > entry[1]) else entry[1]
                    entry[2] += copies
                    break
            else:
                chain.append([text, doc_id, copies])
        if found:
            yield closed(found)
    if chain:
        yield closed([(key, hashlib.sha256(t).digest(), i, n) for t, i, n in chain])


def build_index(docs: DataFrame, bucket_bytes: int = 8 << 20) -> DataFrame:
    """The index: one row (key, text_sha256, keep_id, group_size) for each distinct text."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select(F.xxhash64("text").alias("key"), "doc_id", "text")
    prefix = _leading(F.col("key"), MAX_DEPTH).alias("prefix")
    weights = np.zeros(1 << MAX_DEPTH)
    for row in texts.groupBy(prefix).agg(F.sum(F.octet_length("text") + 16).alias("w")).collect():  # 2**MAX_DEPTH rows
        weights[row.prefix] = row.w
    directory = grow_directory(weights, max(bucket_bytes, weights.sum() / len(weights)))
    owners = min(directory.buckets, partitions(spark))
    slots = spark.createDataFrame(
        [(i, int(b) * owners // directory.buckets) for i, b in enumerate(directory.slots)], "slot int, owner int")
    placed = (texts.withColumn("slot", _leading(F.col("key"), directory.depth))
              .join(F.broadcast(slots), "slot")  # 2**MAX_DEPTH rows at most
              .select("key", "owner", "doc_id", "text"))
    entries = placed.mapInArrow(_combined, "key long, owner int, keep_id long, copies long, text string")
    owned = entries.repartitionById(owners, F.col("owner")).sortWithinPartitions("key")
    return staged(owned.mapInArrow(_chained, "key long, text_sha256 binary, keep_id long, group_size long"), "exact-index")


def exact_duplicates(docs: DataFrame, bucket_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id (largest doc_id among equal texts), group_size, kept, text_sha256."""
    index = build_index(docs, bucket_bytes)
    text = F.coalesce("text", F.lit(""))
    members = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"),
                          F.unhex(F.sha2(text, 256)).alias("text_sha256"))
    return members.join(index, ["key", "text_sha256"], "left").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"))
