"""Shards by fixed virtual slots.

Records are hashed into a fixed number of slots; bytes are summed per slot; a versioned map assigns slots to shards.
Rebalancing or growing edits the map and moves whole slots, never single records. The law of the query is `bytes`:
slots go, largest first, to the lightest shard, so that sizes come out near equal.

Defined results: a null text has no bytes and checksum 0; a null doc_id is hashed like a value; repeated rows get
places of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 4096
#: Each slot is numbered in so many parts, so that no task orders a whole slot.
PARTS = 16


@dataclass(frozen=True)
class SlotMap:
    """A version of the slot-to-shard map."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def packed(cls, weights: np.ndarray, shards: int) -> SlotMap:
        """Version 1: slots by falling weight, each to the shard that is lightest so far."""
        loads, shard_of = [(0, s) for s in range(shards)], [0] * len(weights)
        for slot in np.lexsort((np.arange(len(weights)), -weights)).tolist():
            load, shard = heapq.heappop(loads)
            shard_of[slot] = shard
            heapq.heappush(loads, (load + int(weights[slot]), shard))
        return cls(1, shards, tuple(shard_of))

    def loads(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(np.array(self.shard_of), weights=weights, minlength=self.shards)

    def rebalanced(self, weights: np.ndarray, tolerance: float = 0.02) -> SlotMap:
        """The next version: slots move from the heaviest to the lightest shard until all are within the tolerance."""
        shard_of, loads = list(self.shard_of), self.loads(weights)
        aim = weights.sum() / self.shards
        while loads.max() > aim * (1 + tolerance):
            giver, taker = int(loads.argmax()), int(loads.argmin())
            gap = (loads[giver] - loads[taker]) / 2
            own = [s for s, shard in enumerate(shard_of) if shard == giver and 0 < weights[s] < 2 * gap]
            if not own:
                break
            slot = min(own, key=lambda s: (abs(weights[s] - gap), s))
            shard_of[slot] = taker
            loads[giver] -= weights[slot]
            loads[taker] += weights[slot]
        return replace(self, version=self.version + 1, shard_of=tuple(shard_of))

    def grown(self, weights: np.ndarray, shards: int) -> SlotMap:
        """The next version with more shards: slots move only into the new ones."""
        shard_of, loads = list(self.shard_of), list(self.loads(weights)) + [0.0] * (shards - self.shards)
        aim = weights.sum() / shards
        for slot in np.argsort(-weights, kind="stable").tolist():
            giver, taker = shard_of[slot], min(range(self.shards, shards), key=loads.__getitem__)
            if giver < self.shards and loads[giver] - weights[slot] >= aim and loads[taker] + weights[slot] <= aim:
                shard_of[slot] = taker
                loads[giver] -= weights[slot]
                loads[taker] += weights[slot]
        return SlotMap(self.version + 1, shards, tuple(shard_of))

    def save(self, spark: SparkSession, folder: str) -> None:
        """Add this version to the map's folder; older versions stay readable."""
        rows = [(slot, shard, self.shards) for slot, shard in enumerate(self.shard_of)]
        table = spark.createDataFrame(rows, "slot int, shard int, shards int").coalesce(1)
        table.write.mode("overwrite").parquet(f"{folder}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int) -> SlotMap:
        rows = sorted(spark.read.parquet(f"{folder}/version={version}").collect())
        return cls(version, rows[0].shards, tuple(r.shard for r in rows))


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, and the virtual slot of each record."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"),
                       F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    return rows.select("*", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Bytes per slot: one number for each slot, whatever the input."""
    weights = np.zeros(slots, np.int64)
    for row in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect():  # `slots` rows at most
        weights[row.virtual_slot] = row.bytes
    return weights


def sharded(docs: DataFrame, shards: int = 8, slots: int = SLOTS, slot_map: SlotMap | None = None,
            folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    `slot` is the document's place in its shard, gapless from 0. Without a map given, one is packed from the bytes per
    slot; with a folder, the map's version is stored there.
    """
    spark, rows = docs.sparkSession, slotted(docs, slots)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(7)), F.lit(PARTS)).cast("int"))
    counted = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    weights, counts = np.zeros(slots, np.int64), np.zeros((slots, PARTS), np.int64)  # slots * PARTS rows at most
    for row in counted:
        weights[row.virtual_slot] += row.bytes
        counts[row.virtual_slot, row.part] = row.n
    slot_map = slot_map or SlotMap.packed(weights, shards)
    if folder:
        slot_map.save(spark, folder)
    shard_of = np.array(slot_map.shard_of)
    places = []
    for shard in range(slot_map.shards):
        own = np.flatnonzero(shard_of == shard)
        first = np.cumsum(counts[own].ravel()) - counts[own].ravel()
        places += [(int(slot), part, shard, int(first[i * PARTS + part])) for i, slot in enumerate(own)
                   for part in range(PARTS) if counts[slot, part]]
    table = spark.createDataFrame(places, "virtual_slot int, part int, shard int, first long")
    order = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("place", F.row_number().over(order))
            .join(F.broadcast(table), ["virtual_slot", "part"])  # slots * PARTS rows at most
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("first") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                    "virtual_slot", F.lit(slot_map.version).alias("map_version")))


def repartitioned(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """docs with their shard, dealt out by virtual slot, as the last step before writing shards."""
    text = F.coalesce("text", F.lit(""))
    slot_map = SlotMap.packed(slot_sizes(slotted(docs, slots), slots), shards)
    table = docs.sparkSession.createDataFrame(list(enumerate(slot_map.shard_of)), "virtual_slot int, shard int")
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.crc32(F.encode(text, "utf-8"))), F.lit(slots)).cast("int")
    kept = docs.drop("shard", "virtual_slot")
    return kept.withColumn("virtual_slot", slot).join(F.broadcast(table), "virtual_slot")
