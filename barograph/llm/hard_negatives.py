"""Hard negatives by Four-Russians scoring: exact integer inner products from tables of subset sums.

A vector's components are floor(256 * x). A candidate is kept as bit planes in two's complement: one byte for each plane
and group of eight dimensions. For an anchor, a table per group holds the sums of all 256 subsets of its eight components.
A plane's share of the score is the sum of the table entries that the candidate's bytes point to, and the planes are
added from the highest to the lowest, doubling in between (the sign plane counts negative). So a score takes one lookup
per byte, and one lookup serves a whole tile of anchors.

Anchors come in shares of bounded bytes. A share is broadcast, all candidates pass it in blocks, each task keeps the best
rows for each anchor over all its blocks, and windows merge what the tasks found; then the share is dropped. Two
passes for each share: same labels give the positives, whose scores give the windows for the pass over other labels.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; rows that
share a vec_id are one row, that with the least label and vector; vectors of different lengths are filled up with zeros;
empty vectors score 0; scores wrap around like 64-bit integers; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barograph.llm.staging import partitions, shared_folder, staged

#: Candidates in a block, anchors in a tile: lookups and sums of a tile stay in a core's cache.
BLOCK, TILE = 4096, 64
#: Bytes of anchors (as 64-bit components) in a share.
SHARE_BYTES = 16 << 20
#: Windows and their rows in a share's memory are bounded as well: so many anchors at most, on average.
SHARE_ANCHORS = 1 << 15
LOWEST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
PACKED = "vec_id long, label long, bits int, dims int, planes binary"


def whole_components(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) as 64-bit integers, modulo 2**64."""
    scaled = np.floor(256.0 * values.astype(np.float64))
    far = np.abs(scaled) >= 2.0**63
    if not far.any():
        return scaled.astype(np.int64)
    rest = np.fmod(scaled, 2.0**64)
    rest = np.where(rest >= 2.0**63, rest - 2.0**64, np.where(rest < -(2.0**63), rest + 2.0**64, rest))
    return rest.astype(np.int64)


def bit_planes(whole: np.ndarray) -> np.ndarray:
    """(rows, planes, groups of eight dimensions) bytes of the two's complement of (rows, dimensions)."""
    n, d = whole.shape
    span = int(np.maximum(whole, ~whole).max(initial=0)).bit_length() + 1
    full = np.zeros((n, -(-d // 8) * 8), np.int64)
    full[:, :d] = whole
    return np.stack([np.packbits(((full >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(span)], axis=1)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each group of eight dimensions the sums of all subsets of each anchor's components."""
    n, d = anchors.shape
    most = float(np.abs(anchors.astype(np.float64)).sum(axis=1).max(initial=0))
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    full = np.zeros((-(-d // 8) * 8, n), kind)
    full[:d] = anchors.T
    sums = np.zeros((len(full) // 8, 256, n), kind)
    for k in range(8):
        sums[:, 1 << k : 2 << k] = sums[:, : 1 << k] + full[k::8, None, :]
    return sums


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products from (planes, groups, rows) bytes and the anchors' tables."""
    span, groups, n = planes.shape
    wide = np.int32 if span <= 16 and sums.dtype == np.int16 else np.int64
    total = np.zeros((n, sums.shape[2]), wide)
    for b in range(span - 1, -1, -1):
        part = np.zeros(total.shape, sums.dtype)
        for g in range(min(groups, len(sums))):
            part += sums[g].take(planes[b, g], axis=0)
        total <<= 1
        total += -part.astype(wide) if b == span - 1 else part
    return total


class Best:
    """The best k rows of each of a number of windows: higher scores first, ties by the smaller id."""

    def __init__(self, windows: int, k: int):
        self.k, self.have = k, np.zeros(windows, np.int64)
        self.score, self.id = np.full((windows, k), LOWEST, np.int64), np.full((windows, k), LAST, np.int64)

    def add(self, window: np.ndarray, score: np.ndarray, own_id: np.ndarray) -> None:
        worst, worst_id = self.score[window, -1], self.id[window, -1]
        better = (self.have[window] < self.k) | (score > worst) | ((score == worst) & (own_id < worst_id))
        window, score, own_id = window[better], score[better].astype(np.int64), own_id[better]
        if not len(window):
            return
        met = np.unique(window)
        old = np.repeat(met, self.have[met])
        place = np.arange(len(old)) - np.repeat(np.cumsum(self.have[met]) - self.have[met], self.have[met])
        window, score, own_id = (np.concatenate(x) for x in (
            (old, window), (self.score[old, place], score), (self.id[old, place], own_id)))
        order = np.lexsort((own_id, ~score, window))
        window, score, own_id = window[order], score[order], own_id[order]
        first = np.searchsorted(window, met)
        place = np.arange(len(window)) - np.repeat(first, np.diff(first, append=len(window)))
        kept = place < self.k
        window, place = window[kept], place[kept]
        self.score[window, place], self.id[window, place] = score[kept], own_id[kept]
        np.maximum.at(self.have, window, place + 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        window = np.repeat(np.arange(len(self.have)), self.have)
        place = np.arange(len(window)) - np.repeat(np.cumsum(self.have) - self.have, self.have)
        return window, self.score[window, place], self.id[window, place]


class Share:
    """Some anchors by label: ids, labels, components and, for the second pass, windows (low, high) per positive."""

    def __init__(self, ids, labels, vectors):
        order = sorted(range(len(ids)), key=lambda i: (labels[i], ids[i]))
        self.ids, self.labels = (np.array([x[i] for i in order], np.int64) for x in (ids, labels))
        self.vectors = [vectors[i] for i in order]
        self.low = self.high = np.zeros((len(ids), 0), np.int64)
        self.positive = self.positive_score = self.low

    def tiles(self, at: int, end: int) -> Iterator[tuple[slice, np.ndarray]]:
        """Tables of the anchors from `at` to `end`, tile by tile."""
        for k in range(at, end, TILE):
            part = slice(k, min(k + TILE, end))
            rows = self.vectors[part]
            full = np.zeros((len(rows), max(map(len, rows))), np.int64)
            for i, row in enumerate(rows):
                full[i, : len(row)] = row
            yield part, subset_sums(full)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and (planes, groups, rows) of at most BLOCK candidates with vectors of one shape."""
    for batch in batches:
        ids, labels, bits, dims = (batch.column(k).to_numpy() for k in range(4))
        shape = bits.astype(np.int64) << 32 | dims
        for one in np.unique(shape):
            rows = np.flatnonzero(shape == one)
            for at in range(0, len(rows), BLOCK):
                own = rows[at : at + BLOCK]
                data = b"".join(batch.column(4).take(pa.array(own)).to_pylist())
                planes = np.frombuffer(data, np.uint8).reshape(len(own), int(one >> 32), -(-int(one & 0xFFFFFFFF) // 8))
                yield ids[own], labels[own], np.ascontiguousarray(planes.transpose(1, 2, 0))


def _same_label(share: Share, best: Best, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray) -> None:
    for label in np.unique(labels):
        at, end = np.searchsorted(share.labels, [label, label + 1]) if label < LAST else (
            np.searchsorted(share.labels, label), len(share.labels))
        own = np.flatnonzero(labels == label)
        for part, sums in share.tiles(int(at), int(end)):
            found = scores(planes[:, :, own], sums)
            _keep(best, found, ids[own], np.arange(part.start, part.stop), ids[own][:, None] != share.ids[part],
                  np.full(found.shape[1], LOWEST), np.full(found.shape[1], LAST))


def _other_label(share: Share, best: Best, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray) -> None:
    per = share.low.shape[1]
    for part, sums in share.tiles(0, len(share.ids)):
        open_ = np.flatnonzero((share.low[part] <= share.high[part]).any(axis=1))
        other = labels[:, None] != share.labels[part]
        if not len(open_) or not other.any():
            continue
        found = scores(planes, sums)
        for j in range(per):
            _keep(best, found, ids, np.arange(part.start, part.stop) * per + j, other, share.low[part, j], share.high[part, j])


def _keep(best: Best, found: np.ndarray, ids: np.ndarray, window: np.ndarray, fits: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """Offer each column's rows that fit and lie from low to high to the column's window."""
    full = best.have[window] >= best.k
    low = np.maximum(low, np.where(full, best.score[window, -1], LOWEST))
    low, high = (np.clip(x, np.iinfo(found.dtype).min, np.iinfo(found.dtype).max).astype(found.dtype) for x in (low, high))
    fits = fits & (found >= low) & (found <= high)
    if len(found) > best.k and np.count_nonzero(fits) > 4 * best.k * len(window):
        kth = np.partition(np.where(fits, found, np.iinfo(found.dtype).min), len(found) - best.k, axis=0)[len(found) - best.k]
        fits &= found >= kth
    row, column = np.nonzero(fits)
    if len(row):
        best.add(window[column], found[row, column], ids[row])


def packed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, bits, dims, planes of every row that takes part, by label in each partition."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(2)
            size = np.diff(np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy())]))
            whole = whole_components(listed.flatten().to_numpy(zero_copy_only=False))
            first = np.cumsum(size) - size
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                planes = bit_planes(whole[first[own][:, None] + np.arange(d)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)),
                     pa.array(np.full(len(own), planes.shape[1], np.int32)), pa.array(np.full(len(own), d, np.int32)),
                     pa.array([row.tobytes() for row in planes], pa.binary())], names=["vec_id", "label", "bits", "dims", "planes"])

    return vectors.mapInArrow(pack, PACKED)


def _valid(table: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part, one for each vec_id."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                        F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    least = rows.repartition(partitions(table.sparkSession), "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row"))
    return least.select("vec_id", "row.label", "row.embedding").sortWithinPartitions("label", "vec_id")


def _search(candidates: DataFrame, share: Share, k: int, per: int, step) -> tuple[DataFrame, Broadcast]:
    """(anchor_id, j, other_id, score, rank): the best k rows of every window (j: the positive's place), and the share as sent."""
    sent = candidates.sparkSession.sparkContext.broadcast(share)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(sent.value.ids) * per, k)
        for ids, labels, planes in _blocks(batches):
            step(sent.value, best, ids, labels, planes)
        window, score, own_id = best.rows()
        for at in range(0, len(window), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sent.value.ids[window[part] // per]), pa.array((window[part] % per).astype(np.int32)),
                 pa.array(own_id[part]), pa.array(score[part])], names=["anchor_id", "j", "other_id", "score"])

    found = candidates.mapInArrow(find, "anchor_id long, j int, other_id long, score long")
    first = Window.partitionBy("anchor_id", "j").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k), sent


def _shares(anchors: DataFrame, shares: int) -> Iterator[Share]:
    """The anchors' shares, one at a time in the driver's memory."""
    for k in range(shares):
        rows = anchors.where(F.col("share") == k).select("vec_id", "label", "embedding").toArrow()
        vectors = [whole_components(np.array(v, np.float64)) for v in rows.column(2).to_pylist()]
        if vectors:
            yield Share(rows.column(0).to_pylist(), rows.column(1).to_pylist(), vectors)


def hard_negatives(table: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which `anchor` (of vec_id) holds. Each has its best `positives` rows of the same label; for
    each of these, the best `negatives` rows of another label from `low` to `high` per cent of the positive's score.
    """
    spark = table.sparkSession
    rows = staged(_valid(table), "vectors")
    candidates = staged(packed(rows), "planes").coalesce(partitions(spark))
    chosen = rows.where(anchor)
    n, taken = chosen.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("embedding") + 64), F.lit(0))).first()
    shares = max(1, -(-int(taken) // SHARE_BYTES), -(-n // SHARE_ANCHORS))
    anchors = staged(chosen.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(shares))), "anchors")
    out = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], kind).write.parquet(out)
    for share in _shares(anchors, shares):
        found, sent = _search(candidates, share, positives, 1, _same_label)
        found = found.select("anchor_id", "rank", "other_id", "score").toArrow()  # `positives` rows for each anchor of the share
        sent.destroy()
        place = np.argsort(share.ids)[np.searchsorted(np.sort(share.ids), found.column(0).to_numpy())]
        at = (place, found.column(1).to_numpy() - 1)
        share.positive, share.positive_score = (np.zeros((len(share.ids), positives), np.int64) for _ in range(2))
        share.low, share.high = np.full((len(share.ids), positives), 1), np.full((len(share.ids), positives), 0)
        score = found.column(3).to_numpy()
        share.positive[at], share.positive_score[at] = found.column(2).to_numpy(), score
        share.low[at], share.high[at] = [-(-low * s // 100) for s in score.tolist()], [high * s // 100 for s in score.tolist()]
        pairs = pa.table({"anchor_id": share.ids[place], "j": at[1].astype(np.int32), "positive_id": share.positive[at],
                          "positive_score": score})
        if not len(place):
            continue
        found, sent = _search(candidates, share, negatives, positives, _other_label)
        both = found.join(spark.createDataFrame(pairs.to_pandas(), "anchor_id long, j int, positive_id long, positive_score long"), ["anchor_id", "j"])
        both.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        sent.destroy()
    return spark.read.schema(kind).parquet(out)
