"""Benchmark decontamination by Wu-Manber search over words.

Every run of `window` consecutive words of a benchmark item is a test string (an item with fewer words is one). Test
strings of one length share a machine: a shift table over blocks of two words says how far the search may skip, a block
with shift 0 selects a bucket by its suffix, and the words of the bucket's strings are compared one by one.

The test strings are read in shares of at most `share_bytes`, each broadcast and searched over all documents, so memory
does not grow with the benchmark; results of the shares are united.

Defined results: null texts have no words; an item without words has no test string; a null item_id counts as the empty
one; repeated rows are each reported; empty tables give no rows, or no hits; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.staging import staged
from barograph.llm.words import ALPHANUMERIC

WINDOW = 10


def words(text: bytes) -> list[bytes]:
    return text.translate(ALPHANUMERIC).split()


class WuManber:
    """Search for many word sequences of one length."""

    def __init__(self, length: int, block: int = 2) -> None:
        self.length, self.block = length, min(block, length)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, list[tuple[list[bytes], set[str]]]] = {}

    def add(self, pattern: list[bytes], item: str) -> None:
        for end in range(self.block, self.length + 1):
            key = tuple(pattern[end - self.block : end])
            self.shift[key] = min(self.shift.get(key, self.length), self.length - end)
        bucket = self.buckets.setdefault(tuple(pattern[-self.block :]), [])
        for known, items in bucket:
            if known == pattern:
                items.add(item)
                return
        bucket.append((pattern, {item}))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Where a test string occurs, and the items that have it."""
        shift, block, length = self.shift, self.block, self.length
        end, skip = length, length - block + 1
        while end <= len(text):
            key = tuple(text[end - block : end])
            step = shift.get(key, skip)
            if step:
                end += step
                continue
            start = end - length
            for pattern, items in self.buckets[key]:
                if pattern[0] == text[start] and pattern == text[start:end]:
                    yield start, items
            end += 1


def machines(strings: list[tuple[str, str]]) -> list[WuManber]:
    """One machine for each length of the (item, space-joined words) given."""
    by_length: dict[int, WuManber] = {}
    for item, string in strings:
        pattern = string.encode().split(b" ")
        by_length.setdefault(len(pattern), WuManber(len(pattern))).add(pattern, item)
    return list(by_length.values())


def occurrences(search: list[WuManber], listed: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
    """(start, stop, items) of every place where a test string occurs."""
    for machine in search:
        for start, owners in machine.search(listed):
            yield start, start + machine.length, owners


def found(search: list[WuManber], text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit stretches in order without overlap, items."""
    listed = words(text)
    hits, items = [], set()
    for start, stop, owners in occurrences(search, listed):
        hits.append((start, stop))
        items |= owners
    merged: list[tuple[int, int]] = []
    for start, end in sorted(hits):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return len(listed), merged, items


def telling(search: list[WuManber], text: bytes, window: int, least_share: float) -> bool:
    """Whether a whole window occurs, or a shorter item that is at least this share of the text's words."""
    listed = words(text)
    return any(stop - start >= window or stop - start >= least_share * len(listed) for start, stop, _ in occurrences(search, listed))


def test_strings(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, string): the distinct word windows of each item."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(item, b" ".join(listed[i : i + window]).decode())
                    for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())
                    if (listed := words(text)) for i in range(max(1, len(listed) - window + 1))}
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                              pa.array([r[1] for r in rows], pa.string())], names=["item", "string"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             F.coalesce("text", F.lit("")).alias("text"))
    return items.mapInArrow(cut, "item string, string string").distinct()


def shares(benchmark: DataFrame, window: int = WINDOW, share_bytes: int = 32 << 20) -> Iterator[object]:
    """Broadcast lists of test strings, each of about share_bytes at most."""
    spark = benchmark.sparkSession
    strings = staged(test_strings(benchmark, window), "test-strings")
    total = strings.agg(F.sum(F.octet_length("string") + F.octet_length("item") + 64).alias("n")).first().n or 0
    n = -(-total // share_bytes)
    for k in range(n):
        share = strings.where(F.pmod(F.xxhash64("string", "item"), F.lit(n)) == k)
        yield spark.sparkContext.broadcast([(r.item, r.string) for r in share.collect()])  # about share_bytes


def _scanned(share: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = machines(share.value)
        for batch in batches:
            results = [found(search, text) for text in batch.column(2).cast(pa.binary()).to_pylist()]
            stretch = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, *_ in results], pa.int64()),
                 pa.array([[{"start": a, "stop": b} for a, b in hits] for _, hits, _ in results], pa.list_(stretch)),
                 pa.array([sorted(items) for *_, items in results], pa.list_(pa.string()))],
                names=["doc_id", "text_key", "n_words", "hits", "items"])

    return scan


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, hits (stretches of words), n_hit, items (sorted), contaminated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
                       F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, text_key long, n_words long, hits array<struct<start:long,stop:long>>, items array<string>"
    parts = [rows.mapInArrow(_scanned(share), schema) for share in shares(benchmark, window, share_bytes)]
    if not parts:
        parts = [rows.mapInArrow(_scanned(docs.sparkSession.sparkContext.broadcast([])), schema)]
    result = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            result = result.unionByName(part)
        result = result.groupBy("doc_id", "text_key").agg(
            F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.floor(F.count("*") / len(parts)).cast("int").alias("times"))
        result = result.select("*", F.explode(F.sequence(F.lit(1), F.col("times"))))
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).cast("long").alias("stop"), F.lit(0).cast("long").alias("n")),
        lambda a, h: F.struct(F.greatest(a["stop"], h["stop"]).alias("stop"),
                              (a["n"] + F.greatest(F.lit(0).cast("long"), h["stop"] - F.greatest(a["stop"], h["start"]))).alias("n")))
    return result.select("doc_id", "n_words", "hits", covered["n"].alias("n_hit"), "items",
                         (F.size("hits") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share_bytes: int = 32 << 20,
                   least_share: float = 0.0) -> DataFrame:
    """The rows of docs in which no test string occurs; nothing is moved between tasks.

    An item of fewer words than a window speaks only against texts of which it is at least `least_share`, in words: "yes" may
    be a benchmark's answer and stands in many clean texts.
    """
    kept, at = docs, docs.columns.index("text")

    def clean(share: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = machines(share.value)
            for batch in batches:
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([not telling(search, text or b"", window, least_share) for text in texts], pa.bool_()))

        return scan

    for share in shares(benchmark, window, share_bytes):
        kept = kept.mapInArrow(clean(share), docs.schema)
    return kept


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
