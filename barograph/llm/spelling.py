"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Of two words one edit apart, the shorter (of equally long ones, the smaller) gives two disjoint chunks, its halves; the
other gives its positional grams as long as a half. One edit leaves one of the halves whole: the first half stands at its
place, or the second stands at its place or, where the other word is one longer, shifted by one. So the halves are joined
with the grams of the other word at a shift of at most one, and the pairs are verified by their edit distance. Pairs that
agree in both halves' places are compared once. Joins on a hot gram are left to adaptive execution, which splits its rows.

Words are counted in the tasks, from whole texts piece by piece, and combined by a shuffle of counts.

Defined results: null or empty texts have no words; a null doc_id counts as empty text in the deletion's checksum;
repeated rows count again; of equally frequent forms the smallest in code-point order is taken; words of equal counts
are never each other's form; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.staging import staged
from barograph.llm.words import LOWER

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One in so many (document, run) loses a code point.
DELETED = 199
#: Characters of a text that are cut to runs at a time, and distinct words that a task holds.
PIECE, HELD = 1 << 20, 1 << 18
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")


def _runs(text: str) -> Counter:
    """How often each run stands in a text."""
    counts, at = Counter(), 0
    while at < len(text):
        end = len(text)
        if at + PIECE < end:
            found = _OTHER.search(text, at + PIECE)
            end = found.start() if found else end
        counts.update(RUN.findall(text[at:end]))
        at = end
    return counts


def words_of(doc_id: int | None, text: bytes) -> Iterator[tuple[str, int]]:
    """The lower-cased words of a text with their counts, after the deletions."""
    before = b"" if doc_id is None else str(doc_id).encode()
    for run, n in _runs(text.translate(LOWER).decode()).items():
        check = zlib.crc32(b"%b:%b" % (before, run.encode()))
        if check % DELETED == 0:
            at = check % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            yield run, n


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the words of at least LEAST_LENGTH code points that occur at least LEAST_COUNT times."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(held: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in words_of(doc_id, text.as_buffer().to_pybytes() if text.is_valid else b""):
                    held[word] += n
                if len(held) > HELD:
                    yield batch_of(held)
                    held = Counter()
        yield batch_of(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of distinct words of at least two code points that differ by one edit; each pair once."""
    size, half = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    # A word's halves, for other words as long as itself (shift 0) and one longer (the second half at shift 1).
    chunk = lambda place, length, shift: F.struct(
        (size + shift).alias("size"), (F.lit(0) if place == 0 else half + shift).alias("place"),
        F.substring("word", F.lit(1) if place == 0 else half + 1, length).alias("gram"))
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(F.array(
        *[chunk(0, half, s) for s in (0, 1)], *[chunk(1, size - half, s) for s in (0, 1)])).alias("c")).select("a", "n_a", "c.*")
    # Of the other word's positional grams, as long as a half, those leave the task that stand where a half can meet them.
    gram = lambda place, length: F.struct(size.alias("size"), place.alias("place"), F.substring("word", place + 1, length).alias("gram"))
    less = F.floor((size - 1) / 2).cast("int")
    grams = F.array_distinct(F.array(gram(F.lit(0), half), gram(half, size - half), gram(F.lit(0), less), gram(less + 1, size - 1 - less)))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(grams).alias("g")).select("b", "n_b", "g.*")
    met = chunks.join(grams, ["size", "place", "gram"])
    met = met.where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of (word, n).

    A form is the most frequent near word, if it is at least TIMES as frequent; the root is the last form of the chain. Each
    step multiplies the count, so the chain is short, and every round doubles the steps that are taken.
    """
    words = staged(words.select("word", "n"), "words")
    pairs = staged(near_pairs(words), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first"))
    named = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                   F.when(-F.col("first.less") >= TIMES * F.col("n"), F.col("first")).alias("first"))
    named = staged(named.select("word", "n", "n_near", F.col("first.near").alias("form"), (-F.col("first.less")).alias("form_n")), "forms")
    steps = staged(named.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "roots")
        steps = moved.select("word", "root")
        if moved.where("on").isEmpty():
            break
    return named.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
