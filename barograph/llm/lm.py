"""Language-model scores by a weighted backoff automaton.

Unigrams of all training texts are counted exactly and smoothed by one half. An arc from word h to word w has the
discounted relative frequency of the bigram; every bigram that occurs at least LEAST times in the training texts is an
arc, whatever the size of the corpus. Every other word leaves h by the failure arc to the root, whose weight makes the
probabilities after h sum to one over the known words and the unknown one; a word without arcs has the weight one. A text
is read once from left to right: its state is carried along and the log-probabilities are added up, 10 as base.

A filter of fixed size tells in the tasks which bigrams of a text can be arcs; no others leave them. It is one bit per
place of a hash, so it errs on one side only, and the joins decide.

Words and bigrams with a share of known_share or more are looked up in tasks: 1 / known_share words and as many bigrams at
most, 16 bytes each; only these tables are broadcast. All others, as many as the corpus has, stay in distributed tables
and meet the words and bigrams of the texts in joins: a bigram's row holds by how much its arc differs from the failure
arc. Words are told apart by 64-bit hashes, and so are bigrams once they are counted; until then the broadcast words have
their places instead.

Defined results: a null text is an empty one and has only its end; rows with a null doc_id are trained on; repeated rows
are each scored (and each counted in training); an empty table gives no rows; without training texts every word is
unknown; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm.staging import partitions, release, staged
from barograph.llm.words import mixed, slices, text_bytes, word_hashes

#: The end of a text, as a token.
END = 0
DISCOUNT = 0.75
#: Occurrences that make a bigram an arc.
LEAST = 2
#: Texts in an Arrow batch.
BATCH = 1000
#: Rounds in which the texts' bigrams meet the arcs (as a power of two); each has its share of the keys, and leaves only sums.
ROUNDS = 2
#: Places of the filter of arcs, and of each chunk that a task fills (as powers of two): 32 MB in all.
FILTER, CHUNK = 28, 19


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 5 is 1; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 1, F.lit(False))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and the place of each text's first token (and the end)."""
    hashes, first = word_hashes(*text_bytes(column))
    return np.insert(hashes.view(np.int64), first[1:], END), first + np.arange(len(first))


def _counted(values: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    distinct, n = np.unique(values, return_counts=True)
    for at in range(0, len(distinct), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(distinct[at : at + 200_000]), pa.array(n[at : at + 200_000])], names=names)


def unigrams(texts: DataFrame) -> DataFrame:
    """(w, c): every distinct token and its count."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _counted(tokens(batch.column(0))[0], ["w", "c"])

    return staged(texts.mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "unigrams", BATCH)


def _find(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted values, -1 if missing."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at, -1)


def _distinct(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns, sorted by the first one first, and how often each occurs."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.diff(at, append=len(order))


def bigrams(texts: DataFrame, known: np.ndarray) -> DataFrame:
    """(h, w, n): counts of all bigrams; a known word is given by its place, any other one by its hash."""
    shared = texts.sparkSession.sparkContext.broadcast(known)  # 1 / known_share words at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 0, 2 << 20)):
            sequence = tokens(part.column(0))[0]
            place = _find(shared.value, sequence)
            ids = np.where(place >= 0, place, sequence)
            (h, w), n = _distinct(np.concatenate([_find(shared.value, np.array([END])), ids[:-1]]), ids)
            for at in range(0, len(n), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 200_000]) for x in (h, w, n)], names=["h", "w", "n"])

    return texts.mapInArrow(count, "h long, w long, n long").groupBy("h", "w").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class BackoffAutomaton:
    """Known words (sorted hashes) with their log-probabilities at the root and failure weights; each of them is a state."""

    known: np.ndarray
    root: np.ndarray
    failure: np.ndarray
    arcs: np.ndarray
    weights: np.ndarray

    @property
    def states(self) -> np.ndarray:
        return self.known

    def traverse(self, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One pass over tokens: the log-probability at the root (nan if not known here), what the states known here
        change, the ids of the tokens, and whether a token came by an arc known here. Texts begin in the state after an end.
        """
        place = _find(self.known, sequence)
        ids = np.where(place >= 0, place, sequence)
        if not len(self.known):
            return np.full(len(sequence), np.nan), np.zeros(len(sequence)), ids, np.zeros(len(sequence), bool)
        base = np.where(place >= 0, self.root[place], np.nan)
        carried = np.concatenate([_find(self.known, np.array([END])), place[:-1]])
        arc = _find(self.arcs, np.where((carried >= 0) & (place >= 0), carried * len(self.known) + place, -1))
        step = np.where(carried >= 0, self.failure[carried], 0.0)
        if len(self.arcs):
            step = np.where(arc >= 0, self.weights[arc] - base, step)
        return base, step, ids, arc >= 0


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hashes that stand for bigrams."""
    return mixed(h.astype(np.int64).view(np.uint64) ^ mixed(w.astype(np.int64).view(np.uint64))).view(np.int64)


def _keyed(arcs: DataFrame) -> DataFrame:
    """(pair, gain) from (h, w, gain)."""
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pair_keys(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(pair), batch.column(2)], names=["pair", "gain"])

    return arcs.select("h", "w", "gain").mapInArrow(key, "pair long, gain double")


def arc_filter(arcs: DataFrame) -> np.ndarray:
    """One bit for each filter place, set where an arc falls; each task fills the chunks it owns."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for k in np.unique(at >> CHUNK).tolist():
                chunks.setdefault(k, np.zeros(1 << CHUNK, bool))[at[at >> CHUNK == k] & ((1 << CHUNK) - 1)] = True
        for k, flags in chunks.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())],
                                             names=["chunk", "bits"])

    places = arcs.select(F.shiftrightunsigned("pair", 64 - FILTER).cast("int").alias("at"))
    filled = places.repartition(partitions(arcs.sparkSession), F.shiftright("at", CHUNK)).mapInArrow(fill, "chunk int, bits binary").toArrow()  # 32 MB at most
    out = np.zeros((1 << (FILTER - CHUNK), 1 << (CHUNK - 3)), np.uint8)
    for k, bits in zip(filled["chunk"].to_pylist(), filled["bits"].to_pylist()):
        out[k] = np.frombuffer(bits, np.uint8)
    return out.ravel()


@dataclass(frozen=True)
class LanguageModel:
    """vocabulary (w, c, failure) has all words; arcs (pair, gain) has the bigrams that the automaton lacks, None if none;
    arc_bits is their filter."""

    vocabulary: DataFrame
    arcs: DataFrame | None
    arc_bits: np.ndarray | None
    n: int
    v: int
    automaton: BackoffAutomaton

    @property
    def total(self) -> float:
        return self.n + 0.5 * (self.v + 1)


def _looked_up(rows: DataFrame, key: str, values: dict[str, np.ndarray]) -> DataFrame:
    """rows with a column for each array, its value at the place `key`, null where the key is a hash."""
    shared, size = rows.sparkSession.sparkContext.broadcast(values), len(next(iter(values.values())))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(key))
            here = (at >= 0) & (at < size)
            for name, column in shared.value.items():
                found = np.zeros(len(at))
                found[here] = column[at[here]]
                batch = batch.append_column(name, pa.array(found, mask=~here))
            yield batch

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(read, types + "".join(f", {name} double" for name in values))


def train(texts: DataFrame, state_share: float | None = None, known_share: float = 1e-6) -> LanguageModel:
    """The model of some texts; with a state_share, only bigrams with at least that share are arcs."""
    counted = unigrams(texts)
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = sums.n, sums.v
    total, frequent = n + 0.5 * (v + 1), float(known_share * n)
    least = float(LEAST) if state_share is None else max(float(LEAST), state_share * n)
    often = counted.where((F.col("c") >= F.lit(frequent)) | (F.col("w") == END)).toArrow()  # 1 / known_share rows at most
    words, counts = np.array(often["w"], dtype=np.int64), np.array(often["c"], dtype=float)
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    root = np.log10((counts + 0.5) / total) if n else counts
    here = lambda c: F.col(c).between(0, len(words) - 1)
    rare = counted.where((F.col("c") < F.lit(frequent)) & (F.col("w") != END))

    pairs = staged(bigrams(texts, words).where(F.col("n") >= F.lit(least)), "bigrams", BATCH)
    # Frequent words find their counts in arrays, so no join has them as a key.
    rooted = _looked_up(pairs.where(here("w")), "w", {"root": root}).unionByName(pairs.where(~here("w")).join(rare, "w").select(
        "h", "w", "n", F.log10((F.col("c") + 0.5) / F.lit(float(total))).alias("root")))
    rooted = staged(rooted, "rooted-bigrams")
    left = rooted.groupBy("h").agg(F.sum(F.col("n") - F.lit(DISCOUNT)).alias("given"),
                                   F.sum(F.pow(F.lit(10.0), F.col("root"))).alias("at_root"))
    left = staged(left, "left-by-arcs")
    own = left.where(here("h")).toArrow()  # 1 / known_share rows at most
    at = np.array(own["h"], dtype=np.int64)
    failure = np.zeros(len(words))
    failure[at] = np.log10((1 - np.array(own["given"], dtype=float) / counts[at]) / (1 - np.array(own["at_root"], dtype=float)))
    weight = F.log10((1 - F.col("given") / F.col("c")) / (1 - F.col("at_root")))
    vocabulary = staged(counted.join(left.where(~here("h")).withColumnRenamed("h", "w"), "w", "left").select(
        "w", "c", F.coalesce(weight, F.lit(0.0)).alias("failure")), "vocabulary")
    release(left, counted)

    top = pairs.where(F.col("n") >= F.lit(frequent)).toArrow()  # 1 / known_share rows at most
    release(pairs)
    first, second, both = (np.array(top[c], dtype=np.int64) for c in ("h", "w", "n"))
    arcs = first * max(1, len(words)) + second
    order = np.argsort(arcs)
    p = (both[order] - DISCOUNT) / counts[first[order]]
    automaton = BackoffAutomaton(words, root, failure, arcs[order], np.log10(p))
    if frequent <= least:
        return LanguageModel(vocabulary, None, None, n, v, automaton)
    others = rooted.where(F.col("n") < F.lit(frequent))
    of_first = vocabulary.where((F.col("c") < F.lit(frequent)) & (F.col("w") != END)).withColumnRenamed("w", "h")
    others = _looked_up(others.where(here("h")), "h", {"c": counts, "failure": failure}).unionByName(
        others.where(~here("h")).join(of_first, "h").withColumn("c", F.col("c").cast("double")))
    gain = F.log10((F.col("n") - F.lit(DISCOUNT)) / F.col("c")) - F.col("root") - F.col("failure")
    arcs = staged(_keyed(others.select("h", "w", gain.alias("gain"))), "arcs")
    release(rooted)
    return LanguageModel(vocabulary, arcs, arc_filter(arcs), n, v, automaton)


def scores(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, base_score, score."""
    a = model.automaton
    shared = docs.sparkSession.sparkContext.broadcast((a.known, a.root, a.failure, a.arcs, a.weights))
    filtered = docs.sparkSession.sparkContext.broadcast(model.arc_bits)  # 32 MB
    n, total, joined = model.n, model.total, model.arcs is not None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, row = BackoffAutomaton(*shared.value), TaskContext.get().partitionId() << 40
        for batch in (part for whole in batches for part in slices(whole, 1, 3 << 20)):
            sequence, first = tokens(batch.column(1))
            base, step, ids, by_arc = automaton.traverse(sequence)
            text = np.repeat(np.arange(len(batch)), np.diff(first))
            rare = np.isnan(base)
            # Rare words and bigrams leave as lists, to meet their counts in joins.
            (owner, word), times = _distinct(text[rare], sequence[rare])
            before = np.concatenate([_find(automaton.known, np.array([END])), ids[:-1]])
            other, pair = np.zeros(len(text), bool), ids
            if joined:
                pair = pair_keys(before, ids)
                at = (pair.view(np.uint64) >> np.uint64(64 - FILTER)).astype(np.int64)
                other = ~by_arc & ((filtered.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            (owner2, pair), times2 = _distinct(text[other], pair[other])
            lists, lists2 = (pa.array(np.searchsorted(x, np.arange(len(batch) + 1)).astype(np.int32)) for x in (owner, owner2))
            columns = [
                pa.array(row + np.arange(len(batch))), batch.column(0), pa.array(np.diff(first)),
                pa.array(np.bincount(text, weights=~rare, minlength=len(batch)).astype(np.int64)),
                pa.array(np.bincount(text, weights=np.nan_to_num(base), minlength=len(batch))),
                pa.array(np.bincount(text, weights=step, minlength=len(batch))),
                *(pa.ListArray.from_arrays(lists, pa.array(x)) for x in (word, times.astype(np.int32))),
                *(pa.ListArray.from_arrays(lists2, pa.array(x)) for x in (pair, times2.astype(np.int32)))]
            row += len(batch)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["row", "doc_id", "n_tokens", "n_known", "base", "step", "word", "times", "pair", "times2"]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        read, "row long, doc_id long, n_tokens long, n_known long, base double, step double, word array<long>, "
        "times array<int>, pair array<long>, times2 array<int>")
    rows = staged(rows, "read-texts", BATCH)
    rare = rows.select("row", F.inline(F.arrays_zip(F.col("word").alias("w"), "times"))).join(model.vocabulary, "w", "left")
    unknown = float(np.log10(0.5 / total)) if total else 0.0
    rare = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.coalesce(F.log10((F.col("c") + 0.5) / total), F.lit(unknown))).alias("rare"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.coalesce("failure", F.lit(0.0))).alias("rare_step"))
    scored = rows.drop("word", "times", "pair", "times2").join(rare, "row", "left")
    step = F.col("step") + F.coalesce("rare_step", F.lit(0.0))
    if joined:
        share = F.shiftrightunsigned("pair", 64 - ROUNDS)
        sums = [staged(rows.select("row", F.inline(F.arrays_zip("pair", "times2"))).where(share == k).join(
            model.arcs.where(share == k), "pair").groupBy("row").agg(F.sum(F.col("times2") * F.col("gain")).alias("gain")), "gains")
            for k in range(1 << ROUNDS)]
        gains = functools.reduce(DataFrame.union, sums).groupBy("row").agg(F.sum("gain").alias("gain"))
        scored, step = scored.join(gains, "row", "left"), step + F.coalesce("gain", F.lit(0.0))
    base = F.col("base") + F.coalesce("rare", F.lit(0.0))
    return scored.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + step).alias("score"))
