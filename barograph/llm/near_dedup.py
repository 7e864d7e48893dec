"""Near-duplicate detection by min-max hashing.

A document's set holds its distinct word shingles as 64-bit hashes. Each permutation is evaluated once per shingle and
gives two values, the minimum and the maximum, so a signature needs half the evaluations; the values are cut into bands,
never both values of a permutation in one band. Documents with the same set are one class. Classes that share a band
are candidates; a candidate link is confirmed on the full sets.

Within a bucket not all pairs are emitted. The member that meets most others, in all its buckets, is compared with all of
them; members connected by then need no comparison. Those left outside a bucket's largest component find whatever they
may be similar to by an exact prefix filter on the full sets, so the result is that of comparing all pairs of a bucket.

With 30 bands of 5 values, a pair at similarity 0.8 shares a band with probability 1 - 7e-6, at 0.9 with 1 - 2e-12.

Defined results: null or empty texts have empty sets and are linked with nothing; texts with fewer words than a shingle
have one; repeated rows are classes like other copies; near_duplicates() links rows with a null doc_id with nothing, while
deduplicated() treats them like all others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barograph.llm.graph import components
from barograph.llm.staging import sized, staged
from barograph.llm.words import mixed, text_bytes, word_hashes

BANDS, ROWS = 30, 5
#: Similarity in per cent.
LEAST = 80
_rng = np.random.default_rng(5)
_FACTORS = _rng.integers(0, 1 << 31, BANDS * ROWS // 2, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, BANDS * ROWS // 2, dtype=np.uint32)[:, None]
_TURN = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = word_hashes(data, offsets)
    for start, end in zip(first[:-1].tolist(), first[1:].tolist()):
        own = words[start:end]
        width = min(size, len(own))
        if not width:
            yield own
            continue
        hashes = np.full(len(own) - width + 1, width, np.uint64)
        for k in range(width):
            hashes = mixed(hashes * _TURN + own[k : len(own) - width + 1 + k])
        yield np.unique(hashes)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of the min-max signature."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = None, None
    for at in range(0, len(values), 4096):
        permuted = (values[at : at + 4096] ^ _SHIFTS) * _FACTORS
        mins, maxs = permuted.min(axis=1), permuted.max(axis=1)
        low = mins if low is None else np.minimum(low, mins)
        high = maxs if high is None else np.maximum(high, maxs)
    # All minima go to the first half of the bands, all maxima to the second.
    rows = np.concatenate([low, high]).astype(np.uint64).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = mixed(keys * _TURN + rows[:, k])
    return keys


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return mixed(shingles).sum(dtype=np.uint64).tobytes() + mixed(shingles + _TURN).sum(dtype=np.uint64).tobytes()


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, node (128 bits; null for an empty set), bands of every row."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, nodes, bands = [], [], []
            for shingles in shingle_sets(*text_bytes(batch.column(1)), size):
                counts.append(len(shingles))
                nodes.append(set_key(shingles) if len(shingles) else None)
                bands.append(band_keys(shingles).view(np.int64) if len(shingles) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "node", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, node binary, bands array<long>")


def _sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(node, set) of the classes, from the text of one document of each."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(*text_bytes(batch.column(1)), size))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([set_key(s) for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["want", "node", "set"])

    wanted = sized(staged(classes.select(F.col("rep").alias("doc_id"), F.col("node").alias("want")), "candidates"), F.lit(0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").select("want", "text")
    sets = texts.mapInArrow(cut, "want binary, node binary, set array<long>").where(F.col("want") == F.col("node"))
    return sets.groupBy("node").agg(F.first("set").alias("set"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    first = sets.select(F.col("node").alias("u"), F.col("set").alias("a"))
    second = sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
    both = pairs.join(first, "u").join(second, "v")
    shared = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - shared
    return both.where(100 * shared.cast("long") >= LEAST * union.cast("long")).select("u", "v")


def _prefixes(sets: DataFrame) -> DataFrame:
    """(token, node, place, n): the tokens of each set that a similar set must share one of.

    Two sets of sizes n and m are similar enough only if they share `shared` = LEAST / (100 + LEAST) of n + m, so they
    have a common token among the first n - shared + 1 of the one and the first m - shared + 1 of the other, in any order
    that holds for all sets. Rare tokens come first: by counters of hashed tokens, then by the token itself.
    """
    slots, spark = 1 << 18, sets.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(slots, np.int64)
        for batch in batches:
            tokens = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sums += np.bincount((tokens % np.uint64(slots)).astype(np.int64), minlength=slots)
        at = np.flatnonzero(sums)
        for k in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 50_000]), pa.array(sums[at[k : k + 50_000]])], names=["slot", "n"])

    table = np.zeros(slots, np.int64)
    counted = sets.select("node", "set").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table[np.array(counted["slot"], dtype=np.int64)] = np.array(counted["n"], dtype=np.int64)  # `slots` rows at most
    shared = spark.sparkContext.broadcast(table)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for node, listed in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = listed.values.to_numpy().view(np.uint64)
                first = np.lexsort((tokens, shared.value[(tokens % np.uint64(slots)).astype(np.int64)]))
                first = first[: len(tokens) - -(-LEAST * len(tokens) // 100) + 1]
                rows += [(t, node, k, len(tokens)) for k, t in enumerate(tokens[first].view(np.int64).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())],
                names=["token", "node", "place", "n"])

    return sets.select("node", "set").mapInArrow(cut, "token long, node binary, place int, n int")


def _rest(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Candidate pairs (u, v) among members of buckets that are neither compared nor connected yet; None if there are none.

    At least one of two unconnected members is outside the bucket's largest component. All of these meet, by the tokens
    of their prefixes, every member that they may be similar to.
    """
    named = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    inside = named.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    span = inside.groupBy("bucket").agg(F.count("*").alias("roots"), F.max(F.struct("k", "root"))["root"].alias("largest"))
    left = named.join(span.where("roots > 1"), "bucket")
    left = staged(left.groupBy("node").agg(F.first("root").alias("root"), F.max((F.col("root") != F.col("largest")).cast("int"))
                                           .alias("outside")), "open-members")
    if left.isEmpty():
        return None
    own = sets.join(sized(left, F.lit(0)), "node").select("node", "set")
    index = staged(_prefixes(own).join(sized(left, F.lit(0)), "node"), "prefixes")
    one = index.where("outside = 1").select("token", *[F.col(c).alias(f"{c}_1") for c in ("node", "place", "n", "root")])
    pairs = one.join(index, "token").where(F.col("root_1") != F.col("root"))
    common = F.ceil(LEAST * (F.col("n_1") + F.col("n")) / (100 + LEAST) - 1e-9)
    pairs = pairs.where((F.col("place_1") <= F.col("n_1") - common) & (F.col("place") <= F.col("n") - common)
                        & (100 * F.least("n_1", "n") >= LEAST * F.greatest("n_1", "n")))
    return pairs.select(F.least("node_1", "node").alias("u"), F.greatest("node_1", "node").alias("v")).distinct()


def classes_and_roots(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and (node, root) of every class linked with a lesser one."""
    rows = staged(sketches(docs, size), "sketches")
    classes = rows.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    members = classes.select("node", "rep", "n", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    members = staged(members.join(shared, "bucket"), "buckets")
    # The member that meets most others in all its buckets is nearest to the middle of a group of copies.
    nodes = staged(members.groupBy("node").agg(F.first("rep").alias("rep"), F.first("n").alias("n"), F.sum("k").alias("met")), "met")
    sets = staged(_sets(docs, nodes, size), "sets")
    pivots = members.join(nodes.select("node", "met"), "node").groupBy("bucket").agg(
        F.max(F.struct("met", "node", "n")).alias("pivot")).select("bucket", F.col("pivot.node").alias("u"), F.col("pivot.n").alias("m"))
    members = staged(members.select("bucket", "node", "n").join(pivots, "bucket").where(F.col("node") != F.col("u")), "members")
    close = 100 * F.least("n", "m") >= LEAST * F.greatest("n", "m")
    links = staged(_confirmed(members.where(close).select("u", F.col("node").alias("v")).distinct(), sets), "links")
    roots = components(links)
    rest = _rest(members.select("bucket", "node"), roots, sets)
    return rows, roots if rest is None else components(links.union(_confirmed(rest, sets)))


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links), kept."""
    rows, roots = classes_and_roots(docs, size)
    least = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("rep"))
    least = least.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    named = least.join(least.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("node", "component_id")
    named = rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5) -> DataFrame:
    """The rows of docs that stay: one row of each component, and all rows without a set.

    The row with the least doc_id stays; a null doc_id comes after all others. Rows are told apart by doc_id and set, and of
    rows that have both in common one stays, so null and repeated ids neither keep copies nor take other texts away. Columns
    may have any names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # Where the doc_id is null, the text's hash stands for it; equal sets are compared, too, so it need not be unique.
    stand_in = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("doc_id"), F.col("text"))
    sketched, roots = classes_and_roots(rows, size)
    copies = sketched.where(F.col("node").isNotNull()).groupBy("doc_id", "node").agg(F.lit(1).alias("one")).drop("one")
    least = copies.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(roots, "node", "left")
    stays = least.groupBy(F.coalesce("root", "node")).agg(F.min(F.struct("doc_id", "node")).alias("best")).select("best.doc_id", "best.node")
    stays = staged(stays, "stays")
    dropped = sized(staged(copies.join(stays, ["doc_id", "node"], "left_anti").select("doc_id").distinct(), "near-duplicates"), F.lit(0))
    several = staged(sketched.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if several.isEmpty():
        return rows.join(dropped, "doc_id", "left_anti").select("row.*")
    several = sized(several, F.lit(0))
    own = rows.join(several, "doc_id", "left_anti").join(dropped, "doc_id", "left_anti").select("row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [set_key(s) if len(s) else None for s in shingle_sets(*text_bytes(batch.column(2)), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary())], names=["row", "doc_id", "node"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("doc_id", T.LongType()), T.StructField("node", T.BinaryType())])
    again = rows.join(several, "doc_id", "left_semi").select("row", "doc_id", "text").mapInArrow(cut, schema)
    bare = again.where(F.col("node").isNull()).select("row")
    # Copies of one row combine before the shuffle, however many there are.
    again = again.where(F.col("node").isNotNull()).join(stays, ["doc_id", "node"], "left_semi").groupBy("doc_id", "node").agg(
        F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row")
    return own.unionAll(bare).unionAll(again).select("row.*")
