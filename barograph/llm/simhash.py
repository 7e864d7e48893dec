"""Near duplicates by SimHash: 64-bit fingerprints linked at 3 or fewer differing bits, found in BK-trees.

A text's fingerprint has the bits that are set in over half of the XXH64 hashes of its three-word shingles, repeats
included. Equal fingerprints are one node. The 64 bits are cut into blocks; two nodes within the radius agree in all but
three of them, so each node enters one bucket for every choice of the blocks that agree. The more nodes there are, the
more blocks are cut, so that a bucket's key keeps many bits.

A shard holds many buckets, with a BK-tree for each: children are keyed by their Hamming distance to the parent, and a
search that stands at distance d follows only the edges from d - 3 to d + 3. All trees of a shard are built and searched
together, level by level, in the task that holds the shard. A bucket beyond HOT nodes is cut into shards of its own;
their trees are broadcast, in rounds of bounded bytes, to all tasks, which hold the bucket's nodes evenly. Links are
reduced to spanning edges where they are found, so no group's pairs leave a task.

Defined results: null or empty texts and texts without words have the fingerprint zero, linked like any other; texts
of one or two words have one shingle; a null doc_id is nobody's least id, unless a component has no other; repeated rows
are equal fingerprints; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.graph import components
from barograph.llm.staging import partitions, sized, staged
from barograph.llm.words import LOWER

RADIUS, SEED, SHINGLE = 3, 42, 3
#: Entries of a shard, nodes from which a bucket is broadcast, and bytes of trees that are broadcast at once.
SHARD, HOT, ROUND_BYTES = 1 << 19, 1 << 15, 32 << 20
#: Bytes of a text that are cut to words at a time, and (search, node) pairs that are looked at together.
PIECE, FRONTIER = 1 << 20, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs of about PIECE bytes; a run begins with the last words of the one before."""
    at, tail = 0, []
    while at < len(text):
        end = len(text)
        if at + PIECE < end:
            found = _SPACE.search(text, at + PIECE)
            end = found.start() if found else end
        words = tail + text[at:end].translate(LOWER).split()
        at = end
        if at < len(text) and len(words) < SHINGLE:
            tail = words
            continue
        yield words
        tail = words[1 - SHINGLE :]


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of a text, piece by piece."""
    digest, seen = xxhash.xxh64_intdigest, False
    for words in _word_runs(text):
        if not words or (seen and len(words) < SHINGLE):
            continue
        seen = True
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        width = min(SHINGLE, len(words))
        spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
        yield np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def fingerprint(text: bytes) -> int:
    """The bits set in over half of the shingle hashes, as an unsigned number; 0 without words."""
    counts, total = np.zeros(2048, np.int64), 0
    for hashes in shingle_hashes(text):
        for at in range(0, len(hashes), 1 << 16):
            octets = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8) + (np.arange(8) << 8)
            counts += np.bincount(octets.ravel(), minlength=2048)
        total += len(hashes)
    over = 2 * (counts.reshape(8, 256) @ _BITS).ravel() > total
    return int.from_bytes(np.packbits(over, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, node: the fingerprint of each text as a signed long."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "node"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, node long")


def block_choices(nodes: int) -> list[list[tuple[int, int]]]:
    """The choices of blocks (first bit, bits) that agree: keys of 16 bits up to 2**22 nodes, then of 25, 32, 37 bits."""
    blocks = next((b for b in range(RADIUS + 1, 7) if nodes <= 1 << (22 + 9 * (b - RADIUS - 1))), 7)
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    spans = [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(blocks)]
    return [list(c) for c in combinations(spans, blocks - RADIUS)]


def bucket_keys(choices: list[list[tuple[int, int]]]):
    """Array column with the bucket of each choice: the bits of its blocks and the choice's number."""
    out = []
    for k, blocks in enumerate(choices):
        key = F.lit(0).cast("long")
        for first, bits in blocks:
            part = F.shiftrightunsigned("node", first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
            key = F.shiftleft(key, bits).bitwiseOR(part)
        out.append(key * len(choices) + k)
    return F.array(*out)


class Forest:
    """BK-trees of many buckets in flat arrays: the root of each bucket and, by parent and distance, each node's children."""

    def __init__(self, bucket: np.ndarray, value: np.ndarray):
        order = np.lexsort((value, bucket))
        self.value, bucket = value[order].view(np.uint64), bucket[order]
        first = np.concatenate([[True], bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, bool)
        self.bucket, self.root = bucket[first], np.flatnonzero(first)
        above = np.repeat(self.root, np.diff(self.root, append=len(bucket)))
        open_ = np.flatnonzero(~first)
        edges = []
        while len(open_):
            # Of all that stand at one distance from one parent, the first is the child; the others go on below it.
            edge = above[open_] * 65 + np.bitwise_count(self.value[open_] ^ self.value[above[open_]])
            order = np.argsort(edge, kind="stable")
            open_, edge = open_[order], edge[order]
            new = np.concatenate([[True], edge[1:] != edge[:-1]])
            child = open_[new]
            edges.append((edge[new], child))
            above[open_] = np.repeat(child, np.diff(np.flatnonzero(new), append=len(open_)))
            open_ = open_[~new]
        self.edge = np.concatenate([e for e, _ in edges]) if edges else np.zeros(0, np.int64)
        self.child = np.concatenate([c for _, c in edges]) if edges else np.zeros(0, np.int64)
        order = np.argsort(self.edge)
        self.edge, self.child = self.edge[order], self.child[order]

    def search(self, bucket: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place of the value, node) within the radius, part by part; each value searches the tree of its bucket."""
        value = value.view(np.uint64)
        if not len(self.bucket):
            return
        at = np.minimum(np.searchsorted(self.bucket, bucket), len(self.bucket) - 1)
        own = np.flatnonzero(self.bucket[at] == bucket)
        work = [(own[k : k + FRONTIER // 8], self.root[at[own[k : k + FRONTIER // 8]]]) for k in range(0, len(own), FRONTIER // 8)]
        while work:
            who, node = work.pop()
            apart = np.bitwise_count(value[who] ^ self.value[node]).astype(np.int64)
            near = apart <= RADIUS
            yield who[near], node[near]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(apart - RADIUS, 0))
            n = np.searchsorted(self.edge, node * 65 + np.minimum(apart + RADIUS, 64), side="right") - low
            ends = np.cumsum(n)
            at = 0
            while at < len(n):  # the next level, in parts of about FRONTIER pairs
                done = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, done + FRONTIER, side="right")))
                part = slice(at, end)
                if ends[end - 1] > done:
                    place = np.arange(ends[end - 1] - done) + np.repeat(low[part] - (ends[part] - n[part] - done), n[part])
                    work.append((np.repeat(who[part], n[part]), self.child[place]))
                at = end


class Joined:
    """Union-find over values; keeps the links that joined two sets."""

    def __init__(self):
        self.above: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        once = a < b  # each link is met from both ends
        for x, y in zip(a[once].tolist(), b[once].tolist()):
            u, v = self.root(x), self.root(y)
            if u != v:
                self.above[max(u, v)] = min(u, v)
                self.links.append((x, y))

    def batch(self) -> pa.RecordBatch:
        links, self.links = self.links, []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _link_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of a shard's buckets; a shard has about SHARD entries."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    bucket, value = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    forest, joined = Forest(bucket, value), Joined()
    for who, node in forest.search(bucket, value):
        joined.add(value[who], forest.value[node].view(np.int64))
    yield joined.batch()


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tree of each slice of a hot bucket, as the bytes of its arrays."""
    for batch in batches:
        rows = []
        for bucket, values in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = values.values.to_numpy()
            tree = Forest(np.full(len(values), bucket), values)
            rows.append((bucket, tree.value.tobytes(), tree.edge.tobytes(), tree.child.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.binary()) for k in range(4)],
                                         names=["bucket", "value", "edge", "child"])


def _read_tree(bucket: int, *arrays: bytes) -> Forest:
    tree = Forest(np.zeros(0, np.int64), np.zeros(0, np.int64))
    tree.bucket, tree.root = np.array([bucket]), np.zeros(1, np.int64)
    tree.value, tree.edge, tree.child = (np.frombuffer(a, k) for a, k in zip(arrays, (np.uint64, np.int64, np.int64)))
    return tree


def _hot_links(entries: DataFrame, hot: DataFrame) -> DataFrame | None:
    """Spanning links of hot buckets: trees of slices of HOT / 2 nodes, broadcast in rounds, searched by all members."""
    spark = entries.sparkSession
    members = staged(entries.join(hot, "bucket").repartition(partitions(spark)), "hot-members")
    slice_no = F.pmod(F.xxhash64("node"), F.ceil(2 * F.col("k") / HOT))
    slices = members.groupBy("bucket", slice_no.alias("slice")).agg(F.collect_list("node").alias("nodes"))
    trees = slices.select("bucket", "nodes").mapInArrow(_trees, "bucket long, value binary, edge binary, child binary")
    trees = staged(trees.withColumn("own", F.xxhash64("bucket", "value")), "trees")
    taken = trees.agg(F.sum(F.length("value") + F.length("edge") + F.length("child"))).first()[0] or 0
    rounds, links = -(-taken // ROUND_BYTES), None
    for k in range(rounds):
        sent = spark.sparkContext.broadcast([tuple(r)[:4] for r in trees.where(F.pmod("own", F.lit(rounds)) == k).collect()])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            joined, trees = Joined(), [_read_tree(*t) for t in sent.value]
            for batch in batches:
                bucket, value = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for tree in trees:
                    for who, node in tree.search(bucket, value):
                        joined.add(value[who], tree.value[node].view(np.int64))
                yield joined.batch()

        found = staged(members.select("bucket", "node").mapInArrow(search, "u long, v long"), "hot-links")
        links = found if links is None else links.union(found)
        sent.destroy()
    return links


def links(nodes: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints that join all that are within the radius, directly or through others."""
    spark, n = nodes.sparkSession, nodes.count()
    choices = block_choices(n)
    entries = nodes.select(F.explode(bucket_keys(choices)).alias("bucket"), "node")
    hot = staged(entries.groupBy("bucket").agg(F.count("*").alias("k")).where(F.col("k") > HOT), "hot-buckets")
    wanted = sized(hot, F.lit(0))
    shards = max(partitions(spark), -(-n * len(choices) // SHARD))
    found = entries.join(wanted, "bucket", "left_anti").repartition(shards, "bucket").mapInArrow(_link_shard, "u long, v long")
    rest = None if hot.isEmpty() else _hot_links(entries, wanted)
    return found if rest is None else found.union(rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id reachable by links)."""
    rows = staged(fingerprints(docs), "fingerprints")
    nodes = staged(rows.groupBy("node").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(links(nodes.select("node")))
    named = nodes.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = staged(named.join(least, "root").select("node", "component_id"), "components")
    rows = rows.join(sized(named, F.lit(0)), "node", "left")
    return rows.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")
