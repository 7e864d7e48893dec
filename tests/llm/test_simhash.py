"""SimHash classes: fingerprints by the definition, trees and whole results against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from barograph.llm import queries, simhash

SPACES = "[^\x20\x09-\x0d]+"


def plain_fingerprint(text):
    words = re.findall(SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)] if k else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, prints):
    """Least id of each one's component, from all pairs of fingerprints."""
    nodes = sorted(set(prints))
    values, above = np.array(nodes, np.uint64), list(range(len(nodes)))

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for i in range(len(nodes)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1:
            x, y = sorted((find(i), find(int(j))))
            above[y] = x
    least = {}
    for i, p in zip(ids, prints):
        r = find(nodes.index(p))
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(find(nodes.index(p))) for p in prints]


def check(spark, rows, got):
    want = [plain_fingerprint(t) for _, t in rows]
    expected = sorted((str(i), f"{p:016x}", str(r)) for (i, _), p, r in zip(rows, want, roots([i for i, _ in rows], want)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect()) == expected


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows, queries.op12_simhash_dedup(spark, sf))


def test_edges_and_chains(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 64)
    rng = random.Random(6)
    texts = [None, "", " \n", "One", "one two", "ONE\x0btwo", "one two three", "a b c", "A B C", "a b c a b c a b c", "x" * 500 + " y z"]
    for _ in range(12):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(30, 120))]
        for _ in range(8):
            texts.append(rng.choice([" ", "\t", "\n  "]).join(words))
            words = list(words)
            words[rng.randrange(len(words))] = f"n{rng.randrange(99)}"
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "One"), (None, "one"), (None, "only here without an id"), (5000, "word " * 60_000)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, node int, bucket int, k int, root int, fingerprint int")
    check(spark, rows, simhash.near_duplicates(docs))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def near_values(n, seed):
    """Values in dense clumps, sharing their high halves, so that buckets are large and trees deep."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**40, 40, dtype=np.uint64)
    values = centres[rng.integers(0, 40, n)]
    for _ in range(4):
        values = values ^ (np.uint64(1) << rng.integers(0, 64 if seed % 2 else 40, n).astype(np.uint64))
    return np.unique(values)


def test_forest_finds_all_pairs():
    values = near_values(1500, 1)
    bucket = (values % np.uint64(3)).astype(np.int64)
    forest = simhash.Forest(bucket, values.view(np.int64))
    got = set()
    for who, node in forest.search(bucket, values.view(np.int64)):
        got |= set(zip(values[who].tolist(), forest.value[node].tolist()))
    want = {(int(a), int(b)) for k in range(3) for a in values[bucket == k] for b in values[bucket == k][
        np.bitwise_count(values[bucket == k] ^ a) <= 3]}
    assert got == want


@pytest.mark.parametrize("hot, limit, blocks", [(1 << 15, 22, 4), (50, 22, 4), (1 << 15, 5, 5), (40, -6, 6)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, hot, limit, blocks):
    """Ordinary shards, buckets beyond HOT with several rounds of trees, and finer blocks."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "ROUND_BYTES", 20_000)
    monkeypatch.setattr(simhash, "FRONTIER", 512)
    choose = simhash.block_choices
    monkeypatch.setattr(simhash, "block_choices", lambda n: choose(1 << {4: 22, 5: 31, 6: 40}[blocks]))
    values = near_values(1200, 2 if hot < 100 else 3)
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "node long")
    rows = simhash.links(nodes).collect()
    assert all(bin((r.u ^ r.v) & (2**64 - 1)).count("1") <= 3 for r in rows)
    place = {int(v): k for k, v in enumerate(values.view(np.int64))}
    above = list(range(len(values)))

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for r in rows:
        x, y = sorted((find(place[r.u]), find(place[r.v])))
        above[y] = x
    assert [find(k) for k in range(len(values))] == roots(range(len(values)), values.tolist())


def test_keys_meet_within_the_radius():
    for nodes in (10, 1 << 25, 1 << 35, 1 << 45):
        choices = simhash.block_choices(nodes)
        assert all(any(all((flip >> first) & ((1 << bits) - 1) == 0 for first, bits in c) for c in choices)
                   for flip in [1 << a | 1 << b | 1 << c for a in range(0, 64, 5) for b in range(64) for c in range(0, 64, 3)])
