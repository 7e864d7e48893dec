"""Counts and base scores by brute force, probabilities that sum to one, and a gain on held-out texts."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from barograph.llm import lm, queries


def brute(rows):
    cut = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in rows}
    out = {i for i in cut if zlib.crc32(str(i).encode()) % 5 == 1}
    c = collections.Counter(w for i, ws in cut.items() if i not in out for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (i in out, len(ws), sum(c[w] > 0 for w in ws), n,
                sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in cut.items()}


def test_base_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute(docs)
    rows = queries.op3_lm_scoring(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        held, n, known, train, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([("a b a b c",), ("a b b a d",), (None,), ("",)], "text string")
    model = lm.train(texts, state_share=0.1, known_share=0.0)
    a = model.automaton
    p_root = 10 ** a.root
    assert p_root.sum() + 0.5 / model.total == pytest.approx(1)
    for h in range(len(a.states)):
        total = 0.0
        for w, p in zip(a.known, p_root):
            s = np.flatnonzero(a.states == w)
            arc = np.flatnonzero(a.arcs == h * len(a.states) + s[0]) if len(s) else []
            total += 10 ** a.weights[arc[0]] if len(arc) else p * 10 ** a.failure[h]
        assert total + 0.5 / model.total * 10 ** a.failure[h] == pytest.approx(1)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = lm.train(empty.select("text"))
    assert lm.scores(empty, model).count() == 0
    odd = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "É é\x0bx", 0), (2, "x " * 50_000, 1), (2, "x " * 50_000, 1)],
                                "doc_id long, text string, base int")
    rows = lm.scores(odd, lm.train(odd.select("text"))).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 4, 50_001, 50_001]
    assert all(r.n_known == r.n_tokens for r in rows)
    assert all(math.isfinite(r.score) for r in lm.scores(odd, model).collect())


def brute_score(train, text):
    """The score of a text with every bigram that occurs twice as an arc."""
    def cut(t):
        return t.split() + [None]
    c = collections.Counter(w for t in train for w in cut(t))
    both = collections.Counter(x for t in train for x in zip([None] + cut(t)[:-1], cut(t)))
    n, v = sum(c.values()), len(c)
    root = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    out, before = 0.0, None
    for w in cut(text):
        arcs = {b: (k - 0.75) / c[before] for (a, b), k in both.items() if a == before and k >= 2}
        out += math.log10(arcs[w] if w in arcs else root(w) * (1 - sum(arcs.values())) / (1 - sum(map(root, arcs))))
        before = w
    return out


@pytest.mark.parametrize("known_share", [0.0, 0.01, 0.1, 1.0])
def test_repeated_bigrams_are_arcs_at_every_size(spark, known_share):
    """Bigrams seen twice among many tokens count, whether broadcast or joined."""
    train = ["red fox runs"] * 2 + [f"a b c w{i % 40} d{i % 7}" for i in range(400)] + ["sly red fox", ""]
    texts = ["red fox runs", "red fox red fox runs a b", "w3 d3 unseen red", "", "runs a c w39 d4 sly"]
    model = lm.train(spark.createDataFrame([(t,) for t in train], "text string"), known_share=known_share)
    rows = lm.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.score for r in rows} == pytest.approx({i: brute_score(train, t) for i, t in enumerate(texts)}, rel=1e-9)


def test_rare_bigrams_of_a_larger_corpus(spark):
    """The count that makes an arc doesn't rise with the corpus."""
    train = [" ".join(f"v{(i * 7919 + j * j * 31) % 5003}" for j in range(100)) for i in range(1500)] + ["red fox runs"] * 2
    docs = spark.createDataFrame([(t,) for t in train], "text string")
    text = spark.createDataFrame([(1, "red fox runs")], "doc_id long, text string")
    row = lm.scores(text, lm.train(docs, known_share=1e-3)).first()
    assert row.score == pytest.approx(brute_score(train, "red fox runs"), rel=1e-9)
