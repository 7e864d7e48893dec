"""Spelling variants: the whole result against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from barograph.llm import queries, spelling


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            check = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if check % 199 == 0:
                run = run[: check % len(run)] + run[check % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: set() for w in counts}
    by_length = {}
    for w in counts:
        by_length.setdefault(len(w), []).append(w)

    def one_edit(a, b):
        k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]

    for size, own in by_length.items():
        for a in own:
            for b in [x for x in own if x > a] + by_length.get(size + 1, []):
                if one_edit(a, b):
                    near[a].add(b)
                    near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return sorted(out)


def found(df):
    assert df.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(tuple(r) for r in df.collect())


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    assert found(queries.op13_spelling_variants(spark, sf)) == want
    assert len(want) > 300


def test_chains_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "HELD", 20)
    rng = random.Random(5)
    words = ["colour", "coloré", "abcdef", "àÀÿ×÷ß", "aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab", "bababab", "SHOUT" * 2]
    for _ in range(60):
        w = list(rng.choice(words))
        k = rng.randrange(len(w))
        w[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "é"])
        words.append("".join(w))
    rows = [(i, rng.choice([" ", "-", "1", "\n"]).join(rng.choice(words[: 1 + rng.randrange(len(words))]) for _ in range(60))) for i in range(120)]
    rows += [(None, None), (1, None), (2, ""), (None, "colour " * 400), (3, "x" * 5000 + " "), *[(9 + k, "y" * 20_000) for k in range(6)]] + rows[:3]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, word int, n int, root int, form int, size int")
    got = found(spelling.variants(spelling.word_counts(docs)))
    assert got == brute(rows)
    assert any(r[3] and r[5] != r[3] for r in got)
    assert found(spelling.variants(spelling.word_counts(docs.limit(0)))) == []
