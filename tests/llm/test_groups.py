"""Exact and near duplicates, shards, mixing, licences and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from barograph.llm import exact_dedup, graph, licenses, mixing, near_dedup, queries, sharding

CLASHING = "doc_id long, text string, source string, size int, key int, target int, copies int, slot int, kept int, node int"
ROWS = [(1, None, None), (2, "", "b"), (None, "x y z", "a"), (None, None, None), (3, "x y z", "a"), (3, "x y z", "a"), (4, "word " * 50_000, "a")]


def odd(spark):
    return spark.createDataFrame([(i, t, s, 1, 1, 1, 1, 1, 1, 1) for i, t, s in ROWS], CLASHING)


def test_directory_splits_only_what_is_overfull():
    weights = np.ones(16)
    weights[5] = 100
    directory = exact_dedup.grow_directory(weights, 5)
    sums = np.bincount(np.repeat(directory.slots, 16 // len(directory.slots)), weights=weights)
    assert directory.depth == 4 and all(s <= 5 for s in np.delete(sums, directory.slots[5]))
    assert list(directory.slots) == sorted(directory.slots)
    assert exact_dedup.grow_directory(weights, 1e9).buckets == 1


def test_exact_edges(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256[:6]) for r in exact_dedup.exact_duplicates(odd(spark)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:6]
    assert got == {(1, 2, 3, False, sha("")), (2, 2, 3, True, sha("")), (None, 2, 3, False, sha("")), (None, 3, 3, False, sha("x y z")),
                   (3, 3, 3, True, sha("x y z")), (4, 4, 1, True, sha("word " * 50_000))}
    assert exact_dedup.exact_duplicates(odd(spark).limit(0)).count() == 0
    small = exact_dedup.exact_duplicates(odd(spark), bucket_bytes=1)
    assert {(r.doc_id, r.keep_id) for r in small.collect()} == {(i, k) for i, k, *_ in got}


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [
        (200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(50)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == find(x) for x in list(parent))


def brute_components(rows, size):
    sets = {}
    for i, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(size, len(ws))
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if k else set()
    parent = {i: i for i in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    """Chains of edits: a group whose members are linked only through others, besides copies and short texts."""
    rng = random.Random(size)
    texts = []
    for g in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 160))]
        for _ in range(10):
            texts.append(" ".join(words))
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                words = list(words)
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    texts += ["", None, "One", "one", "one two", "ONE\ttwo", "one two three", " "] + texts[:5]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, size).collect()}
    assert got == want
    kept = near_dedup.deduplicated(docs, size)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_one_row_of_each_group_stays_with_null_and_repeated_ids(spark):
    a, b = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(None, a, 1), (None, a, 2), (7, a + " end", 3), (7, b, 4), (7, b, 5), (8, b.upper(), 6), (None, None, 7), (7, "", 8), (None, "alone", 9),
            (None, "alone", 10), (9, "single", 11), (10, "Single", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _dropped int")
    docs = docs.selectExpr("*", "1 as node", "2 as row", "3 as `a.b`", "4 as best")
    got = near_dedup.deduplicated(docs, 5)
    assert got.columns == docs.columns
    kept = [(r.doc_id, (r.text or "").lower()) for r in got.collect()]
    assert sorted(kept, key=str) == sorted([(7, a + " end"), (7, b), (None, ""), (7, ""), (None, "alone"), (9, "single")], key=str)
    same = spark.createDataFrame([(1, a)] * 4, "doc_id long, text string")
    assert near_dedup.deduplicated(same).count() == 1
    assert near_dedup.deduplicated(same.limit(0)).count() == 0


def test_near_edges(spark):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_duplicates(odd(spark), 2).collect())
    assert got == [("1", 0, "1", True), ("2", 0, "2", True), ("3", 2, "3", True), ("3", 2, "3", True), ("4", 1, "4", True),
                   ("None", 0, "None", True), ("None", 2, "None", True)]
    assert near_dedup.near_duplicates(odd(spark).limit(0)).count() == 0


def test_shards(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_sharding(spark, sf).collect()
    assert len(rows) == len(texts)
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    loads = np.bincount([r.shard for r in rows], weights=[r.size for r in rows])
    assert loads.max() - loads.min() < 0.05 * loads.mean()
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))


def test_slot_map_versions(spark, tmp_path):
    rng = np.random.default_rng(3)
    weights = rng.integers(1, 1000, 4096)
    first = sharding.SlotMap.packed(weights, 8)
    weights[np.array(first.shard_of) == 2] *= 3
    second = first.rebalanced(weights)
    assert second.version == 2 and second.loads(weights).max() <= 1.02 * weights.sum() / 8
    moved = np.array(first.shard_of) != np.array(second.shard_of)
    assert moved.mean() < 0.35
    third = second.grown(weights, 9)
    changed = np.array(second.shard_of) != np.array(third.shard_of)
    assert set(np.array(third.shard_of)[changed]) == {8}
    assert third.loads(weights)[8] == pytest.approx(weights.sum() / 9, rel=0.05)
    for m in (first, second, third):
        m.save(spark, str(tmp_path))
    assert sharding.SlotMap.load(spark, str(tmp_path), 2) == second


def test_shard_edges(spark):
    rows = sharding.sharded(odd(spark)).collect()
    assert len(rows) == len(ROWS) and sum(r.size for r in rows) == sum(len(t or "") + 1 for _, t, _ in ROWS)
    assert sharding.sharded(odd(spark).limit(0)).count() == 0
    assert sharding.repartitioned(odd(spark)).count() == len(ROWS)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, filled, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return filled | {s: level * weight[s] for s in free}
        filled |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    return filled


def test_mixing_targets_and_copies(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in texts}
    source = {r.doc_id: r.source for r in texts}
    sums = {}
    for i, n in size.items():
        sums[source[i]] = sums.get(source[i], 0) + n
    want, rows = brute_targets(sums), queries.op10_mixing(spark, sf).collect()
    taken = dict.fromkeys(sums, 0)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sums[s]) and r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(n for i, n in size.items() if source[i] == s)
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in queries.op10_mixing(spark, sf).collect()}


def test_mixing_edges(spark):
    rows = mixing.mixed_sizes(odd(spark)).collect()
    assert len(rows) == len(ROWS) and sum(r.size for r in rows) == 9 + 50_000
    assert mixing.mixed_sizes(odd(spark).limit(0)).count() == 0
    drawn = mixing.mixed(odd(spark))
    assert drawn.columns == odd(spark).columns
    assert drawn.count() == sum(r.copies for r in rows)


def test_licences(spark):
    texts = ["Intro here.\nLicensed under the Apache License, Version 2.0. More text.", "Released under the MIT License.\nAll rights reserved.",
             "The MIT license is short.", None, "", 'Released under the MIT License! THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.',
             "Licensed under CC BY-NC 4.0.", "x " * 50_000 + "\n\nSPDX-License-Identifier: GPL-3.0-only"]
    rows = {r.doc_id: r for r in licenses.licences(spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, found int")).collect()}
    assert [rows[k].licences for k in range(8)] == ["Apache-2.0", "MIT,all-rights-reserved", "", "", "", "MIT", "CC-BY-NC-4.0", "GPL-3.0"]
    assert rows[5].sentence_ids == "mit-ref,mit-warranty" and rows[3].n_sentences == 0
    assert licenses.licences(odd(spark).limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2020 Ann

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


def test_licences_of_real_texts(spark):
    name = ("3. Neither the name of the copyright holder nor the names of its contributors\n may be used to endorse or promote products "
            "derived from this software\n without specific prior written permission.")
    old = ("# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU {}General Public\n"
           "# License as published by the Free Software Foundation; either\n# version {} of the License, or (at your option) any later version.")
    want = {MIT: "MIT", MIT.split("Ann\n\n")[1].replace("\n", " "): "MIT", MIT[13:].replace("\n", " "): "MIT", "MIT License": "MIT", BSD: "BSD-2-Clause", BSD + name: "BSD-3-Clause",
            "Licensed under the Apache License 2.0": "Apache-2.0", old.format("", 2): "GPL-2.0", old.format("Lesser ", 2.1): "LGPL-2.1",
            "SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0", "This is free and unencumbered\nsoftware released into the public domain.": "Unlicense",
            "Licensed under CC0 1.0": "CC0-1.0", "ISC License\n\nOther": "ISC", "This project is licensed under\nthe MIT License": "MIT",
            "This project is licensed under\n\nthe red MIT License": "", "Licensed under\n\nMIT": ""}
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    rows = {r.doc_id: r.licences for r in licenses.licences(docs).collect()}
    assert [rows[k] for k in range(len(want))] == list(want.values())


def test_bsd_clauses_name_their_holder(spark):
    """A name of any length, also over lines; without the clause it is the shorter licence."""
    start = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
             "conditions are met:\n" + licenses.TEXTS["bsd-source"] + "\n" + licenses.TEXTS["bsd-binary"] + "\n")
    clause = ("Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software "
              "without specific prior written permission.")
    texts = [start, start + clause.format("Google Inc."), start + clause.format("the University of California,\nBerkeley and others"),
             start + clause.format("the copyright holder")]
    rows = licenses.licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.licences for r in sorted(rows, key=lambda r: r.doc_id)] == ["BSD-2-Clause"] + ["BSD-3-Clause"] * 3


def test_hint_covers_every_licence_sentence():
    assert [x for x in licenses.SENTENCES if not re.search(licenses.HINT, x)] == []
    assert {i for i in licenses.SENTENCES.values() if i.endswith("-ref")} <= {r[0] for r, _ in licenses.RULES if len(r) == 1}



def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    rows = out.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id] == r.text for r in rows)
    ids = {r.doc_id for r in rows}
    components = brute_components([(i, texts[i]) for i in ids], 5)
    assert all(i == c for i, (_, c) in components.items())
    assert not any(re.search(r"\b(idiot|moron|loser|scum)\b", texts[i].lower()) for i in ids)
    assert set(r.shard for r in rows) <= set(range(8))


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "q w e r t y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        current = start
        for name, stage in corpus_pipeline.STAGES:
            current = stage(spark, current, str(tmp_path))
            if name != "sharding":
                assert current.columns == docs.columns, name
        assert set(current.columns) >= set(docs.columns)
        current.count()
