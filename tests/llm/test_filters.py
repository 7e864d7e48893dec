"""Toxicity grammar, HTML labeller and decontamination."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.llm import decontaminate, html_text, queries, toxicity

CLASHING = "doc_id long, text string, score double, clauses string, n_words int, hits int, row int, w int"


def odd(spark):
    return spark.createDataFrame([(1, None, 0.0, "", 1, 1, 1, 1), (2, "", 0.0, "", 1, 1, 1, 1), (None, "You idiot!", 0.0, "", 1, 1, 1, 1),
                                  (3, "word " * 60_000, 0.0, "", 1, 1, 1, 1), (3, "word " * 60_000, 0.0, "", 1, 1, 1, 1)], CLASHING)


def test_composition_equals_running_in_turn():
    rng = random.Random(1)
    machines = [toxicity._emitting("I"), toxicity._emitting("T"), toxicity._reaching("N", 3, "negated"), toxicity._quoting(),
                toxicity._reaching("Y", 4, "aimed")]
    for _ in range(50):
        symbols = "".join(rng.choice(toxicity.ALPHABET) for _ in range(40))
        want = [frozenset().union(*outs) for outs in zip(*(m.outputs(symbols) for m in machines))]
        assert toxicity.FORWARD.outputs(symbols) == want


def test_readings():
    grammar = toxicity.Grammar({"idiot": 1.0, "kill": 1.0}, {"stupi": 1.0})
    read = lambda text: [(k, r) for _, _, k, r, _ in grammar.clauses(text)]
    assert read("You are an idiot.") == [("I", "aimed")]
    assert read("An idiot, you see, came.") == [("I", "plain")]
    assert read("What an idiot you are") == [("I", "aimed")]
    assert read("It is not an idiot") == [("I", "negated")]
    assert read('Ann said that idiot came. "Stupidity" rules') == [("I", "reported"), ("I", "reported")]
    assert read("I will kill you") == [("T", "aimed")]
    assert read("idiotic unstupid skill killer") == []
    assert read("He said, you are an idiot.") == read("He said: you are an idiot.") == [("I", "reported")]
    assert read('She wrote: "Well, you are stupid, an idiot, he thinks".') == [("I", "reported")] * 2
    assert read("You are not, in my view, an idiot.") == [("I", "negated")]
    assert read("No, you idiot!") == [("I", "aimed")]
    assert read("She said so. You idiot") == [("I", "aimed")]
    assert read("‘You idiot. You idiot,’ she cried. You idiot") == [("I", "reported"), ("I", "reported"), ("I", "aimed")]
    assert read("'You idiot.' It's the dogs' way, you idiot") == [("I", "reported"), ("I", "aimed")]
    assert read("„Du idiot“ sagte er. Du idiot") == [("I", "reported"), ("I", "aimed")]
    assert read('A 5" screen, you idiot') == read('"An open mark\n\nYou idiot') == [("I", "aimed")]
    assert read("She isn’t an idiot") == [("I", "negated")]
    assert read("") == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op1_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def learned(spark, toxic, clean):
    rows = [(t, 1) for t in toxic] + [(t, 0) for t in clean]
    return toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))[0]


def test_insult_that_follows_one_word_is_learned(spark):
    fill = [f"row{i} day{i * 7} thing{i % 13} mood{i * 3}" for i in range(400)]
    toxic = [f"{fill[i]} you clown {fill[i + 100]}" for i in range(30)]
    clean = fill + [f"{fill[i]} she is not a clown {fill[i + 50]}" for i in range(20)]
    assert "clown" in learned(spark, toxic, clean)
    assert "ox" in learned(spark, [t.replace("clown", "ox") for t in toxic], clean)
    assert "clown" not in learned(spark, toxic[:1] * 30, clean)  # copies of one text


def test_plain_uses_leave_out_reported_words():
    uses = lambda text: set(toxicity.plain_uses(text)[1])
    assert uses("He said, you clown. Red fox") == {"red", "fox"}
    assert uses('He: "Ah, a clown. A clown!" Blue') == {"blue"}
    assert uses("A fool is not, by far, a clown, old man") == {"a", "fool", "is", "by", "far", "old", "man"}


def test_long_texts_take_time_in_proportion():
    grammar = toxicity.Grammar({"idiot": 1.0}, {})
    assert len(grammar.clauses('"' * 100_001 + " idiot « " + "« ' „ ‘" * 20_000)) == 1
    assert len(grammar.clauses("you idiot, " * 20_000)) == 20_000


def test_toxicity_edges(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.toxicity(docs, model).collect()
    assert sorted(r.predicted for r in rows) == [0, 0, 0, 0, 1]
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.toxicity(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_slopes_of_the_labeller():
    rng = np.random.default_rng(0)
    labeller = html_text.Labeller.fresh(rng)
    labeller.parts = {k: v.astype(np.float64) for k, v in labeller.parts.items()}
    paths = (rng.random((4, 3, html_text.PATH_SIZE)) < 0.01).astype(float)
    rest = rng.normal(size=(4, 3, html_text.WORD_SIZE + html_text.FIGURES))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], float)
    label = rng.integers(0, 2, (4, 3)) * mask
    slopes, _ = labeller.gradients(paths, rest, mask, label)
    for name in ("there.x", "there.h", "back.x", "back.h", "back.b", "rest", "out", "bias"):
        part = labeller.parts[name].reshape(-1)
        for k in rng.integers(0, len(part), 3):
            was, losses = part[k], []
            for step in (1e-3, -1e-3):
                part[k] = was + step
                losses.append(labeller.gradients(paths, rest, mask, label)[1])
            part[k] = was
            assert slopes[name].reshape(-1)[k] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=2e-2, abs=2e-5)


def test_blocks():
    page = ("<head><title>No</title></head><body><p>One <b>two&amp;</b>three<br>four<p>five\n\t six<ul><li>a<li><a href=x>b</a></ul>"
            "<script>var x='</p><p>no';</script><style>p{}</style><!-- no --><div class='Side-bar adBox' id=x1>1 &lt; 2</div> tail < x")
    found = html_text.blocks(page)
    assert [t for _, t, _ in found] == ["One two&three four", "five six", "a", "b", "1 < 2", "tail < x"]
    assert found[4][0][-1] == ("div", ".side", ".bar", ".ad", ".box", ".x", ".1")
    assert [round(s) for *_, s in found] == [0, 0, 0, 1, 0, 0]
    assert html_text.blocks("") == [] and html_text.blocks("<" * 5000)[0][1] == "<" * 5000


def test_main_text(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>.*?</article>", r.html, re.S)[0]
        want[r.page_id] = " ".join(t for _, t, _ in html_text.blocks(article))
    rows = queries.op2_html_text(spark, sf).collect()
    assert len(rows) == len(want)
    assert np.mean([r.text == want[r.page_id] for r in rows]) > 0.98
    assert all(r.n_chars == len(r.text) for r in rows)


def test_main_text_of_other_layouts(spark, sf):
    labeller = html_text.fit(spark.read.parquet(f"{sf}/pages.parquet"))
    story = "".join(f"<p>The long story goes on with part {k} of many words here.</p>" for k in range(5))
    page = ("<body><div class='cookie-notice'><p>We use cookies.</p></div><header><a href=/>Site</a></header><nav><ul><li><a href=/a>Home</a></ul></nav>"
            f"<main><h1>Title</h1>{story}</main><aside class=sidebar><p>Related things</p></aside><section class=comments><p>I agree with this.</p>"
            "</section><form><label>Name</label><input><button>Send</button></form><footer>All rights</footer></body>")
    odd = spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (None, "u", "", 0), (3, "u", "<p>" + "word " * 50_000, 0)],
                                "page_id long, url string, html string, text int")
    rows = {r.page_id: r for r in html_text.main_text(odd, labeller).collect()}
    assert rows[1].text == "Title " + " ".join(f"The long story goes on with part {k} of many words here." for k in range(5))
    assert rows[2].text == "" and rows[None].n_chars == 0
    assert html_text.main_text(odd.limit(0), html_text.fit(odd.limit(0))).count() == 0


def brute_hits(text, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    listed, hit, names = cut(text), set(), set()
    for item, content in items:
        own = cut(content)
        for i in range(max(1, len(own) - window + 1)) if own else ():
            string = own[i : i + window]
            for j in range(len(listed) - len(string) + 1):
                if listed[j : j + len(string)] == string:
                    hit |= set(range(j, j + len(string)))
                    names.add(item)
    return len(listed), len(hit), sorted(names)


@pytest.mark.parametrize("share_bytes", [32 << 20, 400])
def test_decontamination_equals_brute_force(spark, share_bytes):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "c", "É9", "d"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 4, 6, 10, 11, 13, 25, 40])] + [(8, None), (9, "- !"), (10, "Zz")]
    texts = [" ".join(word() for _ in range(rng.randrange(60))) + " " + (items[k % 8][1].upper() if k % 2 else "zz")
             for k in range(24)]
    rows = list(enumerate(texts)) + [(24, None), (25, ""), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hits", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlaps(docs, bench, share_bytes=share_bytes).collect()
    assert len(got) == len(rows)
    named = [(str(i), t) for i, t in items]
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(dict(rows)[r.doc_id], named), r
    clean = decontaminate.decontaminated(docs, bench, share_bytes=share_bytes)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in got if not r.contaminated)


def test_short_items_reject_only_what_they_make_up(spark):
    long = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, "Yes, we can go on"), (2, "yes"), (3, "so: yes"), (4, "a " + long[:-7]), (5, long[:40]), (6, None), (7, "")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, "yes"), (2, long)], "item_id long, text string")
    kept = lambda **more: sorted(r.doc_id for r in decontaminate.decontaminated(docs, bench, **more).collect())
    assert kept(least_share=0.5) == [1, 5, 6, 7]
    assert kept() == [5, 6, 7]


def test_decontamination_edges(spark):
    docs, none = odd(spark), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(decontaminate.overlaps(docs, none)).where("contaminated").count() == 0
    assert decontaminate.overlaps(docs.limit(0), spark.createDataFrame([(None, "idiot")], "item_id long, text string")).count() == 0
    assert decontaminate.decontaminated(docs, none).count() == 5
