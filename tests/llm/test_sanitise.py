"""Spans against Python's own regular expressions, and the rule for disclosing terms."""

import hashlib
import re

import pytest

from barograph.llm import sanitise

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


TEXTS = [None, "", "a@b.c_d@e.f.g", "x@y ..@a.b. c@d.e@f.g", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255", "é😀 a.b+c@d-e.fr 😀 10.0.0.1",
         "4111 1111 1111 1111 4111-1111-1111-1112 378282246310005", "+1 (555) 555-0100 +12345 + 1 +49 30 1234567 ext. 2",
         "1" * 3000, "a" * 5000 + "@b.co", "+1" + " " * 3000 + "2", "4111 1111 1111 1111 " * 30, "a-@b.c@d.e+1 2 3 4 5 6 7 8 9"]


def test_base_spans_equal_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for row in sanitise.personal_data(docs.union(docs.limit(3))).collect():
        want = base(TEXTS[row.doc_id])
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for x, *_ in want) for k in PATTERNS], row
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), row
        assert row.spans.startswith(text)


def test_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sanitise.personal_data(docs).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base(texts[row.doc_id]))
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def revealing(spark):
    texts = [f"Word{chr(97 + i)} plain common Zanzibar wrote ann@site.org plain" for i in range(4)]
    texts += [f"plain common bob{i}@site.org plain text{chr(97 + i)}" for i in range(60)] + ["Later ZANZIBAR alone, plain."]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_disclosing_terms(spark, revealing):
    terms = {r.term: r for r in sanitise.disclosing(revealing, sanitise.entities(revealing)).collect()}
    assert set(terms) == {"zanzibar", "wrote"}
    assert terms["zanzibar"].share == pytest.approx(4 / 5)
    rows = {r.doc_id: r for r in sanitise.personal_data(revealing).collect()}
    assert rows[64].spans == "term:6:14" and rows[64].n_term == 1
    assert rows[10].n_term == 0


def test_sanitised_text(spark, revealing):
    texts = {r.doc_id: r.text for r in sanitise.sanitised(revealing).collect()}
    assert texts[0] == "Worda plain common   <EMAIL> plain"
    assert texts[64] == "Later  alone, plain."


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sanitise.personal_data(empty).count() == 0
    odd = spark.createDataFrame([(None, "a@b.cd", 1, "x"), (None, None, 2, "y")], "doc_id long, text string, start int, kind string")
    assert sorted(r.n_email for r in sanitise.personal_data(odd).collect()) == [0, 1]
    assert sanitise.sanitised(odd).columns == odd.columns


def disclosed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.term: r for r in sanitise.disclosing(docs, sanitise.entities(docs)).collect()}


def test_frequent_entity_hides_no_rare_one(spark):
    texts = [f"Quixote{' help@site.org' if i < 9 else ''}{' q@own.org' if i < 6 else ''} text{chr(97 + i)}" for i in range(10)]
    texts += [f"other help@site.org line{chr(97 + i)}" for i in range(20)] + [f"nothing row{i}" for i in range(60)]
    found = disclosed(spark, texts)
    assert found["quixote"].share == pytest.approx(0.6) and found["quixote"].bits == pytest.approx(3.17, abs=0.01)


def test_whole_text_is_context_and_short_terms_count(spark):
    far = " filler" * 40
    texts = [f"Miller, valid 12/26: 4111 1111 1111 1111 row{chr(97 + i)}" for i in range(3)]
    texts += [f"a{i}@x.org, b@y.org Ng spoke{far} Zorro case{chr(97 + i)}" for i in range(3)]
    texts += [f"valid filler spoke {i} 12/26" for i in range(60)]
    assert {"miller", "ng", "zorro"} <= set(disclosed(spark, texts))
    assert not {"valid", "filler", "spoke"} & set(disclosed(spark, texts))


def test_overlapping_spans_leave_nothing_of_either(spark):
    """A short span inside a long one doesn't bring the long one's end back; the caller's columns may have any names."""
    texts = ["tel +49 10.20.30.40 77 end", "+4111111111119.45", "no data", None, "a@b.de 10.0.0.1"]
    docs = spark.createDataFrame([(k, t, 1, 2, 3, 4) for k, t in enumerate(texts)], "doc_id long, text string, _spans int, d int, k int, cut int")
    got = sanitise.sanitised(docs)
    assert got.columns == docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[k].text for k in range(5)][0] == "tel <PHONE> end" and rows[1].text == "<PHONE>"
    assert (rows[2].text, rows[3].text, rows[4].text) == ("no data", None, "<EMAIL> <IP>")
    assert (rows[0]._spans, rows[0].d, rows[0].k, rows[0].cut) == (1, 2, 3, 4)
