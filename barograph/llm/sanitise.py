"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are what the base patterns find: e-mail addresses, IP addresses, card and phone numbers. For every
term of a document with an entity the corpus says how strongly it reveals that entity: p = P(entity | term) over all documents, and
the information log2(p / P(entity)). Terms over both thresholds that go with the entity in at least two different texts
are spans of kind `term`, wherever they stand; sanitised() generalises entities to their kind and removes such terms.

Spans are code points, end exclusive. Texts are cut at the matches of a pattern, and starts are running sums of the
lengths of the pieces, so texts of any length and any number of matches work.

Defined results: a null text counts as empty and has no spans; a null doc_id is a document like any other; repeated rows
get the same spans; an empty table gives no rows; extra columns are ignored (sanitised() keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.llm.staging import sized, staged

KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns. A match can only begin at the start of a run of its first class, or where the last match ended;
#: said so, and with runs that are never given back, the same matches are found in one pass over the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}+(?![\p{L}\p{N}@])"
#: Thresholds of disclosure.
LEAST_SHARE, LEAST_BITS, LEAST_TEXTS = 0.5, 3.0, 2


def _luhn(digits: Column) -> Column:
    """Digit sum from the right, every second digit doubled."""
    backward = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(backward, lambda d: d != ""), lambda d, i: F.when(
        i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """Whether a pattern's match passes its check."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    # Numbers are checked only in the length that they may have; a longer run is no number, and is not taken apart.
    return (F.when(kind == "ip", match.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
            .when(kind == "card", n.between(13, 19) & _luhn(F.when(n.between(13, 19), digits).otherwise("")))
            .when(kind == "phone", n.between(9, 15)).otherwise(True))


def _found(text: Column, kind: str) -> Column:
    """struct(kind, pieces, matches) of a text for one pattern."""
    pattern, need = F.lit(PATTERNS[kind]), NEEDS[kind]
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    if need:
        matches = F.when(text.contains(need), matches).otherwise(F.array().cast("array<string>"))
    pieces = F.when(F.size(matches) > 0, F.split(text, pattern, -1))
    return F.struct(F.lit(kind).alias("kind"), pieces.alias("pieces"), matches.alias("matches"))


def _placed(found: DataFrame, more: dict[str, Column]) -> DataFrame:
    """Rows (doc_id, text_key, kind, start, stop, match, ...) from rows with structs of pieces and matches."""
    pieces = F.col("f.pieces")
    parts = F.arrays_zip(F.transform(pieces, F.length).alias("lengths"), F.col("f.matches").alias("matches"),
                         *[c.alias(name) for name, c in more.items()])
    parts = F.slice(parts, F.lit(1), F.size("f.matches"))
    rows = found.select("doc_id", "text_key", F.col("f.kind").alias("kind"), F.posexplode(parts).alias("n", "part"))
    # Repeated rows of a document have the same parts.
    rows = rows.select("doc_id", "text_key", "kind", "n", F.col("part.lengths").alias("gap"),
                       F.col("part.matches").alias("match"), *[F.col(f"part.{name}").alias(name) for name in more])
    rows = rows.dropDuplicates(["doc_id", "text_key", "kind", "n"])
    before = Window.partitionBy("doc_id", "text_key", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("match")).over(before)
    return rows.select("doc_id", "text_key", "kind", (stop - F.length("match")).alias("start"), stop.alias("stop"), "match",
                       *more)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def entities(docs: DataFrame) -> DataFrame:
    """Base spans: doc_id, text_key, kind, start, stop, match of every valid match."""
    found = keyed(docs).select("doc_id", "text_key", F.explode(F.array(*[_found(F.col("text"), k) for k in PATTERNS])).alias("f"))
    spans = _placed(found.where(F.size("f.matches") > 0), {})
    return spans.where(valid(F.col("kind"), F.col("match")))


def terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def disclosing(docs: DataFrame, spans: DataFrame, least_share: float = LEAST_SHARE, least_bits: float = LEAST_BITS,
               least_texts: int = LEAST_TEXTS) -> DataFrame:
    """(term, share, bits): terms that reveal a protected entity; counts are over all documents."""
    value = F.concat_ws(":", "kind", F.when(F.col("kind") == "email", F.lower("match"))
                        .when(F.col("kind") == "ip", F.col("match")).otherwise(F.regexp_replace("match", "[^0-9]", "")))
    own = spans.select("doc_id", "text_key", value.alias("entity")).distinct()
    of_entity = own.groupBy("entity").agg(F.count("*").alias("n_entity"),
                                          F.countDistinct("text_key").alias("texts")).where(F.col("texts") >= least_texts)
    total = docs.select(F.count("*").alias("n"))
    # An entity has least_bits at a share of one or never: these leave before they meet terms.
    of_entity = of_entity.crossJoin(F.broadcast(total)).where(F.log2(F.col("n") / F.col("n_entity")) >= least_bits)  # one row
    own = own.join(of_entity.drop("texts", "n"), "entity")
    # Repeated rows of a document count once, as their spans do.
    texts = keyed(docs).withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    held = own.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("entity", "n_entity")).alias("entities"))
    joint = texts.join(held, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key"))).dropDuplicates(["d", "k"])
    joint = joint.select("text_key", "entities", F.explode(terms(F.col("text"))).alias("term"))
    joint = joint.select("text_key", "term", F.inline("entities")).groupBy("term", "entity").agg(
        F.count("*").alias("n_both"), F.countDistinct("text_key").alias("texts"), F.first("n_entity").alias("n_entity"))
    joint = joint.where(F.col("texts") >= least_texts)
    counts = keyed(docs).select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    share = F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))
    rated = joint.join(counts, "term").crossJoin(F.broadcast(total)).select(  # one row
        "term", share.alias("share"), F.log2(share * F.col("n") / F.col("n_entity")).alias("bits"))
    # Thresholds first: a frequent entity of a large share must not hide a rare one.
    rated = rated.where((F.col("share") >= least_share) & (F.col("bits") >= least_bits))
    return rated.groupBy("term").agg(F.max(F.struct("share", "bits")).alias("r")).select("term", "r.share", "r.bits")


def term_spans(docs: DataFrame, spans: DataFrame, **thresholds: float) -> DataFrame:
    """Spans of disclosing terms in all documents: doc_id, text_key, kind, start, stop, match."""
    marked = staged(disclosing(docs, spans, **thresholds).select("term"), "disclosing-terms")
    small = sized(marked, F.octet_length("term"))
    hits = keyed(docs).select("doc_id", "text_key", F.explode(terms(F.col("text"))).alias("term")).join(small, "term")
    hits = staged(hits.groupBy("doc_id", "text_key").agg(F.collect_set("term").alias("terms")), "disclosing-documents")
    hits = sized(hits.withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "k"),
                  F.octet_length(F.concat_ws(",", "terms")))
    rows = keyed(docs).join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    # Longest first: a term that begins another one must not win.
    listed = F.array_join(F.array_sort("terms", lambda a, b: F.length(b) - F.length(a)), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}@._%+-])(?:"), listed, F.lit(r")(?![\p{L}\p{N}@])"))
    matches = F.regexp_extract_all("text", pattern, F.lit(0))
    found = rows.select("doc_id", "text_key", F.struct(
        F.lit("term").alias("kind"), F.split("text", pattern, -1).alias("pieces"), matches.alias("matches")).alias("f"))
    return _placed(found.where(F.size("f.matches") > 0), {})


def all_spans(docs: DataFrame, **thresholds: float) -> DataFrame:
    """Base and term spans: doc_id, text_key, kind, start, stop, match."""
    base = staged(entities(docs), "entity-spans")
    columns = ["doc_id", "text_key", "kind", "start", "stop", "match"]
    return base.select(columns).unionByName(term_spans(docs, base, **thresholds).select(columns))


def personal_data(docs: DataFrame, **thresholds: float) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    spans = all_spans(docs, **thresholds).select("doc_id", "text_key", rank.alias("rank"), "start", "stop", "kind")
    listed = spans.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("rank", "start", "stop", "kind"))).alias("spans"))
    listed = listed.withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "k")
    rows = keyed(docs).drop("text").join(listed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    shown = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    rows = rows.select("doc_id", F.coalesce("spans", F.array().cast("array<struct<rank:int,start:bigint,stop:bigint,kind:string>>")).alias("spans"))
    return rows.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                       F.sha2(shown(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"),
                       shown(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, **thresholds: float) -> DataFrame:
    """docs with `text` rebuilt: entities generalised to <KIND>, disclosing terms removed; null texts stay null.

    Of spans that overlap, the first one speaks for all: whatever any of them covers is gone.
    """
    spans = all_spans(docs, **thresholds).groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("spans"))
    parts = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at:bigint,start:bigint,kind:string>>").alias("parts"))
    # A span begins where the farthest span before it has ended, or shows nothing.
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] < acc["at"], acc["parts"]).otherwise(
        F.concat(acc["parts"], F.array(F.struct(acc["at"].alias("at"), s["start"].alias("start"), s["kind"].alias("kind"))))).alias("parts"))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.aggregate("spans", parts, step).alias("cut"))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # the caller's columns may have any names
    rows = docs.select(own.alias("row")).join(spans, F.col("row.doc_id").cast("long").eqNullSafe(F.col("d"))
                                              & (F.xxhash64("row.text") == F.col("k")), "left")
    shown = F.transform("cut.parts", lambda c: F.concat(
        F.substring(F.col("row.text"), (c["at"] + 1).cast("int"), (c["start"] - c["at"]).cast("int")),
        F.when(c["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(c["kind"]), F.lit(">")))))
    rest = F.substring(F.col("row.text"), (F.col("cut.at") + 1).cast("int"), F.length("row.text"))
    text = F.when(F.col("cut").isNull(), F.col("row.text")).otherwise(F.concat(F.array_join(shown, ""), rest))
    return rows.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
