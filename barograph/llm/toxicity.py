"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, report, opening and closing quote, comma, border or other. Five
transducers read the symbols of a sentence: insults and threats emit their kind, the others say of each whether it is aimed
at someone, negated or reported. Their composition is one table; a sentence that holds an insult or a threat is read once in
each direction (a target may follow). Targets reach to the end of their clause; a negation reaches over words set off by
commas right behind it ("not, in my view, an idiot"); a verb of reporting reaches over commas, colons and semicolons to the end of the
sentence, a quote to its closing mark, over sentences, if that stands in the same paragraph. Each clause adds its weight to
the feature of its kind and reading. A logistic function of the features is the score.

Insults are learned: words, and stems that begin several words, whose documents are labelled toxic much more often than
by chance, counted over uses that are neither negated nor reported. Different surroundings of a term, four words on each
side, are counted as evidence, so copies of one text count once and words that always follow one word count in full. Weights of words
and features come from at most `max_rows` labelled documents (those with the least hashed ids); all documents are scored
on their whole text.

Defined results: null and empty texts have no clause and get the score of a text without matches; labels without a value
or without a document are left out, of several labels of a document the largest counts; without labels the words given
below and fixed weights are used; repeated rows are scored each for itself; an empty table gives no rows; extra columns
are ignored; texts of any length are read whole, in time in proportion to it; of terms that begin at one place the weightier one
counts, the one found first at equal weight.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm.staging import staged

INSULTS = "idiot moron stupid loser pathetic worthless disgusting scum imbecile cretin dumbass bastard".split()
THREATS = "kill murder hurt destroy strangle töte töten umbringen tuer tuerai matar mataré".split()
TARGETS = ("you your yours yourself he she they him her them his their du dich dir dein ihr euch sie er tu toi te vous "
           "votre il elle ils elles tú ti usted ustedes él ella ellos").split()
NEGATIONS = "not never no neither nor without isn't aren't nicht kein keine nie niemals ne pas jamais nunca ni sin".split()
REPORTS = ("said says say wrote writes called calls claimed reported quoted told sagte schrieb nannte dit écrit appelé "
           "dijo escribió llamó").split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OPEN, CLOSE, COMMA, BORDER, OTHER = "ITYNR(),;O"
ALPHABET = INSULT + THREAT + TARGET + NEGATION + REPORT + OPEN + CLOSE + COMMA + BORDER + OTHER
_CLASS = {w: c for c, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
_MARKS = {",": COMMA, ":": BORDER, ";": BORDER}
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[\"“”„«»‘’',:;]")
_SENTENCE_END = re.compile(r"[.!?\n\r]+")
_CLAUSE_END = re.compile(r"[.!?;:,\n\r]+")
_QUOTE = re.compile(r"[\"“”„«»‘’']|\n[^\S\n]*\n")
READINGS = ("plain", "aimed", "reported", "negated")
FEATURES = tuple((kind, reading) for kind in (INSULT, THREAT) for reading in READINGS)


@dataclass(frozen=True)
class Transducer:
    """arcs[state, symbol] is (next state, output); the start state is 0."""

    arcs: dict

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols; outputs are joined. Only reachable states are built."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            pair = todo.pop()
            for symbol in ALPHABET:
                (a, x), (b, y) = self.arcs[pair[0], symbol], other.arcs[pair[1], symbol]
                if (a, b) not in number:
                    number[a, b] = len(number)
                    todo.append((a, b))
                arcs[number[pair], symbol] = (number[a, b], x | y)
        return Transducer(arcs)

    def outputs(self, symbols: str) -> list[frozenset]:
        state, out = 0, []
        for symbol in symbols:
            state, emitted = self.arcs[state, symbol]
            out.append(emitted)
        return out


def _emitting(symbol: str) -> Transducer:
    return Transducer({(0, s): (0, frozenset(s if s == symbol else "")) for s in ALPHABET})


def _reaching(opener: str, reach: int, says: str) -> Transducer:
    """After its opener, insults and threats within `reach` words of the clause are marked.

    A comma right behind a negation sets words off: they neither count nor are marked, and after the next comma the
    negation goes on.
    """
    arcs, aside = {}, reach + 1
    for state in range(reach + 1):
        for s in ALPHABET:
            mark = frozenset([says]) if state and s in (INSULT, THREAT) else frozenset()
            after = reach if s == opener else 0 if s in (COMMA, BORDER) else max(state - 1, 0)
            arcs[state, s] = (aside if (s, state, opener) == (COMMA, reach, NEGATION) else after, mark)
    for s in ALPHABET:
        arcs[aside, s] = (reach if s == COMMA else 0 if s == BORDER else aside, frozenset())
    return Transducer(arcs)


def _quoting() -> Transducer:
    """After a verb of reporting, or between quotes, insults and threats are reported."""
    arcs = {}
    for state in range(4):  # bit 0: reported, bit 1: quoted
        for s in ALPHABET:
            mark = frozenset(["reported"]) if state and s in (INSULT, THREAT) else frozenset()
            arcs[state, s] = (state | 1 if s == REPORT else state | 2 if s == OPEN else state & 1 if s == CLOSE else state, mark)
    return Transducer(arcs)


_TRIGGERS = _emitting(INSULT).compose(_emitting(THREAT))
_SPEECH = _reaching(NEGATION, 3, "negated").compose(_quoting())
FORWARD = _TRIGGERS.compose(_SPEECH).compose(_reaching(TARGET, 4, "aimed"))
BACKWARD = _reaching(TARGET, 3, "aimed")


def quoted(text: str) -> list[tuple[int, int]]:
    """Places of opening and closing marks, outermost pairs in order; a mark without its other in the paragraph is none."""
    pairs: list[tuple[int, int]] = []
    begun: dict[str, tuple[int, str]] = {}
    for m in _QUOTE.finditer(text):
        mark, at = m[0], m.start()
        if len(mark) > 1:
            begun.clear()
            continue
        kind = '"' if mark == '"' else "'" if mark == "'" else "“" if mark in "“”„" else "«" if mark in "«»" else "‘"
        before, after = text[at - 1 : at] if at else "", text[at + 1 : at + 2]
        was = begun.get(kind)
        apart = not before.isalnum()  # as an opening mark stands; apostrophes and marks of inches don't
        if kind == '"':
            closes, opens = was is not None, apart
        elif kind == "'":
            closes, opens = was is not None and not after.isalnum() and not before.isspace(), apart and after.isalnum()
        elif kind == "“":
            closes = was is not None and (mark == "”" or (mark, was[1]) == ("“", "„"))
            opens = mark != "”"
        elif kind == "«":
            closes, opens = was is not None and was[1] != mark, True
        else:
            closes, opens = was is not None and mark == "’" and not after.isalnum(), mark == "‘"
        if closes:
            pairs.append((begun.pop(kind)[0], at))
        elif opens:
            begun[kind] = (at, mark)
    outer: list[tuple[int, int]] = []
    for pair in sorted(pairs):
        if not outer or pair[0] > outer[-1][1]:
            outer.append(pair)
    return outer


class Sentences:
    """The sentences of a lower-case text as symbols."""

    def __init__(self, text: str) -> None:
        self.text, self.pairs = text, quoted(text)
        self.opened = [a for a, _ in self.pairs]
        self.quotes = {a: OPEN for a in self.opened} | {b: CLOSE for _, b in self.pairs}
        ends = [(m.start(), m.end()) for m in _SENTENCE_END.finditer(text)]
        self.starts, self.stops = [0] + [b for _, b in ends], [a for a, _ in ends] + [len(text)]

    def at(self, place: int) -> int:
        return bisect.bisect_right(self.starts, place) - 1

    def symbols(self, k: int) -> Iterator[tuple[int, str, str]]:
        """(place, token, symbol); the first one says whether the sentence begins inside a quote."""
        start = self.starts[k]
        pair = bisect.bisect_left(self.opened, start) - 1
        yield -1, "", OPEN if pair >= 0 and start <= self.pairs[pair][1] else BORDER
        for m in _TOKEN.finditer(self.text, start, self.stops[k]):
            place, token = m.start(), m[0]
            if token[0].isalnum():
                token = token.replace("’", "'")
                yield place, token, _CLASS.get(token, OTHER)
            elif token in _MARKS:
                yield place, token, _MARKS[token]
            elif place in self.quotes:
                yield place, token, self.quotes[place]


class Grammar:
    """The lexicon as an automaton over characters, and the clause machines."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.words, self.stems = words, stems
        self.lexicon = ahocorasick.Automaton()
        for term, whole, weight in [(w, True, x) for w, x in words.items()] + [(s, False, x) for s, x in stems.items()]:
            self.lexicon.add_word(term, (term, whole, weight))
        if len(self.lexicon):
            self.lexicon.make_automaton()

    def hits(self, text: str) -> dict[int, tuple[int, float]]:
        """start -> (least end, weight) of the insults and threats in a lower-case text."""
        found: dict[int, tuple[int, float]] = {}
        if not len(self.lexicon):
            return found
        for last, (term, whole, weight) in self.lexicon.iter(text):
            start = last + 1 - len(term)
            if (start and text[start - 1].isalnum()) or (whole and text[last + 1 : last + 2].isalnum()):
                continue
            if start not in found or weight > found[start][1]:
                found[start] = (last + 1, weight)
        return found

    def clauses(self, text: str) -> list[tuple[int, int, str, str, float]]:
        """(start, end, kind, reading, weight) of every clause that holds an insult or a threat."""
        text = text.lower()
        hits = self.hits(text)
        if not hits:
            return []
        ends = [(m.start(), m.end()) for m in _CLAUSE_END.finditer(text)]
        starts, stops = [0] + [b for _, b in ends], [a for a, _ in ends] + [len(text)]
        sentences, by_clause = Sentences(text), defaultdict(lambda: (set(), set(), []))
        for k in sorted({sentences.at(place) for place in hits}):
            tokens = list(sentences.symbols(k))
            symbols = "".join((THREAT if token in THREATS else INSULT) if place in hits else s for place, token, s in tokens)
            after = BACKWARD.outputs(symbols[::-1])[::-1]
            for (place, *_), emitted, behind in zip(tokens, FORWARD.outputs(symbols), after):
                if emitted & {INSULT, THREAT}:
                    marks = emitted | behind
                    kinds, readings, weights = by_clause[bisect.bisect_right(starts, place) - 1]
                    kinds |= marks & {INSULT, THREAT}
                    readings.add(next((r for r in ("negated", "reported", "aimed") if r in marks), "plain"))
                    weights.append(hits[place][1])
        out = []
        for k, (kinds, readings, weights) in sorted(by_clause.items()):
            reading = next(r for r in ("aimed", "plain", "reported", "negated") if r in readings)
            out.append((starts[k], stops[k], THREAT if THREAT in kinds else INSULT, reading, sum(weights)))
        return out

    def features(self, text: str) -> list[float]:
        return _sums(self.clauses(text))


#: Used without labels: the weight of each feature, and the bias.
PRIOR = np.array([2.0, 3.0, 0.5, 0.3, 2.0, 3.0, 0.5, 0.3]), -1.5


@dataclass(frozen=True)
class ToxicityModel:
    """Its size is bounded by the labelled sample, so it is broadcast."""

    words: dict
    stems: dict
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(features @ self.weights + self.bias)))


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, drawn towards PRIOR where the data say little."""
    z = np.column_stack([x, np.ones(len(x))])
    prior = np.append(*PRIOR)
    w, pull = prior.copy(), np.diag([ridge] * x.shape[1] + [ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + pull @ (w - prior)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pull + 1e-9 * np.eye(len(w)), slope)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 5 is 0; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def sample_of_labels(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of at most max_rows labelled documents that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("l"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("l").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("l")))
    known = known.groupBy("l").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("l"), "l").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), F.col("doc_id") == F.col("l")).select("text", "toxic")  # max_rows rows at most


def plain_uses(text: str) -> tuple[list[str], dict[str, int]]:
    """The words of a text, and each word's first place where an insult would be neither negated nor reported nor quoted."""
    sentences, words, own = Sentences(text.lower()), [], {}
    for k in range(len(sentences.starts)):
        state = 0
        for _, token, symbol in sentences.symbols(k):
            if symbol in (OTHER, THREAT) and not _SPEECH.arcs[state, INSULT][1]:
                own.setdefault(token, len(words))
            if token and token[0].isalnum():
                words.append(token)
            state = _SPEECH.arcs[state, symbol][0]
    return words, own


def learn_lexicon(sample: DataFrame, least_evidence: float = 10.0, least_docs: int = 4, least_share: float = 0.75) -> tuple[dict, dict]:
    """Words and stems with their log-odds weights, from (text, toxic)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list] = defaultdict(lambda: [0, 0, set()])
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, own = plain_uses(text)
                for word, at in own.items():
                    entry = totals[word]
                    entry[0 if toxic else 1] += 1
                    if toxic:
                        around = "\n".join([*words[max(0, at - 4) : at], "", *words[at + 1 : at + 5]])
                        entry[2].add(int.from_bytes(hashlib.blake2b(around.encode(), digest_size=8).digest(), "little", signed=True))
        rows = [(w, p, n, list(c)) for w, (p, n, c) in totals.items()]
        for at in range(0, len(rows), 20_000):
            part = list(zip(*rows[at : at + 20_000]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64()),
                                              pa.array(part[3], pa.list_(pa.int64()))], names=["word", "toxic", "clean", "around"])

    base = sample.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    toxic, clean = base.toxic or 0, base.n - (base.toxic or 0)
    if not toxic or not clean:
        return {}, {}
    words = sample.mapInArrow(count, "word string, toxic long, clean long, around array<long>").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"),
        F.size(F.array_distinct(F.flatten(F.collect_list("around")))).alias("places"))
    words = staged(words, "label-words")
    rate = math.log((toxic + clean) / toxic)
    # Evidence: how unlikely so many toxic documents are by chance, in natural logarithms.
    seen = F.least("toxic", "places")
    share = (F.col("toxic") + 0.0) / (F.col("toxic") + F.col("clean"))
    evident = (seen * (F.log(share) + rate) >= least_evidence) & (seen >= least_docs) & (share >= least_share)
    stems = words.select("word", F.explode(F.transform(F.sequence(F.lit(4), F.lit(8)), lambda n: F.struct(
        n.alias("n"), F.substring("word", 1, n).alias("stem")))).alias("s"), "toxic", "clean", "places").where(
        F.length("word") > F.col("s.n"))
    stems = stems.groupBy(F.col("s.stem").alias("stem")).agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum("places").alias("places"),
        F.count(F.when(F.col("toxic") > 0, 1)).alias("words")).where(evident & (F.col("words") >= 3))
    # Both lists are bounded by the sample: each entry needs documents of its own.
    weight = lambda r: min(6.0, math.log((r.toxic + 0.5) / (toxic + 1)) - math.log((r.clean + 0.5) / (clean + 1)))
    good_stems = {r.stem: weight(r) for r in stems.collect()}
    shortest = {s: w for s, w in good_stems.items() if not any(s[:n] in good_stems for n in range(4, len(s)))}
    good_words = {r.word: weight(r) for r in words.where(evident).collect()}
    alone = {w: x for w, x in good_words.items() if not any(w[:n] in shortest for n in range(4, len(w) + 1))}
    return alone, shortest


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> ToxicityModel:
    sample = staged(sample_of_labels(docs, labels, max_rows), "labelled")
    words, stems = learn_lexicon(sample)
    words = {w: 3.0 for w in (*INSULTS, *THREATS)} | words
    grammar_of = (words, stems)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(*grammar_of)
        for batch in batches:
            rows = [grammar.features(text) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = sample.mapInArrow(read, "x array<double>, y int").collect()  # max_rows rows at most
    y = np.array([r.y for r in rows], float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(words, stems, *PRIOR)
    return ToxicityModel(words, stems, *fit_weights(np.array([r.x for r in rows]), y))


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted, clauses (start, stop, kind, reading, weight) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.stems, model.weights, model.bias))
    clause = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("reading", pa.string()),
                        ("weight", pa.float64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(*shared.value)
        grammar = Grammar(model.words, model.stems)
        for batch in batches:
            found = [grammar.clauses(text or "") for text in batch.column(1).to_pylist()]
            scores = model.score(np.array([_sums(c) for c in found]).reshape(len(found), len(FEATURES)))
            names = ("start", "stop", "kind", "reading", "weight")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)),
                 pa.array([[dict(zip(names, c)) for c in own] for own in found], pa.list_(clause))],
                names=["doc_id", "score", "predicted", "clauses"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(read, "doc_id long, score double, predicted int, clauses "
                                 "array<struct<start:long,stop:long,kind:string,reading:string,weight:double>>")


def _sums(clauses: list) -> list[float]:
    sums = dict.fromkeys(FEATURES, 0.0)
    for _, _, kind, reading, weight in clauses:
        sums[kind, reading] += math.log1p(weight)
    return [math.log1p(v) for v in sums.values()]


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.stems, model.weights, model.bias))
    at = docs.columns.index("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(*shared.value)
        grammar = Grammar(model.words, model.stems)
        for batch in batches:
            x = np.array([grammar.features(text or "") for text in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) < 0.5))

    return docs.mapInArrow(read, docs.schema)
