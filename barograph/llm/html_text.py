"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks, the texts between block-level tags, each with its path of open tags, classes and ids. A
bidirectional LSTM in numpy reads the page's blocks in order, each as hashed path elements, hashed words and a few
figures, and says of every block, in the light of the whole page, whether it belongs to the article.

There are no labelled pages, so the labeller is trained on layouts made up from the vocabulary of page building (FRAMES
and MARKS below), filled with block texts of at most `sample_pages` of the pages (those with the least hashed ids): what
stands in a content slot is article, what stands in another slot is not. All pages are labelled, from the whole html.

Defined results: null html counts as empty and gives an empty text; scripts, styles, comments and other markup are no
text; unclosed tags end with their parent; without any page the labeller is trained on made-up words; repeated rows are
each extracted; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barograph.llm.words import mixed, word_hashes

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option "
    "p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: No text of the page.
RAW_TAGS = frozenset("script style noscript template textarea iframe svg math object head title".split())
#: An opening tag of the left ends these if they are open above the nearest of the tags that hold them.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
          "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the words of its class, id and role."""
    if "=" not in attributes:
        return (tag,)
    found = [tag]
    for m in _ATTRIBUTE.finditer(attributes):
        found += ["." + p.lower() for p in _NAME_PART.findall(m[2] or m[3] or m[4] or "")]
    return tuple(found)


def blocks(page: str) -> list[tuple[tuple, str, float]]:
    """(path, text, share of linked characters) of every block that has text, in page order."""
    out: list[tuple[tuple, str, float]] = []
    stack: list[tuple[str, tuple]] = []
    pieces: list[str] = []
    linked, links, path = 0, 0, ()

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append((path, text, min(1.0, linked / len(text))))
        pieces.clear()
        linked = 0

    def drop(k: int) -> None:
        nonlocal links
        links -= sum(name == "a" for name, _ in stack[k:])
        del stack[k:]

    at, raw = 0, None
    for m in _MARKUP.finditer(page):
        if m.start() < at:
            continue
        text = page[at : m.start()]
        at = m.end()
        if text and raw is None:
            if not pieces:
                path = tuple(marks for name, marks in stack)
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            linked += len(text) if links else 0
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if raw is not None:
            if m[1] and tag == raw:
                raw = None
            continue
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if tag in BLOCK_TAGS:
                close()
            if k is not None:
                drop(k)
            continue
        if tag == "br":
            pieces.append(" ") if pieces else None
            continue
        if tag in RAW_TAGS:
            if tag in BLOCK_TAGS:
                close()
            # Only its own end tag is looked for: what stands inside is no markup.
            if tag != "head" and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK_TAGS:
            close()
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[k][0] == "p":
                    drop(k)
                    break
                if stack[k][0] in BLOCK_TAGS:
                    break
        if tag in CLOSES:
            ends, holders = CLOSES[tag]
            first = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in holders:
                    break
                if stack[k][0] in ends:
                    first = k
            if first is not None:
                drop(first)
        if tag not in VOID_TAGS and not m[3].endswith("/"):
            links += tag == "a"
            stack.append((tag, _marks(tag, m[3])))
    rest = page[at:]
    if rest:
        if not pieces:
            path = tuple(marks for name, marks in stack)
        pieces.append(html.unescape(rest))
    close()
    return out


PATH_SIZE, WORD_SIZE, FIGURES, INNER, HIDDEN = 512, 16, 6, 16, 16


def _place(mark: str) -> int:
    value = np.frombuffer(mark.encode().ljust(8, b"\0")[:8], np.uint64).copy()
    for k in range(8, len(mark.encode()), 8):
        value = mixed(value) ^ np.frombuffer(mark.encode()[k : k + 8].ljust(8, b"\0"), np.uint64)
    return int(mixed(value)[0] % PATH_SIZE)


def page_features(pages: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct paths as hashed counts; the path of every block; words and figures of every block."""
    numbers: dict[tuple, int] = {}
    rows, of_path = [], []
    flat = [b for page in pages for b in page]
    for path, _, _ in flat:
        if path not in numbers:
            numbers[path] = len(numbers)
            row = np.zeros(PATH_SIZE, np.float32)
            for marks in path:
                for mark in marks:
                    row[_place(mark)] = 1
            if path:  # the innermost tag counts again
                row[_place("last:" + path[-1][0])] = 1
            rows.append(row)
        of_path.append(numbers[path])
    texts = [t.encode() for _, t, _ in flat]
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    hashes, first = word_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets)
    n = np.diff(first)
    block = np.repeat(np.arange(len(flat)), n)
    bag = np.bincount(block * WORD_SIZE + (hashes % np.uint64(WORD_SIZE)).astype(np.int64),
                      minlength=len(flat) * WORD_SIZE).reshape(-1, WORD_SIZE) / np.maximum(n, 1)[:, None]
    where = np.concatenate([np.linspace(0, 1, len(p)) if len(p) > 1 else np.zeros(len(p)) for p in pages] or [np.zeros(0)])
    links = np.array([share for *_, share in flat])
    figures = np.column_stack([np.log1p(n) / 5, np.log1p(sizes) / 8, links, where, 1 - where, np.ones(len(flat))])
    return (np.array(rows, np.float32).reshape(-1, PATH_SIZE), np.array(of_path, np.int64),
            np.column_stack([bag, figures]).astype(np.float32).reshape(-1, WORD_SIZE + FIGURES))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Input layer, one LSTM for each direction, output layer."""

    parts: dict

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Labeller:
        normal = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        parts = {"path": normal(PATH_SIZE, INNER) * 8, "rest": normal(WORD_SIZE + FIGURES, INNER), "out": normal(2 * HIDDEN + INNER, 1),
                 "bias": np.zeros(1, np.float32)}
        for way in ("there", "back"):
            parts |= {f"{way}.x": normal(INNER, 4 * HIDDEN), f"{way}.h": normal(HIDDEN, 4 * HIDDEN),
                      f"{way}.b": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}
        return cls(parts)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """x: time, page, INNER. States stay as they are where a page has no block."""
        w, u, b = (self.parts[f"{way}.{k}"] for k in "xhb")
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        outputs, kept = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        steps = range(len(x)) if way == "there" else range(len(x) - 1, -1, -1)
        for t in steps:
            gates = x[t] @ w + h @ u + b
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            kept.append((t, h, c, i, f, o, g, new, m))
            h, c = m * (o * np.tanh(new)) + (1 - m) * h, m * new + (1 - m) * c
            outputs[t] = h
        return outputs, kept

    def forward(self, inner: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        there, a = self._run("there", inner, mask)
        back, b = self._run("back", inner, mask)
        joined = np.concatenate([there, back, inner], axis=2)
        return joined @ self.parts["out"][:, 0] + self.parts["bias"], (joined, a, b)

    def inner(self, paths: np.ndarray, of_path: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return np.tanh((paths @ self.parts["path"])[of_path] + rest @ self.parts["rest"])

    def gradients(self, paths: np.ndarray, rest: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[dict, float]:
        """Cross-entropy over the blocks and its slopes; paths and rest: time, page, values."""
        inner = np.tanh(paths @ self.parts["path"] + rest @ self.parts["rest"])
        logits, (joined, a, b) = self.forward(inner, mask)
        p = _sigmoid(logits)
        n = mask.sum()
        d = (p - label) * mask / n
        slopes = {"out": np.einsum("tnk,tn->k", joined, d)[:, None], "bias": np.array([d.sum()])}
        d_joined = d[:, :, None] * self.parts["out"][:, 0]
        d_inner = d_joined[:, :, 2 * HIDDEN :].copy()
        for way, kept, d_out in (("there", a, d_joined[:, :, :HIDDEN]), ("back", b, d_joined[:, :, HIDDEN : 2 * HIDDEN])):
            w, u = self.parts[f"{way}.x"], self.parts[f"{way}.h"]
            d_w, d_u, d_b = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, np.float32)
            d_h = d_c = np.zeros((inner.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, new, m in reversed(kept):
                d_h = d_h + d_out[t]
                bent = np.tanh(new)
                d_new = m * (d_c + d_h * o * (1 - bent ** 2))
                d_gates = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f),
                                          m * d_h * bent * o * (1 - o), d_new * i * (1 - g ** 2)], axis=1)
                d_w += inner[t].T @ d_gates
                d_u += h.T @ d_gates
                d_b += d_gates.sum(axis=0)
                d_inner[t] += d_gates @ w.T
                d_h, d_c = d_gates @ u.T + (1 - m) * d_h, d_new * f + (1 - m) * d_c
            slopes |= {f"{way}.x": d_w, f"{way}.h": d_u, f"{way}.b": d_b}
        d_pre = d_inner * (1 - inner ** 2)
        slopes["path"] = paths.reshape(-1, PATH_SIZE).T @ d_pre.reshape(-1, INNER)
        slopes["rest"] = rest.reshape(-1, rest.shape[2]).T @ d_pre.reshape(-1, INNER)
        loss = -(mask * (label * np.log(p + 1e-7) + (1 - label) * np.log(1 - p + 1e-7))).sum() / n
        return slopes, float(loss)

    def label(self, pages: list[list[tuple]], together: int = 256) -> list[list[bool]]:
        """For each block of each page whether it is article text. Pages of like length are read together."""
        paths, of_path, rest = page_features(pages)
        if not len(of_path):
            return [[] for _ in pages]
        inner = self.inner(paths, of_path, rest)
        sizes = np.array([len(p) for p in pages])
        first = np.concatenate([[0], np.cumsum(sizes)])
        marks, order, at = np.zeros(len(of_path), bool), np.argsort(sizes, kind="stable"), 0
        while at < len(order):
            own = order[at : at + together]
            own = own[: max(1, 200_000 // max(1, int(sizes[own].max())))]
            at += len(own)
            if not sizes[own[-1]]:
                continue
            x, mask = np.zeros((sizes[own].max(), len(own), INNER), np.float32), np.zeros((sizes[own].max(), len(own)), np.float32)
            for k, page in enumerate(own):
                x[: sizes[page], k], mask[: sizes[page], k] = inner[first[page] : first[page + 1]], 1
            logits, _ = self.forward(x, mask)
            for k, page in enumerate(own):
                marks[first[page] : first[page + 1]] = logits[: sizes[page], k] >= 0
        return [marks[a:b].tolist() for a, b in zip(first[:-1], first[1:])]


# Names that page builders use, by slot. A name is a tag with classes or ids.
CONTENT = ("article main section div.content div#content div.post div.entry-content div.article-body div.story "
           "div#main-content div.post-content section.article div.text article.post main#main div.body-copy").split()
MARKS = {
    "menu": "nav ul.menu div.navbar div.nav div#nav nav.breadcrumb div.breadcrumbs div.toolbar ul.tabs div#menu div.pagination".split(),
    "header": "header div#header div.header div.masthead div.site-header header.top div.topbar div.branding".split(),
    "footer": "footer div#footer div.footer div.copyright footer.site-footer div.legal div.bottom".split(),
    "sidebar": "aside div.sidebar div#sidebar aside.sidebar div.widget div.related div.recommended div#secondary div.rail".split(),
    "notice": ("div.notice div.cookie-notice div.cookie-banner div.consent div.alert div.popup div.modal div.newsletter "
               "div.subscribe div.gdpr div#cookies section.notice p.notice div.paywall").split(),
    "advert": ("div.ad div.ads div.advert div.advertisement div.sponsored div.promo aside.ad div.banner div#ad div.ad-slot "
               "section.ad p.ad ins.adsbygoogle div.promotion").split(),
    "form": "form form.search form.login form.contact div.search-form form#subscribe fieldset".split(),
    "comments": ("div.comments div#comments section.comments ol.comment-list div.comment div.replies ul.comments "
                 "div#disqus div.reader-comments section#comments div.discussion div.responses").split(),
    "share": "div.share div.social ul.social-links div.tags div.meta div.byline div.author-box".split(),
}


def _open(name: str) -> tuple[str, str]:
    tag, sign, rest = re.match(r"(\w+)([.#]?)(.*)", name).groups()
    return f'<{tag}{f" {dict(zip(".#", ("class", "id")))[sign]}=\"{rest}\"" if sign else ""}>', f"</{tag}>"


def made_up_page(rng: np.random.Generator, texts: list[str]) -> list[tuple[tuple, str, float, int]]:
    """Blocks of a made-up layout with labels: 1 in content slots."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    text = lambda: html.escape(pick(texts))
    few = lambda: html.escape(" ".join(pick(texts).split()[: int(rng.integers(1, 6))]) or "x")
    yes = lambda p: rng.random() < p
    sign = {0: "", 1: ""}  # the label travels in the text, and is taken out again

    def boiler(slot: str) -> str:
        opened, closed = _open(pick(MARKS[slot]))
        s = sign[0]
        if slot in ("menu", "share") or (slot in ("header", "sidebar", "footer") and yes(0.4)):
            items = "".join(f"<li><a href=\"/x\">{s}{few()}</a></li>" for _ in range(rng.integers(2, 9)))
            inner = f"<ul>{items}</ul>" if not opened.startswith(("<ul", "<ol")) else items
        elif slot == "form":
            inner = "".join(f"<label>{s}{few()}</label><input name=q>" for _ in range(rng.integers(1, 4))) + f"<p>{s}{few()}</p><button>{s}{few()}</button>"
        elif slot == "comments":
            inner = f"<h3>{s}{few()}</h3>" + "".join(
                pick([f"<p>{s}{text()}</p>", f"<div class=\"comment\"><p>{s}{text()}</p></div>", f"<li><b>{s}{few()}</b> {text()}</li>"])
                for _ in range(rng.integers(1, 6)))
        else:
            some = lambda: pick([text, few])()
            inner = "".join(pick(["<p>{}</p>", "{}", "<h4>{}</h4>", "<div>{}</div>", "<p>{}</p>"]).format(s + some())
                            for _ in range(rng.integers(1, 4)))
            inner = s + some() if yes(0.5) else inner
        return opened + inner + closed

    def paragraph() -> str:
        s, kind = sign[1], rng.random()
        if kind < 0.62:
            ended = yes(0.8)
            return f"<p>{'<b>' if yes(0.2) else ''}{s}{text() if yes(0.85) else few()}{'</p>' if ended else '<br>'}"
        if kind < 0.74:
            return f"<h{rng.integers(2, 4)}>{s}{few()}</h2>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{s}{pick([text, few])()}</li>" for _ in range(rng.integers(1, 6))) + "</ul>"
        if kind < 0.89:
            return f"<blockquote>{s}{text()}</blockquote>"
        if kind < 0.93:
            return "<table>" + "".join(f"<tr><td>{s}{few()}</td><td>{s}{few()}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>"
        return pick([f"<div>{s}{text()}</div>", f"<pre>{s}{text()}</pre>", f"<p>{s}{few()} <a href='/y'>{few()}</a> {text()}</p>"])

    body = []
    for _ in range(int(rng.integers(1, 9))):
        body.append(paragraph())
        if yes(0.12):
            body.append(boiler(pick(["advert", "share", "notice", "sidebar", "form", "menu"])))
    head = f"<h1>{sign[1]}{few() if yes(0.7) else text()}</h1>" if yes(0.8) else ""
    opened, closed = _open(pick(CONTENT)) if yes(0.92) else ("", "")
    if yes(0.25):
        more, end = _open(pick(CONTENT))
        opened, closed = opened + more, end + closed
    inside = boiler("comments") if yes(0.12) else ""
    article = opened + head + "".join(body) + inside + closed
    before = "".join(boiler(s) for s, p in (("notice", 0.3), ("header", 0.4), ("menu", 0.7), ("advert", 0.5), ("form", 0.15),
                                            ("sidebar", 0.2)) if yes(p))
    after = "".join(boiler(s) for s, p in (("share", 0.2), ("comments", 0.35), ("sidebar", 0.35), ("advert", 0.3), ("form", 0.2),
                                           ("notice", 0.15), ("footer", 0.75)) if yes(p))
    page = f"<html><body>{before}{article}{after}</body></html>"
    if yes(0.2):
        wrapper, end = _open(pick(["div.wrapper", "div#page", "div.container", "div.site"]))
        page = f"<html><body>{wrapper}{before}{article}{after}{end}</body></html>"
    labelled = []
    for path, text_, share in blocks(page):
        label = int(sign[1] in text_)
        clean = text_.replace(sign[0], "").replace(sign[1], "").strip()
        if clean:
            labelled.append((path, clean, share, label))
    return labelled


def train(texts: list[str], pages: int = 900, rounds: int = 14, seed: int = 2) -> Labeller:
    """Fit the labeller to made-up pages that are filled with the given block texts."""
    rng = np.random.default_rng(seed)
    texts = [t for t in texts if t] or [" ".join(f"word{rng.integers(999)}" for _ in range(k + 1)) for k in range(60)]
    made = sorted((p for p in (made_up_page(rng, texts) for _ in range(pages)) if p), key=len)
    labeller = Labeller.fresh(rng)
    groups = []
    for at in range(0, len(made), 30):
        own = made[at : at + 30]
        longest = max(len(p) for p in own)
        paths, of_path, rest = page_features([[b[:3] for b in p] for p in own])
        x, r = np.zeros((longest, len(own), PATH_SIZE), np.float32), np.zeros((longest, len(own), WORD_SIZE + FIGURES), np.float32)
        mask, y = np.zeros((longest, len(own)), np.float32), np.zeros((longest, len(own)), np.float32)
        first = 0
        for k, p in enumerate(own):
            x[: len(p), k], r[: len(p), k] = paths[of_path[first : first + len(p)]], rest[first : first + len(p)]
            mask[: len(p), k], y[: len(p), k] = 1, [b[3] for b in p]
            first += len(p)
        groups.append((x, r, mask, y))
    mean, square, step = {}, {}, 0
    for _ in range(rounds):
        for g in rng.permutation(len(groups)):
            slopes, _ = labeller.gradients(*groups[g])
            step += 1
            for name, slope in slopes.items():
                mean[name] = 0.9 * mean.get(name, 0) + 0.1 * slope
                square[name] = 0.99 * square.get(name, 0) + 0.01 * slope ** 2
                rate = 0.02 * (1 - 0.9 * step / (rounds * len(groups)))
                labeller.parts[name] = (labeller.parts[name] - rate * (mean[name] / (1 - 0.9 ** step)) / (
                    np.sqrt(square[name] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return labeller


def fit(pages: DataFrame, sample_pages: int = 200) -> Labeller:
    """Train on layouts filled with the texts of at most sample_pages pages."""
    ids = pages.select("page_id").where(F.col("page_id").isNotNull()).distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    rows = pages.join(F.broadcast(ids), "page_id", "left_semi").select("page_id", "html").dropDuplicates(["page_id"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts = [t for _, t, _ in blocks(page or "")]
                yield pa.RecordBatch.from_arrays([pa.array([page_id]), pa.array([texts], pa.list_(pa.string()))], names=["page_id", "texts"])

    found = rows.mapInArrow(cut, "page_id long, texts array<string>").orderBy("page_id").collect()  # sample_pages rows at most
    return train([t for r in found for t in r.texts])


def main_text(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller.parts)  # of fixed size

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                cut = [blocks(page or "") for page in part.column(2).to_pylist()]
                marks = labeller.label(cut)
                texts = [" ".join(t for (_, t, _), keep in zip(p, own) if keep) for p, own in zip(cut, marks)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([len(p) for p in cut], pa.int64()), pa.array([sum(own) for own in marks], pa.int64())],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return pages.select("page_id", "url", "html").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")
