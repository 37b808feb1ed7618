"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes its leaf blocks in page order. Features of a block come from its ancestor tags, the
words in their class, id and role, and its text; transitions tie neighbours together. The field is
trained on labelled pages by maximum likelihood, and Viterbi finds the best labels of a whole page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import byte_length, hash60, rows_of, text_of

TRAIN_PAGES = 400               # labelled pages of the table that the field is fitted on, at most
TRAIN_BYTES = 1 << 16           # size of such a page, at most
TRAIN_BLOCKS, TRAIN_LONGEST = 100_000, 1_000    # leaf blocks of all these pages (give or take one page), and of one
MADE_PAGES = 500                # made-up labelled pages with parts that a table may lack
STEPS, RATE, PENALTY = 250, 0.1, 1e-4
OTHER, MAIN = 0, 1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template textarea select button svg iframe object title".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section
    summary table tbody td tfoot th thead tr ul""".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
          "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = BLOCK - {"body", "html"}
BARRIER = frozenset("article aside body div footer form header main nav section table td th ul ol".split())
LANDMARKS = ("article", "main", "nav", "header", "footer", "aside", "form", "dialog")
ROLES = {                       # what words in class, id and role say about an element
    "ad": r"ad|ads|adv|advert\w*|sponsor\w*|promo\w*|banner|commercial",
    "comment": r"comment\w*|repl(?:y|ies)|disqus|discussion|respond|responses|feedback",
    "nav": r"nav\w*|menu\w*|breadcrumb\w*|pag(?:er|ination)|toc|skip",
    "footer": r"foot\w*|copyright|colophon|legal", "header": r"header|masthead|topbar|site|logo|branding",
    "side": r"side\w*|widget\w*|related|recommend\w*|more|trending|popular|tags?",
    "notice": r"cookie\w*|consent|notice|gdpr|alert|popup|modal|overlay|privacy|warning|message|paywall",
    "form": r"form|search|login|signup|subscri\w*|newsletter|contact",
    "share": r"share\w*|social|follow|meta|byline|author|date",
    "content": r"content|article\w*|post|entry|story|main|text|prose"}
_ROLES = {name: re.compile(rf"(?:{p})\Z") for name, p in ROLES.items()}
_ROLE_OF: dict[str, tuple[str, ...]] = {}
_NAME = re.compile(r"[A-Za-z]+")


@dataclass
class LeafBlock:
    tags: list[str]
    roles: list[tuple[str, ...]]
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class _Blocks(HTMLParser):
    """Collects leaf blocks; copes with tags that are never closed or closed out of order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.found: list[LeafBlock] = []
        self.open: LeafBlock | None = None
        self.silent = 0

    def _end(self):
        self.open = None

    def _pop(self, count: int):
        for _ in range(count):
            tag, _ = self.stack.pop()
            self.silent -= tag in SILENT
            if tag in BLOCK:
                self._end()

    def handle_starttag(self, tag, attrs):
        if tag == "br" and self.open:
            self.open.parts.append(" ")
        if tag in BLOCK:
            self._end()
        for closed in CLOSES.get(tag, ()) + (("p",) if tag in ENDS_P else ()):
            for depth, (name, _) in enumerate(reversed(self.stack), 1):
                if name == closed:
                    self._pop(depth)
                    break
                if name in BARRIER:
                    break
        if tag == "body":                               # whatever the head left open
            self._pop(sum(1 for t, _ in self.stack if t == "head") and len(self.stack) - 1)
        if tag not in VOID:
            self.stack.append((tag, _roles_of(attrs)))
            self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._end()
        for depth, (name, _) in enumerate(reversed(self.stack), 1):
            if name == tag:
                self._pop(depth)
                return

    def handle_data(self, data):
        if self.silent or not data:
            return
        if self.open is None:
            if data.isspace():
                return
            self.open = LeafBlock([t for t, _ in self.stack], [r for _, r in self.stack])
            self.found.append(self.open)
        self.open.parts.append(data)
        if any(t == "a" for t, _ in self.stack):
            self.open.linked += len(data)


def _roles_of(attrs) -> tuple[str, ...]:
    if not attrs:
        return ()
    found: list[str] = []
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for word in _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value)):
                word = word.lower()
                if word not in _ROLE_OF:
                    if len(_ROLE_OF) > 50_000:
                        _ROLE_OF.clear()
                    _ROLE_OF[word] = tuple(r for r, p in _ROLES.items() if p.match(word))
                found += _ROLE_OF[word]
        elif name in ("hidden", "aria-hidden") and value != "false":
            found.append("hidden")
    return tuple(dict.fromkeys(found))


def leaf_blocks(html: str | None) -> list[LeafBlock]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    return [b for b in parser.found if b.text]


def features(block: LeafBlock, place: int, count: int) -> list[str]:
    text, tags = block.text, block.tags
    inner = next((t for t in reversed(tags) if t in LANDMARKS), "none")
    start = max((k for k, t in enumerate(tags) if t in ("article", "main")), default=-1)
    above = {r for roles in block.roles[:start + 1] for r in roles}
    below = {r for roles in block.roles[start + 1:] for r in roles}
    parent = next((t for t in reversed(tags) if t in BLOCK), "none")
    words = text.count(" ") + 1
    linked = block.linked / max(len("".join(block.parts)), 1)
    return ["bias", f"inner:{inner}", f"parent:{parent}", f"size:{min(words.bit_length(), 7)}",
            f"linked:{0 if linked == 0 else 1 if linked < 0.5 else 2}",
            f"landmark:{'article' in tags or 'main' in tags}", f"end:{text[-1] in '.!?:;'}",
            f"sign:{any(c in text for c in '©®™|»')}", f"first:{place == 0}", f"last:{place == count - 1}",
            *(f"in:{t}" for t in LANDMARKS if t in tags),
            *(f"role:{r}" for r in above | below), *(f"below:{r}" for r in below if start >= 0)]


@dataclass
class Field:
    """Weights of the features per label, and of transitions between labels."""
    number: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def labels(self, page: list[list[str]]) -> np.ndarray:
        """The best labels of a page (Viterbi)."""
        score = np.array([self.weights[[self.number[f] for f in b if f in self.number]].sum(axis=0) for b in page])
        best, back = score[0], []
        for row in score[1:]:
            paths = best[:, None] + self.moves
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + row
        found = [int(best.argmax())]
        for step in reversed(back):
            found.append(int(step[found[-1]]))
        return np.array(found[::-1])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def train(pages: list[tuple[list[list[str]], list[int]]]) -> Field:
    """Maximum likelihood of the labels, by gradient steps on the exact likelihood (forward-backward)."""
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
    number: dict[str, int] = {}
    # Blocks of all pages end to end, longest page first; each has the numbers of its features.
    flat, block_of, y = [], [], []
    for blocks, labels in pages:
        for b, label in zip(blocks, labels):
            mine = [number.setdefault(f, len(number)) for f in dict.fromkeys(b)]
            flat += mine
            block_of += [len(y)] * len(mine)
            y.append(label)
    flat, block_of, gold = np.array(flat, np.int64), np.array(block_of, np.int64), np.eye(2)[np.array(y, np.int64)]
    sizes = np.array([len(b) for b, _ in pages], np.int64)
    starts = np.cumsum(sizes) - sizes
    page = np.repeat(np.arange(len(pages)), sizes)
    inner = np.flatnonzero(np.arange(len(y)) != starts[page]) if pages else np.zeros(0, np.int64)
    at = [starts[:int((sizes > t).sum())] + t for t in range(int(sizes.max(initial=0)))]
    gold_moves = gold[inner - 1].T @ gold[inner]
    total = max(len(y), 1)
    theta = np.zeros(2 * len(number) + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def summed(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(groups, values[:, label], n) for label in (0, 1)], axis=1)

    for step in range(1, STEPS + 1):
        weights, moves = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        score = summed(weights[flat], block_of, len(y))
        forward, backward = score.copy(), np.zeros_like(score)
        for here in at[1:]:
            forward[here] += _log_sum(forward[here - 1][:, :, None] + moves, 1)
        for here in reversed(at[1:]):
            backward[here - 1] = _log_sum(moves + (score[here] + backward[here])[:, None, :], 2)
        norm = _log_sum(forward[starts + sizes - 1], 1)[page] if pages else np.zeros(0)
        chance = np.exp(forward + backward - norm[:, None])
        pair = np.exp(forward[inner - 1][:, :, None] + moves + (score[inner] + backward[inner])[:, None, :]
                      - norm[inner][:, None, None])
        slope = np.concatenate((summed((gold - chance)[block_of], flat, len(number)).ravel(),
                                (gold_moves - pair.sum(axis=0)).ravel())) / total - PENALTY * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope ** 2
        theta += RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return Field(number, theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2))


# --- labelled pages ----------------------------------------------------------------------------

def labels_by_landmarks(blocks: list[LeafBlock]) -> list[int]:
    """Labels of a page that marks its article: what its landmark holds, without parts of other roles."""
    found = []
    for b in blocks:
        inner = next((k for k in range(len(b.tags) - 1, -1, -1) if b.tags[k] in LANDMARKS), None)
        kept = inner is not None and b.tags[inner] in ("article", "main") and not any(
            r != "content" for roles in b.roles[inner + 1:] for r in roles)
        found.append(MAIN if kept else OTHER)
    return found


def made_pages(count: int, seed: int = 5) -> list[tuple[list[LeafBlock], list[int]]]:
    """Labelled pages of many layouts; every text begins with a mark that gives its label."""
    rng = np.random.default_rng(seed)

    def pick(*choices):
        return choices[rng.integers(len(choices))]

    def text(label, words):
        return ("m" if label else "x") + " ".join("word" for _ in range(max(1, words))) + pick("", ".", ".", "")

    def other(words=6):
        return text(OTHER, int(rng.integers(1, words)))

    def links(n, tag="li"):
        return "".join(f"<{tag}><a href='#'>{other(4)}</a></{tag}>" for _ in range(n))

    def junk(inside):
        kind = rng.integers(9 if inside else 12)
        n = int(rng.integers(1, 4))
        if kind == 0:
            return f"<div class='{pick('ad', 'ads', 'advert', 'sponsored', 'promo-box')}'>{other(30)}</div>"
        if kind == 1:
            return f"<aside{pick('', ' class=sidebar')}><h3>{other(4)}</h3><p>{other(30)}</p></aside>"
        if kind == 2:
            return f"<form{pick('', ' id=newsletter')}><p>{other(9)}</p><label>{other(4)}</label><input></form>"
        if kind == 3:
            return f"<div class='{pick('share', 'social', 'related', 'sidebar', 'widget')}'><p>{other(14)}</p></div>"
        if kind == 4:
            return f"<nav><ul>{links(n)}</ul></nav>"
        if kind in (5, 6):
            area = pick("<section class=comments>", "<div id=comments>", "<div class=comment-list>", "<section id=comments>")
            end = "</section>" if area.startswith("<section") else "</div>"
            wrap = pick("<div class=comment><p>{}</p></div>", "<p>{}</p>", "<ul><li>{}</li></ul>", "<article class=comment><p>{}</p></article>")
            return area + f"<h3>{other(3)}</h3>" + "".join(wrap.format(other(60)) for _ in range(n)) + end
        if kind == 7:
            return f"<div class='{pick('cookie', 'notice', 'cookie-banner', 'consent', 'popup')}'><p>{other(40)}</p></div>"
        if kind == 8:
            return pick(f"<header><p>{other(9)}</p></header>", f"<footer><p>{other(9)}</p></footer>")
        if kind == 9:
            return f"<header><h1>{other(5)}</h1><p>{other(9)}</p></header>"
        if kind == 10:
            return f"<div class='{pick('menu', 'topnav', 'breadcrumbs', 'footer', 'header')}'>{links(n, 'span')}</div>"
        return f"<div id='{pick('footer', 'sidebar', 'cookie-notice', 'header', 'ad-1')}'><p>{other(50)}</p></div>"

    def body():
        parts = []
        for _ in range(int(rng.integers(1, 12))):
            n = int(rng.integers(1, 80)) if rng.random() < 0.8 else int(rng.integers(80, 400))
            main = text(MAIN, n)
            parts.append(pick(
                f"<p>{main}</p>", f"<p>{main}</p>", f"<p>{main}", f"<p><b>{main}<br>", f"<h2>{text(MAIN, n % 8 + 1)}</h2>",
                f"<ul><li>{main}</li><li>{text(MAIN, n % 9 + 1)}</li></ul>", f"<blockquote><p>{main}</p></blockquote>",
                f"<table><tr><td>{main}</td><td>{text(MAIN, 2)}</td></tr></table>", f"<pre>{main}</pre>",
                f"<div>{main}</div>", f"<p><a href='#'>{text(MAIN, n % 5 + 1)}</a> {main[1:]}</p>",
                f"<figure><figcaption>{main}</figcaption></figure>", f"<section><h3>{text(MAIN, 3)}</h3><p>{main}</p></section>"))
            if rng.random() < 0.12:
                parts.append(junk(True))
        return "".join(parts)

    pages = []
    for _ in range(count):
        start, end = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"),
                          ("<main><article>", "</article></main>"), ("<div class=content>", "</div>"),
                          ("<div id=main><div class=post>", "</div></div>"))
        title = f"<h1>{text(MAIN, int(rng.integers(1, 12)))}</h1>" if rng.random() < 0.8 else ""
        page = "".join(junk(False) for _ in range(int(rng.integers(0, 4)))) + start + title + body() + end \
            + "".join(junk(False) for _ in range(int(rng.integers(0, 4)))) + f"<footer>{other(12)} &copy;</footer>"
        blocks = leaf_blocks(f"<html><head><title>x</title></head><body>{page}</body></html>")
        pages.append((blocks, [int(b.text[0] == "m") for b in blocks]))
    return pages


def _featured(blocks: list[LeafBlock]) -> list[list[str]]:
    return [features(b, k, len(blocks)) for k, b in enumerate(blocks)]


def fit_field(pages: DataFrame, key: str = "page_id", html: str = "html") -> Field:
    """The field of made-up labelled pages and of at most ``TRAIN_PAGES`` pages that mark their article.

    The pages of the table are those with the least hashes of key and size among pages of at most
    ``TRAIN_BYTES`` bytes and ``TRAIN_LONGEST`` leaf blocks, until they have ``TRAIN_BLOCKS``. A bound on the hash, from the number of rows, leaves about twice as many as
    are wanted before anything is sorted, so that only so many reach the driver from all tasks.
    """
    size = byte_length(f"`{html}`")
    share = min(1.0, 2 * TRAIN_PAGES / max(pages.count(), 1))
    sample = pages.filter(F.col(f"`{html}`").isNotNull() & (size <= TRAIN_BYTES)) \
        .select(F.col(f"`{html}`").alias("html"), hash60(F.concat(text_of(F.col(f"`{key}`")), size.cast("string"))).alias("h")) \
        .filter(F.col("h") < int(share * (1 << 60))).groupBy("h").agg(F.min("html").alias("html")) \
        .orderBy("h").limit(TRAIN_PAGES).collect()
    marked, n_blocks = [], 0
    for r in sample:
        if n_blocks < TRAIN_BLOCKS and re.search(r"<(article|main)\b", r.html, re.I):
            blocks = leaf_blocks(r.html)
            if len(blocks) <= TRAIN_LONGEST:
                marked.append(blocks)
                n_blocks += len(blocks)
    known = made_pages(MADE_PAGES) + [(blocks, labels_by_landmarks(blocks)) for blocks in marked]
    return train([(_featured(blocks), labels) for blocks, labels in known])


def main_text(html: str | None, trained: Field) -> str:
    blocks = leaf_blocks(html)
    if not blocks:
        return ""
    labels = trained.labels(_featured(blocks))
    return "\n".join(b.text for b, label in zip(blocks, labels) if label == MAIN)


def extract(pages: DataFrame, trained: Field | None = None, key: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of each row of ``pages``; the text is "" where there is none.

    Null and empty html give empty texts. Very long pages are read whole; broken markup is read as far
    as it goes. White space of any kind inside a block is one space, a line break too. Repeated rows
    give equal rows, an empty table gives none (the field is then trained on made-up pages alone).
    Extra columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained or fit_field(pages, key, html))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(h, shared.value) for (h,) in rows_of(iter([part.select(["_html"])]))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    rows = pages.select(F.col(f"`{key}`"), F.col(f"`{url}`"), F.col(f"`{html}`").alias("_html"))
    schema = rows.select(key, url, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.mapInArrow(read, schema)
