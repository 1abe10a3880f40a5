"""Main text of web pages: flat blocks, their features and those of their neighbours, and a decision tree.

A page is cut at block-level tags into blocks of text. A block's features are its words and link density, those of the
blocks before and behind it, and what encloses it (article or main, or navigation, advert and the like by tag, role or
class). A tree (CART, Gini) is grown on the blocks of a small labelled table of page layouts that stands in this file.

Character references are decoded, white space inside a block becomes one space, blocks are joined by line feeds in page
order. Nulls and pages without main text give empty texts. Broken markup is read as far as it goes: unclosed tags end with
what encloses them, an unclosed comment or script runs to the end. Pages of any length are read whole, in one pass.
Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

RAW = {"script", "style", "template", "textarea", "svg", "iframe"}
BREAKS = set("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HOLDS = set("article aside blockquote body button details dialog div dl fieldset figure footer form head header html li main menu nav ol section select span table td title ul a".split())
BOILER_TAGS = set("nav header footer aside form button select dialog menu head title".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
BOILER_WORDS = set("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related replies reply share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split())
MAIN_WORDS = set("article content entry main post story body text maincontent articlebody".split())
TOKEN = re.compile(r"<!--(?:.*?(?:-->|$))|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WORDS = re.compile(r"[a-z]+")
FEATURES = ["words", "links", "words_before", "links_before", "words_behind", "links_behind", "in_main", "in_boiler", "page_has_main", "heading", "listed"]


@cache
def marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """(boiler, main) of a tag with attributes."""
    boiler, main = tag in BOILER_TAGS, tag in ("article", "main")
    if attributes and tag not in ("body", "html"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role":
                boiler, main = boiler or value in BOILER_ROLES, main or value in ("main", "article")
            elif name in ("hidden", "aria-hidden"):
                boiler = boiler or name == "hidden" or value == "true"
            else:
                ws = set(WORDS.findall(value))
                boiler, main = boiler or bool(ws & BOILER_WORDS), main or bool(ws & MAIN_WORDS) and not ws & BOILER_WORDS
    return boiler, main


class Blocks:
    """The blocks of a page: texts and features."""

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.rows: list[list[float]] = []
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, and whether boiler, main, link hold inside
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.heading, self.now = False, ("", False, False, False)
        self.read(page)
        self.flush()
        main = float(any(r[2] for r in self.rows))
        own = [(r[0], r[1]) for r in self.rows]
        around = [(0.0, 0.0), *own, (0.0, 0.0)]
        self.features = [[w, l, *around[i], *around[i + 2], *r[2:4], main, *r[4:]] for i, ((w, l), r) in enumerate(zip(own, self.rows, strict=True))]

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                n = len(text.split())
                linked = len(" ".join(self.linked).split())
                self.texts.append(text)
                _, boiler, main, _ = self.now
                self.rows.append([float(n), min(1.0, linked / n), float(main), float(boiler), float(self.heading), float(any(s[0] == "li" for s in self.stack))])
            self.parts, self.linked = [], []

    def text(self, raw: str) -> None:
        t = entities.unescape(raw) if "&" in raw else raw
        self.parts.append(t)
        if self.now[3]:
            self.linked.append(t)

    def read(self, page: str) -> None:
        at, find = 0, TOKEN.search
        while (m := find(page, at)) is not None:
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            tag = m.group(2) or m.group(5)
            if tag is None:
                continue
            tag, attributes = tag.lower(), m.group(3) or m.group(6) or ""
            if m.group(1) or m.group(4):
                self.close(tag)
            elif tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|$)", re.I).search(page, at)
                    at = end.end() if end else len(page)
                if tag in ("svg", "iframe", "textarea"):
                    self.parts.append(" ")
            else:
                self.open(tag, attributes)
        if at < len(page):
            self.text(page[at:])

    def open(self, tag: str, attributes: str) -> None:
        if tag in BREAKS:
            self.flush()
            self.heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        elif tag in ("br", "img"):
            self.parts.append(" ")
        if tag not in HOLDS or attributes.rstrip().endswith("/") and tag not in ("a", "div", "span", "p"):
            return
        if tag in ("article", "main", "body") and not any(s[0] in ("article", "main") for s in self.stack):
            # what may not hold an article was not closed
            for i, s in enumerate(self.stack):
                if s[0] in ("nav", "header", "footer", "head", "aside", "title", "ul", "ol", "form"):
                    del self.stack[i:]
                    break
        elif tag == "a" and self.now[3]:
            self.close("a")
        elif tag == "li" and self.stack and self.stack[-1][0] == "li":
            self.close("li")
        boiler, main = marks(tag, attributes)
        _, b, m, l = self.stack[-1] if self.stack else ("", False, False, False)
        # an article inside what looks like an advert or a form stays boiler; a header with a heading of the article is not
        self.stack.append((tag, b or boiler and not (tag == "header" and m), m or main, l or tag == "a"))
        self.now = self.stack[-1]

    def close(self, tag: str) -> None:
        if tag in BREAKS:
            self.flush()
            self.heading = False
        if tag in HOLDS:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    del self.stack[i:]
                    break
                if tag in ("a", "span") and self.stack[i][0] in BREAKS:
                    break  # inline tags don't close what encloses them
            self.now = self.stack[-1] if self.stack else ("", False, False, False)


P = "It was late in the year when the work began, and nobody had thought of how long the whole of it would take in the end."
# layouts with the blocks that are main text marked by a leading +; the labelled table
SAMPLES = [
    [("<head><title>", "A title"), ("</title></head><body><nav><ul><li><a>", "Home"), ("</a><li><a>", "News"), ("</a></ul></nav><div class=ad>", P), ("</div><article><h1>", "+A title"), ("</h1><p>", "+" + P), ("<p>", "+Yes."), ("<p><a>", "+See the list"), ("</a><p>", "+" + P), ("</p><aside>", P), ("</aside><section class=comments><p>", P), ("</section></article><footer>", "(c) A paper, all rights reserved and so on")],
    [("<body><header>", "The paper <a>Log in"), ("</a></header><main><div class=breadcrumbs><a>", "Home"), ("</a></div><h2>", "+A heading"), ("</h2><ul><li>", "+One thing"), ("<li>", "+Another thing that takes more words to say"), ("</ul><p>", "+" + P + P), ("<form>", "Your name and address please, so that we can write to you"), ("</form><blockquote>", "+" + P), ("</blockquote></main><div class=sidebar><p>", P), ("</div><div id=cookie-notice>", "We use cookies to make this site better for you and for us")],
    [("<body><div class=menu><a>", "Start</a> <a>Shop"), ("</a></div><div class=post-content><h1>", "+Title"), ("</h1><p>", "+" + P), ("<p>", "+Short one."), ("<div class=share><a>", "Share this"), ("</a></div><p>", "+" + P), ("</div><div class=related><a>", P), ("</a></div><div id=comments><p>", P), ("<p>", "Nice!"), ("</div><footer><p>", P)],
    [("<body><div><a>", "Home</a> <a>About us"), ("</a></div><h1>", "+Title of the page"), ("</h1><p>", "+" + P), ("<p>", "+" + P + P), ("<p>", "+So it was."), ("<p>", "+" + P), ("<div><a>", "Next"), ("</a></div><div><a>", "Terms</a> <a>Privacy")],
    [("<body><table><tr><td><a>", "Home"), ("</a><td>", "+" + P + P), ("<td>", "+" + P), ("</table><div><a>", "Imprint of the paper"), ("</a></div>", "2019")],
    [("<body><nav><a>", P), ("</a></nav><article><header><h1>", "+Title"), ("</h1><p>", "+By one who was there"), ("</header><p>", "+" + P), ("<figure><figcaption>", "+What it looked like"), ("</figcaption></figure><p>", "+No."), ("</article><aside><h2>", "More"), ("</h2><a>", "Elsewhere"), ("</a></aside>", "")],
    [("<body><nav><a>", "Home"), ("</a></nav><article><h1>", "+Title"), ("</h1><p>", "+" + P), ("<p>", "+Well, then.")],
    [("<body><p>", "+" + P), ("<p>", "+" + P + P), ("<p>", "+" + P)],
    [("<body><p>", "+" + P), ("<p>", "+Yes."), ("<div>", "All rights reserved")],
    [("<main><p>", "+" + P)],
    [("<article><p>", "+" + P), ("<p>", "+So."), ("<p>", "+No.")],
]


class Tree:
    """Gini splits down to pure leaves or `depth`."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6):
        self.value, self.split = bool(y.mean() >= 0.5) if len(y) else False, None
        if depth == 0 or len(y) < 2 or y.min() == y.max():
            return
        gini = lambda t: len(t) * t.mean() * (1 - t.mean()) if len(t) else 0.0
        best = (gini(y) - 1e-9, None)
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for cut in (values[:-1] + values[1:]) / 2:
                left = x[:, j] < cut
                if (score := gini(y[left]) + gini(y[~left])) < best[0]:
                    best = (score, (j, cut, left))
        if best[1]:
            j, cut, left = best[1]
            self.split = j, cut, Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    def says(self, row: list[float]) -> bool:
        node = self
        while node.split:
            j, cut, low, high = node.split
            node = low if row[j] < cut else high
        return node.value


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: a row of features and a label for each block of the layouts."""
    x, y = [], []
    for sample in SAMPLES:
        b = Blocks("".join(tags + text.lstrip("+") for tags, text in sample))
        labels = [float(t[0] == "+") for _, t in sample if t]
        if len(labels) != len(b.texts):
            raise ValueError("a layout's blocks don't fit its labels")
        x += b.features
        y += labels
    return np.array(x), np.array(y)


@cache
def tree() -> Tree:
    return Tree(*labelled())


def main_text(page: str | None, model: Tree | None = None) -> str:
    model = model or tree()
    b = Blocks(page or "")
    return "\n".join(t for t, f in zip(b.texts, b.features, strict=True) if model.says(f))


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The kept columns, text, and n_chars (code points)."""

    def run(batches):
        import pyarrow as pa

        model = tree()
        for batch in batches:
            texts = [main_text(p, model) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    own = pages.select(*keep, pages[html].alias("_html"))
    return own.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(keep)]] + ["text string", "n_chars long"]))
