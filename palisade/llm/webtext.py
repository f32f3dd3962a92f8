"""Main text of web pages: flat text blocks judged by a decision tree.

A page is cut into blocks at block-level tags. A block's features are its words and link density, those of the blocks
before and after it, and which kinds of containers it stands in. A small decision tree, trained here on the labelled
pages below, keeps or drops each block.

Rules for odd input: a null or empty page has an empty text; whatever follows an unclosed comment, script or quoted
attribute belongs to it, as in browsers; a null page_id is kept; equal rows stay; an empty table gives an empty table;
only the named columns are read. Pages of any length are read whole, in time proportional to their length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML, and words that name a container's purpose.
RAW = {"script", "style", "template", "noscript", "textarea", "title", "iframe", "svg", "xmp", "noembed", "noframes", "object", "math", "canvas"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark",
          "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN, ASIDE = {"article", "main"}, {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "select", "button", "label", "option"}
MAIN_WORDS = {"article", "content", "post", "story", "entry", "main"}
ASIDE_WORDS = {"ad", "ads", "adv", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent",
               "gdpr", "notice", "alert", "sidebar", "sidenav", "rail", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "copyright",
               "legal", "disclaimer", "comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "share", "sharing", "social", "related",
               "recommended", "newsletter", "subscribe", "signup", "login", "popup", "modal", "overlay", "widget", "pagination", "pager", "toolbar", "search",
               "form", "skip"}
HEADER_WORDS = {"header", "masthead", "topbar"}
WHOLE = {"html", "body"}

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")



@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    main: int = 0
    aside: int = 0
    before: int = 0
    heading: int = 0
    text: str = ""
    words: int = 0
    links: float = 0.0


def _purpose(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether a container says that it holds main text; something else; a header."""
    found = {"class": "", "id": "", "role": "", "itemprop": "", "style": ""}
    hidden = False
    for key, a, b, c in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), (a or b or c).lower()
        hidden |= key == "hidden" or (key == "style" and "display:none" in value.replace(" ", ""))
        if key in found:
            found[key] += " " + value
    named = set(_SPLIT.split(f"{found['class']} {found['id']}"))
    roles = set(found["role"].split())
    aside = hidden or name in ASIDE or bool(named & ASIDE_WORDS) or bool(roles & {"navigation", "complementary", "contentinfo", "search", "dialog", "alert"})
    header = name == "header" or "banner" in roles or bool(named & HEADER_WORDS)
    main = name in MAIN or "main" in roles or "articlebody" in found["itemprop"] or (not aside and not header and bool(named & MAIN_WORDS))
    return main, aside, header


def blocks(page: str | None) -> list[Block]:
    """All blocks with text, in page order."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open containers: name, main, aside
    anchors, heading, at = 0, 0, 0
    now = Block()

    def close() -> None:
        nonlocal now
        now.text = " ".join(html.unescape("".join(now.parts)).split()) if now.parts else ""
        if now.text:
            # a header is the page's own unless it stands within the main text; an aside counts from the main text inwards
            outer = next((k for k, x in enumerate(stack) if x[1]), len(stack))
            now.main = sum(x[1] for x in stack)
            now.aside, now.before = sum(x[2] for x in stack[outer:]), sum(x[2] for x in stack[:outer])
            now.heading, now.words = int(heading > 0), len(now.text.split())
            now.links = min(1.0, now.linked / now.words)
            out.append(now)
        now = Block()

    def put(text: str) -> None:
        if text:
            now.parts.append(text)
            if anchors:
                now.linked += len(text.split())

    while at < len(page):
        token = _TOKEN.search(page, at)
        put(page[at:token.start()] if token else page[at:])
        if not token:
            break
        at = token.end()
        closing, name, attributes = token.group(1), (token.group(2) or "").lower(), token.group(3) or ""
        if not name:
            continue
        if name in RAW:
            if not closing:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at) if not attributes.endswith("/") or name != "svg" else None
                if end or not (attributes.endswith("/") and name == "svg"):
                    at = end.end() if end else len(page)
            continue
        if name == "a":
            anchors = max(0, anchors - 1) if closing else 1
        if name in INLINE:
            continue
        close()
        if name in HEADINGS:
            heading = 0 if closing else 1
        if name in VOID or name in WHOLE or name in ("p", "li", "tr", "td", "th", "dt", "dd") or name in HEADINGS:
            if name in VOID or closing or name in WHOLE:
                continue
            main, aside, header = _purpose(name, attributes) if attributes else (False, False, False)
            if aside or header:  # such an element lasts to its own end, or to that of what holds it
                stack.append((name, False, True))
            continue
        anchors = 0
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                del stack[depth:]
        elif not attributes.endswith("/"):
            main, aside, header = _purpose(name, attributes)
            inside = any(x[1] for x in stack)
            stack.append((name, main, aside or (header and not inside)))
    close()
    return out


FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "main", "aside", "aside_before", "heading", "page_main"]


def features(found: list[Block]) -> np.ndarray:
    words = np.array([0, *[b.words for b in found], 0], float)
    links = np.array([0, *[b.links for b in found], 0], float)
    own = np.array([[min(b.main, 1), min(b.aside, 1), min(b.before, 1), b.heading] for b in found], float).reshape(len(found), 4)
    page = np.full(len(found), float(any(b.main for b in found)))
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], own, page])


@dataclass
class Tree:
    keep: bool = False
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.keep)
        out, low = np.empty(len(x), bool), x[:, self.feature] <= self.cut
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7) -> Tree:
    """Splits by the Gini index; among equal ones the earlier feature."""
    if depth and 0 < y.sum() < len(y):
        best, found = 1e-12, None
        whole = y.mean() * (1 - y.mean())
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            values, kept = x[order, j], np.cumsum(y[order])
            ends = np.flatnonzero(values[1:] != values[:-1])
            n = ends + 1
            p, q = kept[ends] / n, (kept[-1] - kept[ends]) / (len(y) - n)
            gain = whole - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
            if len(gain) and gain.max() > best + 1e-9:
                k = ends[gain.argmax()]
                best, found = gain.max(), (j, (values[k] + values[k + 1]) / 2)
        if found:
            j, cut = found
            low = x[:, j] <= cut
            return Tree(feature=j, cut=cut, low=grow(x[low], y[low], depth - 1), high=grow(x[~low], y[~low], depth - 1))
    return Tree(keep=bool(y.mean() > 0.5)) if len(y) else Tree()


# The labelled table: pages in which "+n" stands for n words to keep and "-n" for n words to drop.
_LINKS = "<ul><li><a>-1</a></li><li><a>-2</a></li><li><a>-1</a></li></ul>"
LABELLED = [
    f"<nav>{_LINKS}</nav><div class=ad>-8</div><article><h1>+9</h1><p>+60<p>+1</p><p>+30</p><p>+2</p></article><footer>-9</footer>",
    f"<header><a>-2</a><p>-6</p>{_LINKS}</header><main><h1>+5</h1><p>+4</p><p>+120</p><div class=share><a>-1</a> -3</div><p>+3</p></main>",
    f"<div id=sidebar><h3>-2</h3>{_LINKS}<p>-40</p></div><div class=content><h2>+4</h2><p>+1</p><p>+25</p><ul><li>+3</li><li>+2</li></ul></div>",
    "<article><header><h1>+6</h1></header><p>+80 <a>+3</a> +9</p><aside><p>-30</p></aside><p>+7</p><footer>-12</footer></article>"
    "<section class=comments><h2>-1</h2><p>-45</p><p>-3</p><article><p>-50</p></article></section>",
    "<div class=cookie-notice><p>-25</p><button>-1</button></div><article><p>+15</p><blockquote>+22</blockquote><p>+1</p>"
    "<div class=newsletter><form><label>-3</label><p>-14</p></form></div><p>+33</p><section id=comments><p>-60</p><p>-2</p></section></article>",
    f"<div>{_LINKS}</div><h1>+8</h1><p>+45</p><p>+28</p><p>+70</p><p>+12</p><div><a>-2</a> <a>-3</a> <a>-2</a></div><p>-4</p>",
    f"<table><tr><td>{_LINKS}</td><td><p>+35</p><p>+50</p><p>+18</p></td></tr></table><p>-6</p><p><a>-2</a></p>",
    "<p><a>-3</a> <a>-2</a> <a>-2</a></p><p>+40</p><p>+22 <a>+2</a></p><p>+31</p><p><a>-4</a></p><p>-3</p>",
    f"<article><h1>+3</h1><p>+1</p><p>+2</p><p>+1</p></article><aside><p>-90</p></aside><footer><p>-55</p>{_LINKS}</footer>",
    "<main><article><h2>+4</h2><p>+12</p><p><a>+5</a></p><table><tr><td>+1</td><td>+2</td></tr></table><pre>+14</pre></article></main>"
    "<div class=related><h3>-2</h3><p>-20</p><a>-6</a></div>",
    "<form><p>-20</p><label>-2</label></form><div class=story><p>+9</p><p>+18</p></div><div class=promo><p>-16</p></div>",
    "<div class=banner>-12</div><div><p>+55</p><p>+26</p></div><div class=footer><p>-30</p></div>",
    "<div><a>-3</a> | <a>-2</a></div><p>+30</p><p>+2</p><p>+40</p><p>+1</p><p>+25</p><p>+3</p><p>+60</p><div><a>-12</a> <a>-10</a> -1</div>",
    "<div><a>-14</a></div><h1>+4</h1><p>+2</p><p>+50</p><p>+5</p><p>+33 <a>+4</a></p><p><a>-9</a></p><p><a>-11</a></p><p>-5</p>",
    "<p>+30</p><p>+22</p>", "<p>+12</p>", "<h1>+3</h1><p>+40</p><p>+2</p>", "<p>+1</p>",
    "<div><p>-30</p></div><article><h1>+5</h1><p>+20</p><p>+2</p></article><div>-9</div><p>-1</p>",
    "<p>-3</p><p>-17</p><main><p>+2</p><p>+44</p><p>+1</p></main><p>-60</p><p>-2</p>",
    "<article><p><a>+4</a></p><ul><li><a>+2</a></li><li><a>+3</a></li></ul><p>+1</p><nav><a>-2</a></nav><div class=ad>-15</div></article>",
]


def train() -> Tree:
    rows, labels = [], []
    for page in LABELLED:
        filled = re.sub(r"([+-])(\d+)", lambda m: " ".join(["keep" if m[1] == "+" else "drop"] * int(m[2])), page)
        found = blocks(filled)
        rows.append(features(found))
        labels += ["keep" in b.text for b in found]
    return grow(np.concatenate(rows), np.array(labels, float))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, tree.predict(features(found))) if keep)


def extract(rows: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``."""
    tree = train()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), tree) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    asked = rows.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    return asked.mapInArrow(work, "page_id long, url string, text string, n_chars long")
