"""Main text of web pages by their line-block distribution.

Markup is stripped to lines, one per block element, and every line gets a weight: its text
length, more in paragraphs and headings, nothing if it is mostly links, a short legal or cookie
line, or stands in navigation, an advert, form, comments and the like. Where the page marks an
article, lines inside it weigh ``INSIDE`` more and lines outside it nothing, unless the
paragraphs and headings outside hold more text than the marked lines: then the mark stands on a
teaser and only adds its weight. Sums over sliding windows of ``WINDOW`` lines, forwards and backwards,
give the surge (the first line with weight whose window reaches the threshold) and the dive (the
last one whose window, looking back, does); the lines with weight between the two are kept, and so
are the short legal lines there: their words only keep them from opening or closing the text.
The threshold is ``SURGE``, or half of the largest window sum on pages with less text.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import table

WINDOW = 3
SURGE = 80
INSIDE = 200
#: What a line weighs more by its element.
BONUS = {**dict.fromkeys("h1 h2 h3 h4 h5 h6 p blockquote pre".split(), 80), **dict.fromkeys("li dd dt td th figcaption".split(), 40)}
#: Unmarked lines of up to ``LEGAL_CHARS`` characters that say this weigh nothing.
LEGAL = re.compile(r"\u00a9|\bcopyright\b|all rights reserved|\bcookies?\b|privacy policy|terms of (?:use|service)|\bnewsletter\b", re.I)
LEGAL_CHARS = 160
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'<>]++|"[^"]*+"|'[^']*+'|["'])*+)>?""", re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Parts of a name, at signs and where capitals begin.
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html"
    " legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never the article's (header: only outside of it).
DROP = frozenset("nav footer aside form button menu dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Parts of class and id names that mark such elements.
NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer form gdpr"
    " login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related reply share sharing"
    " sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that stand beside one of ``NAMES`` in the names of boxes, as in ``comment-list``.
BOXES = frozenset(
    "area articles bar block bottom box button buttons by card col column container content count counter desktop entry fixed first float follow footer form google grid group"
    " header icon icons info inner items last law leaderboard left like likes link links list main media message messages mobile outer overlay page panel placeholder policy post"
    " posts respond right row section site slot sticky stories text thread title tool tools top unit wrap wrapper zone".split()
)
#: Elements of running text, which only a whole name of ``NAMES`` marks.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption span em strong b i".split())
_CLOSES_P = BLOCK - {"option", "optgroup", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SELF_CLOSE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


@dataclass
class _Line:
    inside: bool
    element: str
    parts: list = field(default_factory=list)
    linked: int = 0


@dataclass
class _Open:
    name: str
    inside: bool
    dropped: bool
    link: bool
    element: str


def _marked(name: str, attrs: str) -> bool:
    """Whether an element's role, class or id says that it is no part of an article."""
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.lower() in ROLES:
                return True
            continue
        for token in value.split():
            parts = [x.lower() for x in _PARTS.findall(token)]
            if token.lower() in NAMES or name not in TEXT and any(x in NAMES for x in parts) and all(x in NAMES or x in BOXES or x.isdigit() for x in parts):
                return True
    return False


def _lines(page: str) -> list[_Line]:
    """Lines of a page: whether they are in its article, their element, and the text of each."""
    stack = [_Open("", False, False, False, "")]
    count: Counter = Counter()
    lines = [_Line(False, "")]
    at = 0
    breaks = True

    def text(raw: str):
        nonlocal breaks
        top = stack[-1]
        if breaks:
            lines.append(_Line(top.inside, top.element))
            breaks = False
        if not top.dropped:
            line = lines[-1]
            line.parts.append(raw)
            if top.link:
                line.linked += len(raw.strip())

    def pop_to(index: int):
        count.subtract(x.name for x in stack[index:])
        del stack[index:]

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in BLOCK:
            breaks = True
        elif name == "br":
            text(" ")
        if closing:
            for i in range(len(stack) - 1, 0, -1) if count[name] else ():
                if stack[i].name == name:
                    pop_to(i)
                    break
                if stack[i].name in ("article", "main") and name not in ("article", "main", "body", "html", "div", "section"):
                    break
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                end = _raw_end(name).search(page, at)
                at = end.end() if end else size
            continue
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCK:
            continue
        if name in _CLOSES_P and count["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    pop_to(i)
                    break
                if stack[i].name in BLOCK:
                    break
        if name in _SELF_CLOSE:
            stop = _SELF_CLOSE[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name or {stack[i].name, name} == {"dt", "dd"} or {stack[i].name, name} == {"td", "th"}:
                    pop_to(i)
                    break
                if stack[i].name in stop:
                    break
        top = stack[-1]
        inside = top.inside or name in ("article", "main")
        dropped = top.dropped or name in DROP or name == "header" and not inside
        if not dropped and name not in ("html", "body", "main"):
            dropped = _marked(name, m[3])
        stack.append(_Open(name, inside, dropped, top.link or name == "a", name if name in BLOCK else top.element))
        count[name] += 1
    return lines


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*>?", re.I)


def _weights(lines: list[_Line], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What each line says for being the article's, and whether it is text if it stands among it; see the module's text."""
    linked = np.array([2 * x.linked >= len(t) for x, t in zip(lines, texts, strict=True)], bool)
    inside = sum(len(t) for x, t in zip(lines, texts, strict=True) if x.inside)
    beside = sum(len(t) for x, t, far in zip(lines, texts, linked, strict=True) if not x.inside and x.element in BONUS and not far)
    marked = inside > 0 and beside <= inside
    out, among = np.zeros(len(lines), np.int64), np.zeros(len(lines), bool)
    for i, (x, t) in enumerate(zip(lines, texts, strict=True)):
        if not t or (marked and not x.inside):
            continue
        if x.inside:
            out[i], among[i] = len(t) + INSIDE, True
        elif not linked[i]:
            among[i] = True
            if not (len(t) <= LEGAL_CHARS and LEGAL.search(t)):
                out[i] = len(t) + BONUS.get(x.element, 0)
    return out, among


def _extent(weight: np.ndarray) -> tuple[int, int]:
    """(first line, line after the last) between the surge and the dive of the window sums."""
    if not weight.any():
        return 0, 0
    ahead = np.convolve(weight, np.ones(WINDOW, np.int64))[WINDOW - 1 :]
    behind = np.convolve(weight, np.ones(WINDOW, np.int64))[: len(weight)]
    threshold = min(SURGE, int(ahead.max()) // 2)
    surge = np.flatnonzero((ahead >= threshold) & (weight > 0))
    dive = np.flatnonzero((behind >= threshold) & (weight > 0))
    return int(surge[0]), int(dive[-1]) + 1


def extract(page: str | None) -> str:
    """The main text of one page: its blocks joined by line ends, '' if there is none."""
    lines = [x for x in _lines(page or "") if x.parts]
    texts = [" ".join(_html.unescape("".join(x.parts)).split()) for x in lines]
    weight, among = _weights(lines, texts)
    first, last = _extent(weight)
    return "\n".join(texts[i] for i in range(first, last) if among[i])


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, *keep, text) per row: null html is empty and gives ''; repeated rows give equal rows.

    One narrow pass; other columns are not read; an empty table gives none.
    """
    names = [id_col, *keep]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [extract(x) for x in part.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(names))], pa.array(texts, pa.string())], [*names, "text"])

    kinds = dict(pages.dtypes)
    src = pages.select(*[F.col(c) for c in names], F.col(html_col).cast("string").alias("__html"))
    return src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", text string")


def op5_html_extraction(spark, sf_dir):
    """Contract query over all ``pages``."""
    rows = extract_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
