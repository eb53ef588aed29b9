"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags.  Each block has shallow features: its word count and link
density, those of the blocks before and after it, and marks of where it stands (in the article, in a container
of boilerplate, in one whose class or id names boilerplate, a heading).  A decision tree (CART, Gini) trained
on the small labelled table below keeps or drops it; kept blocks are the main text.

Defined results: null or empty html gives an empty text; the whole page is read, however long; unclosed tags,
comments and raw elements run to the end of the page; repeated rows are extracted alike; of other columns all
stay, but for ``text`` and ``n_chars``, which replace columns of that name.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

# --------------------------------------------------------------------------- blocks

# Element names of the HTML standard and words that name boilerplate.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "textarea", "select", "button", "title", "head", "datalist", "map"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "nobr", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTENT = {"article", "main"}
BOILER = {"nav", "footer", "aside", "form", "menu", "dialog"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
KEPT_OPEN = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot", *HEADINGS}  # need no place on the stack
NAMES = re.compile(
    r"(?:^|[^a-z])(ads?|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|searchbox|"
    r"menus?|menubar|navbar|nav|navigation|breadcrumbs?|sidebar|aside|widgets?|related|recommend\w*|share|sharing|social|comments?|commentlist|replies|reply|disqus|respond|discussion|"
    r"footer|header|masthead|topbar|toolbar|copyright|legal|pagination|pager|skip|complementary|contentinfo|hidden)(?:$|[^a-z])"
)
_TAG = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>\x00]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>\x00]*)([^>]*)>|<[!?][^>]*>|</[^a-zA-Z>][^>]*>|</>")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?=\s|/|$))", re.I)
_CUT = re.compile(r"<(?:[a-zA-Z/!?][^>]*)?$")
_SPACE = re.compile(r"[ \t\n\r\f\v ]+")


class Block:
    __slots__ = ("boiler", "content", "heading", "hint", "linked", "parts", "text", "words")

    def __init__(self, content: bool, boiler: bool, hint: bool, heading: bool):
        self.content, self.boiler, self.hint, self.heading = content, boiler, hint, heading
        self.parts: list[str] = []
        self.linked = 0


@lru_cache(maxsize=1 << 14)
def _marks(name: str, attrs: str) -> tuple[bool, bool, bool]:
    """(content, boilerplate, hint) of an opening tag."""
    hint = False
    for m in _ATTR.finditer(attrs) if attrs else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            hint |= bool(NAMES.search(value))
        elif key == "style":
            hint |= "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", "")
        else:
            hint |= key == "hidden" or value == "true"
    return name in CONTENT, name in BOILER, hint


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order, with their text decoded and white space folded."""
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # name and marks in force before it
    content = boiler = hint = heading = False
    out: list[Block] = []
    now: Block | None = None
    links = 0
    at, n, low = 0, len(page), None

    def add(piece: str) -> None:
        nonlocal now
        if now is None:
            if not piece.strip():
                return
            now = Block(content, boiler, hint, heading)
            out.append(now)
        now.parts.append(piece)
        if links:
            now.linked += len(piece.split())

    while True:
        m = _TAG.search(page, at)
        if m is None:
            tail = page[at:]
            cut = _CUT.search(tail)
            add(tail[: cut.start()] if cut and cut[0] != "<" else tail)
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if m[2] is None and m[5] is None:
            continue
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        name = name.lower()
        if name in RAW and not closing:
            if name == "head" or attrs.endswith("/") and name in ("svg", "math"):
                pass
            else:
                if low is None:
                    low = page.lower()
                    if len(low) != n:  # a few characters change their length
                        low = re.sub("[A-Z]+", lambda x: x[0].lower(), page)
                end = low.find(f"</{name}", at)
                gt = page.find(">", end) if end >= 0 else -1
                at = n if gt < 0 else gt + 1
                continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            elif name == "br" and now is not None:
                now.parts.append(" ")
            if name in VOID or closing or not attrs:
                if not (closing and stack and stack[-1][0] == name):
                    continue
            elif _marks(name, attrs)[2]:
                pass  # an inline element that names boilerplate is a container of its own
            else:
                continue
        now = None
        links = 0 if name != "a" else links
        if name in VOID:
            continue
        if closing:
            if name in HEADINGS:
                heading = False
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    content, boiler, hint, heading = stack[i][1:]
                    del stack[i:]
                    break
            continue
        c, b, h = _marks(name, attrs.rstrip("/ "))
        if name in HEADINGS or name in CONTENT or name in ("html", "body"):
            h = False  # such names often speak of the page's layout
        if name in HEADINGS:
            heading = True
        elif name == "p":
            heading = False
        if name in KEPT_OPEN and not h:
            continue
        stack.append((name, content, boiler, hint, heading if name not in HEADINGS else False))
        if name == "header" and not content:
            b = True
        content, boiler, hint = content or c, boiler or b, hint or h
    kept = []
    for x in out:
        text = "".join(x.parts)
        if "&" in text:
            text = _html.unescape(text)
        x.text = " ".join(text.split())
        if x.text:
            x.words = x.text.count(" ") + 1
            kept.append(x)
    return kept


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "content", "boiler", "hint", "heading", "page_has_content")


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES per block; link density is the share of words inside links."""
    n = len(found)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = [min(b.words, 200) for b in found]
    out[:, 1] = [min(1.0, b.linked / b.words) for b in found]
    out[1:, 2:4] = out[:-1, 0:2]
    out[:-1, 4:6] = out[1:, 0:2]
    out[:, 6] = [b.content for b in found]
    out[:, 7] = [b.boiler for b in found]
    out[:, 8] = [b.hint for b in found]
    out[:, 9] = [b.heading for b in found]
    out[:, 10] = out[:, 6].any()
    return out


# --------------------------------------------------------------------------- the tree

# Labelled blocks: words, links, before (words, links), after (words, links), content, boiler, hint, heading,
# page has an article or main element; then 1 for main text, 0 for boilerplate.
TABLE = """
1 1 0 0 1 1 0 1 0 0 1 0
1 1 1 1 1 1 0 1 0 0 1 0
2 1 1 1 9 0 0 1 0 0 1 0
9 0 1 1 8 0 0 0 1 0 1 0
14 0 2 1 30 0 0 0 1 0 1 0
40 0 3 0 12 0 0 0 1 0 1 0
25 0 0 0 5 0 0 0 0 0 1 0
60 0 5 1 10 0 0 0 0 0 1 0
8 0 9 0 40 0 1 0 0 1 1 1
3 0 4 1 60 0 1 0 0 1 1 1
12 0 1 1 1 0 1 0 0 1 1 1
40 0 8 0 80 0 1 0 0 0 1 1
80 0 40 0 30 0 1 0 0 0 1 1
1 0 80 0 60 0 1 0 0 0 1 1
2 0 30 0 1 0 1 0 0 0 1 1
5 0 1 0 12 0 1 0 0 0 1 1
30 .2 90 0 20 0 1 0 0 0 1 1
20 .5 60 0 40 0 1 0 0 0 1 1
4 1 50 0 45 0 1 0 0 0 1 1
1 1 20 0 30 0 1 0 0 0 1 1
150 0 60 0 9 0 1 0 0 0 1 1
200 0 150 0 7 0 1 0 0 0 1 1
60 0 120 0 12 0 1 0 0 0 1 1
9 0 60 0 0 0 0 1 0 0 1 0
7 0 120 0 0 0 0 1 0 0 1 0
12 .3 40 0 0 0 0 1 0 0 1 0
50 0 10 0 4 1 0 1 0 0 1 0
12 0 90 0 30 0 1 0 1 0 1 0
45 0 30 0 12 0 1 0 1 0 1 0
3 1 12 0 5 1 1 0 1 0 1 0
2 0 80 0 20 0 1 0 1 1 1 0
25 .1 2 0 25 0 1 0 1 0 1 0
70 0 25 0 9 0 1 0 1 0 1 0
4 1 60 0 4 1 1 1 0 0 1 0
20 0 60 0 8 0 1 1 0 0 1 0
60 0 20 0 60 0 1 1 0 0 1 0
2 0 40 0 5 1 1 1 0 1 1 0
30 0 60 0 90 0 1 1 1 0 1 0
3 0 0 0 1 1 0 1 0 1 1 0
2 0 20 0 30 0 0 1 0 1 1 0
2 0 70 0 15 0 0 0 1 1 1 0
3 0 60 0 20 0 0 0 0 1 1 0
1 1 0 0 1 1 0 0 0 0 0 0
2 1 1 1 2 1 0 0 0 0 0 0
3 1 2 1 10 0 0 0 0 0 0 0
1 1 1 1 1 1 0 1 0 0 0 0
8 0 3 1 50 0 0 0 0 1 0 1
4 0 2 1 90 0 0 0 0 1 0 1
10 0 60 0 70 0 0 0 0 1 0 1
50 0 8 0 70 0 0 0 0 0 0 1
30 0 60 0 45 0 0 0 0 0 0 1
90 .05 10 0 90 0 0 0 0 0 0 1
25 .1 80 0 60 .1 0 0 0 0 0 1
16 0 70 0 30 0 0 0 0 0 0 1
6 0 45 0 60 0 0 0 0 0 0 1
3 0 60 0 40 0 0 0 0 0 0 1
2 0 30 0 30 0 0 0 0 0 0 1
120 0 30 0 10 1 0 0 0 0 0 1
40 0 60 0 3 1 0 0 0 0 0 1
12 .8 60 0 10 .9 0 0 0 0 0 0
20 .7 30 .8 4 1 0 0 0 0 0 0
30 .9 5 1 12 .8 0 0 0 0 0 0
5 0 4 1 4 1 0 0 0 0 0 0
4 0 20 .8 2 1 0 0 0 0 0 0
7 .4 3 1 3 1 0 0 0 0 0 0
6 0 12 .6 0 0 0 0 0 0 0 0
10 0 60 0 0 0 0 1 0 0 0 0
40 0 60 0 12 0 0 1 0 0 0 0
30 0 12 0 60 0 0 1 0 0 0 0
60 0 40 0 12 0 0 0 1 0 0 0
25 0 60 0 25 0 0 0 1 0 0 0
12 0 2 1 60 0 0 0 1 0 0 0
6 0 30 0 40 0 0 0 1 1 0 0
3 0 2 0 20 0 0 1 0 1 0 0
12 0 0 0 0 0 0 0 0 0 0 1
12 0 2 1 3 1 0 0 0 0 0 1
12 0 60 0 0 0 0 0 0 0 0 1
12 0 0 0 60 0 0 0 0 0 0 1
12 0 4 0 5 0 0 0 0 0 0 1
12 0 3 1 40 0 0 0 0 0 0 1
12 0 40 0 3 1 0 0 0 0 0 1
20 0 0 0 0 0 0 0 0 0 0 1
20 0 2 1 3 1 0 0 0 0 0 1
20 0 60 0 0 0 0 0 0 0 0 1
20 0 0 0 60 0 0 0 0 0 0 1
20 0 4 0 5 0 0 0 0 0 0 1
20 0 3 1 40 0 0 0 0 0 0 1
20 0 40 0 3 1 0 0 0 0 0 1
45 0 0 0 0 0 0 0 0 0 0 1
45 0 2 1 3 1 0 0 0 0 0 1
45 0 60 0 0 0 0 0 0 0 0 1
45 0 0 0 60 0 0 0 0 0 0 1
45 0 4 0 5 0 0 0 0 0 0 1
45 0 3 1 40 0 0 0 0 0 0 1
45 0 40 0 3 1 0 0 0 0 0 1
100 0 0 0 0 0 0 0 0 0 0 1
100 0 2 1 3 1 0 0 0 0 0 1
100 0 60 0 0 0 0 0 0 0 0 1
100 0 0 0 60 0 0 0 0 0 0 1
100 0 4 0 5 0 0 0 0 0 0 1
100 0 3 1 40 0 0 0 0 0 0 1
100 0 40 0 3 1 0 0 0 0 0 1
2 0 0 0 0 0 0 0 0 0 0 0
2 0 3 1 3 1 0 0 0 0 0 0
2 0 4 0 5 0 0 0 0 0 0 0
2 0 60 0 60 0 0 0 0 0 0 1
2 0 20 0 15 0 0 0 0 0 0 1
2 0 2 1 30 0 0 0 0 0 0 0
2 0 30 0 2 1 0 0 0 0 0 0
5 0 0 0 0 0 0 0 0 0 0 0
5 0 3 1 3 1 0 0 0 0 0 0
5 0 4 0 5 0 0 0 0 0 0 0
5 0 60 0 60 0 0 0 0 0 0 1
5 0 20 0 15 0 0 0 0 0 0 1
5 0 2 1 30 0 0 0 0 0 0 0
5 0 30 0 2 1 0 0 0 0 0 0
7 0 0 0 0 0 0 0 0 0 0 0
7 0 3 1 3 1 0 0 0 0 0 0
7 0 4 0 5 0 0 0 0 0 0 0
7 0 60 0 60 0 0 0 0 0 0 1
7 0 20 0 15 0 0 0 0 0 0 1
7 0 2 1 30 0 0 0 0 0 0 0
7 0 30 0 2 1 0 0 0 0 0 0
12 .8 0 0 60 0 0 0 0 0 0 0
12 .8 60 0 60 0 0 0 0 0 0 0
12 .8 10 1 10 1 0 0 0 0 0 0
30 .8 0 0 60 0 0 0 0 0 0 0
30 .8 60 0 60 0 0 0 0 0 0 0
30 .8 10 1 10 1 0 0 0 0 0 0
60 .8 0 0 60 0 0 0 0 0 0 0
60 .8 60 0 60 0 0 0 0 0 0 0
60 .8 10 1 10 1 0 0 0 0 0 0
5 0 0 0 12 0 0 0 0 1 0 1
5 0 3 1 60 0 0 0 0 1 0 1
5 0 60 0 30 0 0 0 0 1 0 1
5 0 60 0 2 1 0 0 0 1 0 0
5 0 3 1 2 1 0 0 0 1 0 0
"""


SPREAD = (0, 1, 3, 7, 15, 30, 60, 110, 200)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The table's features and labels.

    Where a page marks its article, marks decide, not shape: such rows are repeated over a spread of word
    counts and link densities of the block and its neighbours, as heading and not.  Rows of other pages are repeated with counts 0.7 to 1.3 fold.
    """
    t = np.array([line.split() for line in TABLE.strip().splitlines()], float)
    draw, rows = np.random.Generator(np.random.PCG64(7)), []
    for row in t:
        for _ in range(60 if row[10] else 9):
            x = row.copy()
            if row[10]:
                x[[0, 2, 4]] = draw.choice(SPREAD, 3)
                x[[1, 3, 5]] = draw.choice((0, 0, 0.2, 0.5, 0.8, 1), 3)
                x[9] = draw.integers(0, 2)
            else:
                x[[0, 2, 4]] = np.rint(row[[0, 2, 4]] * draw.uniform(0.7, 1.3))
            x[0] = max(1, x[0])
            rows.append(x)
    x = np.array(rows)
    return x[:, :-1], x[:, -1].astype(int)


def grow(x: np.ndarray, y: np.ndarray, least: int = 4, depth: int = 10) -> tuple:
    """A CART tree by Gini impurity: (feature, threshold, at most, above) or (label,)."""
    if depth == 0 or len(set(y.tolist())) == 1 or len(y) < 2 * least:
        return (int(2 * y.sum() >= len(y)),)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        n = np.arange(1, len(y) + 1)
        for i in cut[(n[cut] >= least) & (len(y) - n[cut] >= least)]:
            a, b = n[i], len(y) - n[i]
            pa_, pb = ones[i] / a, (ones[-1] - ones[i]) / b
            impure = a * pa_ * (1 - pa_) + b * pb * (1 - pb)
            if best is None or impure < best[0] - 1e-12:
                best = (impure, f, (v[i] + v[i + 1]) / 2)
    if best is None:
        return (int(2 * y.sum() >= len(y)),)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[left], y[left], least, depth - 1), grow(x[~left], y[~left], least, depth - 1))


def classify(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), bool(tree[0]))
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x), bool)
    out[left], out[~left] = classify(tree[2], x[left]), classify(tree[3], x[~left])
    return out


def main_text(page: str | None, tree: tuple) -> str:
    """The main text of one page, blocks joined by two newlines."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = classify(tree, features(found))
    return "\n\n".join(b.text for b, k in zip(found, keep.tolist(), strict=True) if k)


# --------------------------------------------------------------------------- operator and query


def extract_text(pages: DataFrame, html_col: str = "html", table: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """pages with html_col replaced by ``text`` and its code points, ``n_chars``."""
    tree = grow(*(table or labelled()))
    pages = C.without(pages, "text", "n_chars") if html_col.lower() != "text" else C.without(pages, "n_chars")
    rest = [f for f in pages.schema.fields if f.name != html_col]
    schema = T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), tree) for h in b.column(html_col)]
            cols = [b.column(k) for k in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    return pages.mapInArrow(run, schema)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", F.col("text"), "n_chars")
