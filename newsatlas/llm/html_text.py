"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks. A block is described by its word count and link density, those of its two
neighbours, and where it stands (inside the article, beside an article, under a navigation, advert, form or comment
element). A decision tree, trained on the small labelled table below, tells content from the rest.

An article element counts as the page's article if it stands under no mark and if the long blocks inside such elements hold
at least as many words as those outside; else the page is judged as one without article.

A mark is a guess from a name, so the density of what it holds can overrule it: the blocks of ``LONG`` words or more and
few links under an outermost mark are weighed against the text kept so far. A mark of readers' comments is lifted only
from a page of which no long block is kept, any other also where its long blocks outweigh the kept text ``OUTWEIGH``
times. A lifted mark frees what stands under it, but for the marks further inside.

Defined results: null, empty and text-free pages give an empty text; markup that is cut off or never closed ends with
the page; ``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text; repeated rows are treated alike; an empty
table gives no rows; input columns named like an output column give way to it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from newsatlas.llm.frames import arrow_map, query, table, without

MARKUP = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/(?=[^a-zA-Z])[^>]*(?:>|\Z)|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z))",
    re.DOTALL,
)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>"']|$)""", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: HTML element names by how they are read.
SILENT = ["audio", "button", "iframe", "noscript", "script", "select", "style", "svg", "template", "textarea", "title", "video"]
INLINE = ["a", "abbr", "acronym", "annotation", "b", "bdi", "bdo", "big", "br", "canvas", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "math", "mfrac", "mi", "mn", "mo", "mrow", "ms", "msqrt", "msub", "msup", "mtext", "object", "q", "ruby", "s", "samp", "semantics", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"]
EMPTY = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
CONTENT = ["article", "main"]
#: Elements, and words in class, id and role, that mark what is not the article.
ASIDE = ["aside", "dialog", "footer", "form", "header", "menu", "nav"]
HINTS = [
    "ad", "ads", "advert", "advertisement", "adverts", "alert", "aside", "banner", "breadcrumb", "breadcrumbs", "complementary", "consent", "contentinfo", "cookie",
    "cookies", "copyright", "dialog", "disclaimer", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "related", "search", "share", "sharing", "sidebar", "skip", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "topbar", "widget",
]
REMARKS = ["comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "respond", "review", "reviews"]

LONG, OUTWEIGH = 20, 4

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "beside", "marked"]
#: Small labelled table of blocks: the features in the order above, then 1 for content. links is the share of linked
#: words; inside: in the article; beside: outside it, on a page that has one; marked: under an element named above.
LABELLED = [
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 1, 0), (2, 1.0, 1, 1.0, 1, 1.0, 0, 1, 1, 0), (1, 1.0, 2, 1.0, 9, 0.0, 0, 1, 1, 0), (12, 0.0, 1, 1.0, 9, 0.0, 0, 1, 1, 0),
    (14, 0.0, 80, 0.0, 0, 0.0, 0, 1, 1, 0), (30, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0, 0), (8, 0.0, 12, 0.0, 40, 0.0, 1, 0, 0, 1), (1, 0.0, 40, 0.0, 60, 0.0, 1, 0, 0, 1),
    (90, 0.0, 8, 0.0, 55, 0.0, 1, 0, 0, 1), (55, 0.02, 90, 0.0, 1, 0.0, 1, 0, 0, 1), (3, 1.0, 55, 0.0, 70, 0.0, 1, 0, 0, 1), (25, 0.3, 60, 0.0, 14, 0.0, 1, 0, 0, 1),
    (200, 0.01, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (5, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (20, 0.0, 70, 0.0, 18, 0.0, 1, 0, 1, 0), (40, 0.0, 20, 0.0, 35, 0.0, 1, 0, 1, 0),
    (6, 1.0, 75, 0.0, 5, 1.0, 1, 0, 1, 0), (2, 0.0, 30, 0.0, 2, 0.0, 1, 0, 1, 0), (150, 0.0, 60, 0.0, 40, 0.0, 1, 0, 1, 0), (4, 0.0, 0, 0.0, 3, 1.0, 0, 1, 0, 0),
    (60, 0.0, 10, 0.1, 45, 0.0, 0, 1, 0, 0), (3, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (2, 1.0, 3, 1.0, 6, 0.0, 0, 0, 0, 0), (4, 0.75, 3, 1.0, 2, 1.0, 0, 0, 0, 0),
    (9, 0.0, 2, 1.0, 60, 0.0, 0, 0, 0, 1), (7, 0.0, 40, 0.0, 50, 0.0, 0, 0, 0, 1), (60, 0.0, 7, 0.0, 45, 0.0, 0, 0, 0, 1), (45, 0.05, 60, 0.0, 30, 0.0, 0, 0, 0, 1),
    (25, 0.1, 45, 0.05, 3, 1.0, 0, 0, 0, 1), (110, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (35, 0.6, 3, 1.0, 4, 1.0, 0, 0, 0, 0), (3, 0.0, 3, 1.0, 3, 1.0, 0, 0, 0, 0),
    (5, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (50, 0.0, 4, 1.0, 30, 0.0, 0, 0, 1, 0), (8, 0.0, 50, 0.0, 0, 0.0, 0, 0, 1, 0), (120, 0.0, 80, 0.0, 60, 0.0, 0, 0, 1, 0),
    (30, 0.0, 6, 1.0, 12, 0.0, 1, 0, 0, 1), (10, 0.0, 15, 0.5, 4, 1.0, 1, 0, 0, 1), (6, 1.0, 4, 1.0, 5, 1.0, 1, 0, 0, 1), (18, 0.2, 20, 0.3, 25, 0.4, 1, 0, 0, 1),
    (2, 1.0, 2, 1.0, 0, 0.0, 1, 0, 0, 1), (7, 0.8, 9, 0.9, 3, 0.0, 1, 0, 0, 1), (1, 0.0, 1, 1.0, 2, 1.0, 1, 0, 0, 1), (100, 0.0, 0, 0.0, 90, 0.0, 0, 1, 0, 0),
    (70, 0.0, 65, 0.0, 14, 0.0, 0, 1, 0, 0), (25, 0.0, 4, 1.0, 70, 0.0, 0, 1, 0, 0), (4, 0.0, 70, 0.0, 65, 0.0, 0, 0, 0, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (18, 0.9, 50, 0.0, 20, 0.9, 0, 0, 0, 0), (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (1, 0.0, 2, 1.0, 60, 0.0, 0, 0, 0, 1), (4, 0.0, 3, 1.0, 40, 0.0, 0, 0, 0, 1), (6, 0.0, 1, 1.0, 200, 0.0, 0, 0, 0, 1), (2, 0.0, 4, 1.0, 5, 1.0, 0, 0, 0, 0),
    (2, 0.0, 5, 1.0, 1, 1.0, 0, 0, 0, 0), (3, 0.0, 6, 1.0, 2, 1.0, 0, 0, 0, 0), (200, 0.0, 2, 0.0, 2, 1.0, 0, 0, 0, 1), (90, 0.02, 40, 0.0, 1, 1.0, 0, 0, 0, 1),
    (60, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 1), (35, 0.1, 1, 0.0, 6, 1.0, 0, 0, 0, 1), (3, 0.0, 200, 0.0, 2, 1.0, 0, 0, 0, 1), (5, 0.0, 60, 0.0, 3, 1.0, 0, 0, 0, 1),
    (2, 0.0, 45, 0.0, 1, 1.0, 0, 0, 0, 1), (12, 0.0, 90, 0.1, 2, 1.0, 0, 0, 0, 1), (120, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 1), (25, 0.0, 30, 0.0, 2, 1.0, 0, 0, 0, 1),
    (2, 1.0, 60, 0.0, 3, 1.0, 0, 0, 0, 0), (3, 1.0, 5, 0.0, 2, 1.0, 0, 0, 0, 0), (4, 1.0, 90, 0.0, 0, 0.0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0),
    (1, 1.0, 200, 0.0, 1, 1.0, 0, 0, 0, 0), (8, 1.0, 30, 0.0, 4, 1.0, 0, 0, 0, 0), (5, 0.8, 12, 0.0, 6, 0.9, 0, 0, 0, 0), (12, 0.9, 40, 0.0, 30, 0.0, 0, 0, 0, 0),
    (2, 0.0, 2, 1.0, 3, 1.0, 1, 0, 0, 1), (4, 0.0, 3, 1.0, 0, 0.0, 1, 0, 0, 1), (3, 0.0, 1, 1.0, 2, 0.0, 1, 0, 0, 1), (9, 1.0, 3, 0.0, 4, 0.0, 1, 0, 0, 1),
]


@dataclass
class Node:
    """A leaf has ``content``; any other node sends values up to ``limit`` left."""

    feature: int = -1
    limit: float = 0.0
    left: Node | None = None
    right: Node | None = None
    content: bool = False

    def decide(self, row: tuple) -> bool:
        node = self
        while node.left is not None:
            node = node.left if row[node.feature] <= node.limit else node.right
        return node.content


def impurity(rows: list[tuple]) -> float:
    share = sum(r[-1] for r in rows) / len(rows)
    return 2 * share * (1 - share) * len(rows)


def grow(rows: list[tuple], depth: int = 8) -> Node:
    """Decision tree by the split that lowers the Gini impurity most; the first feature wins a tie."""
    positives = sum(r[-1] for r in rows)
    if not depth or positives in (0, len(rows)):
        return Node(content=2 * positives >= len(rows))
    best = None
    for f in range(len(rows[0]) - 1):
        seen = sorted({r[f] for r in rows})
        for low, high in zip(seen, seen[1:]):
            limit = (low + high) / 2
            parts = [r for r in rows if r[f] <= limit], [r for r in rows if r[f] > limit]
            left = sum(map(impurity, parts))
            if best is None or left < best[0] - 1e-9:
                best = (left, f, limit, parts)
    if best is None:
        return Node(content=2 * positives >= len(rows))
    _, f, limit, parts = best
    return Node(f, limit, *[grow(part, depth - 1) for part in parts])


@lru_cache(1)
def trained() -> Node:
    return grow(LABELLED)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    inside: bool
    unseen: bool
    hints: tuple  # tags and attributes of the marks it stands under, the outermost first
    remarks: tuple

    @property
    def links(self) -> float:
        return self.linked / self.words

    @property
    def dense(self) -> bool:
        """Long, and few of its words linked."""
        return self.words >= LONG and 3 * self.linked <= self.words

    def outermost(self, lifted: set) -> tuple | None:
        """The outermost mark of readers' comments, else of another kind, that is not lifted."""
        named = (("remark", self.remarks), ("hint", self.hints))
        return next(((name, kind) for kind, names in named for name in names if name not in lifted), None)


def marks(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """Whether the element is no part of an article, whether it holds readers' comments, and whether it is unseen."""
    hint, remark, unseen = tag in ASIDE, False, False
    if attrs and tag not in ("body", "html"):
        for name, value in NAMED.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                unseen = True  # wherever it stands
            elif name in ("class", "id", "role"):
                parts = {p.lower() for p in PART.findall(value)}
                hint |= bool(parts & set(HINTS)) and tag not in CONTENT
                remark |= bool(parts & set(REMARKS))
    return hint, remark, unseen


def blocks(page: str) -> tuple[list[Block], list[tuple]]:
    """The text blocks in page order, and the marks that each article element stands under."""
    out: list[Block] = []
    stack: list[tuple] = []  # open elements: name, inside, unseen, hints, remarks
    opened: Counter[str] = Counter()
    inside = unseen = False
    hints: tuple = ()
    remarks: tuple = ()
    articles: list[tuple] = []
    parts: list[tuple[str, bool]] = []
    links, at = 0, 0

    def close() -> None:
        if parts:
            words = [(len(html.unescape(t).split()), linked) for t, linked in parts]
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                total = sum(n for n, _ in words) or 1
                out.append(Block(text, total, sum(n for n, linked in words if linked), inside, unseen, hints, remarks))
            parts.clear()

    while at < len(page):
        m = MARKUP.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            parts.append((piece, links > 0))
        if m is None:
            break
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        ending = bool(m["end"])
        if tag in SILENT:
            if not ending and not m["attrs"].endswith("/"):
                done = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = done.end() if done else len(page)
            if tag == "title":
                close()
            continue
        if tag == "a":
            links = 0 if ending else 1
        if tag in ("br", "img", "input", "wbr"):
            if tag == "br":
                parts.append((" ", False))
            continue
        if tag in INLINE:
            inner = (False, False, False) if ending else marks(tag, m["attrs"])
            if not any(inner) and not (ending and opened[tag]):
                continue
        close()
        if tag not in INLINE:
            links = 0
        if tag in EMPTY:
            continue
        if not ending:
            hint, remark, hide = marks(tag, m["attrs"])
            stack.append((tag, inside, unseen, hints, remarks))
            opened[tag] += 1
            unseen, name = unseen or hide, (tag, m["attrs"])
            if remark and name not in remarks:
                remarks = (*remarks, name)
            if tag in CONTENT:
                inside = True
                if not unseen:
                    articles.append((*hints, *remarks))
            elif hint and name not in hints and not (inside and tag == "header"):
                hints = (*hints, name)
        elif opened[tag]:
            while True:
                name, inside, unseen, hints, remarks = stack.pop()
                opened[name] -= 1
                if name == tag:
                    break
    close()
    return out, articles


def kept(found: list[Block], articles: list[tuple], lifted: set) -> list[Block]:
    tree, out = trained(), []
    article = any(lifted.issuperset(names) for names in articles)
    if article:
        weigh = [0, 0]
        for b in found:
            if b.dense and not b.unseen and b.outermost(lifted) is None:
                weigh[b.inside] += b.words
        article = weigh[1] >= weigh[0]
    for i, b in enumerate(found):
        before = found[i - 1] if i else None
        after = found[i + 1] if i + 1 < len(found) else None
        row = (
            b.words, b.links, before.words if before else 0, before.links if before else 0.0, after.words if after else 0, after.links if after else 0.0,
            int(article and b.inside), int(article and not b.inside), int(b.unseen or b.outermost(lifted) is not None),
        )
        if tree.decide(row):
            out.append(b)
    return out


def main_text(page: str | None) -> str:
    found, articles = blocks(page or "")
    lifted: set = set()
    dense = [b for b in found if b.dense and not b.unseen]
    while True:
        out = kept(found, articles, lifted)
        weights: Counter = Counter()
        for b in dense:
            if mark := b.outermost(lifted):
                weights[mark] += b.words
        size, long = sum(b.words - b.linked for b in out), any(b.dense for b in out)
        heavy = [(n, mark) for mark, n in weights.items() if not long or mark[1] == "hint" and n > OUTWEIGH * size]
        if not heavy:
            return "\n\n".join(b.text for b in out)
        # of equal weights the mark that comes first on the page; comments last
        lifted.add(max(heavy, key=lambda x: (x[1][1] == "hint", x[0]))[1][0])


def extract(pages: DataFrame, source: str = "html", into: str = "text") -> DataFrame:
    """All columns but the page itself, and its main text."""
    rest = [c for c in without(pages, into).columns if c != source]
    schema = T.StructType([*[pages.schema[c] for c in rest], T.StructField(into, T.StringType())])

    def work(piece: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([main_text(x) for x in piece.column(source).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*[piece.column(c) for c in rest], texts], names=[*rest, into])

    return arrow_map(pages.select(*rest, source), work, schema, source)


@query("op10_html_text")
def op10(spark, sf_dir):
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
