"""Fields of listing and article pages.

Spark partitions the pages; inside a task each page is walked once with the standard parser. A page
that does not hold the required nodes becomes an error row, so no exception leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newsatlas.functions import dates, links, text
from newsatlas.sources.blocks import PARTING, markdown

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Start tags that end an open node: its tags, and the tags beyond which nothing is ended.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
}


@dataclass
class ArticleRules:
    """Where the fields of an article are: selectors of the form tag, .class, #id or tag.class."""

    container: str = "#content article"
    body: str = "#content-core, .content-core"
    title: str = "h1.documentFirstHeading"
    section: str = "p.section"
    category: str = "p.nitfSubtitle"
    subtitle: str = ".documentDescription"
    dates: str = "#viewlet-above-content-body, .viewlet-above-content-body"
    tags: str = "#content > div.column a"
    drop: tuple[str, ...] = ("script", "style", "noscript", ".documentActions", ".visualClear")


@dataclass
class ListingRules:
    item: str = "article.tileItem"
    title: str = "h2.tileHeadline a"
    category: str = ".subtitle"
    summary: str = "p.tileBody"
    byline: str = ".documentByLine"
    tags: str = ".keywords a"


@dataclass
class Node:
    tag: str
    attrs: dict
    parent: "Node | None"
    items: list = field(default_factory=list)

    def fits(self, step: str) -> bool:
        tag, _, rest = step.partition("#")
        name, _, css = tag.partition(".")
        return (
            (not name or name == self.tag)
            and (not rest or rest == self.attrs.get("id"))
            and (not css or css in (self.attrs.get("class") or "").split())
        )


class PageTree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("", {}, None)
        self.feed(html)
        self.close()

    def end_open(self, tags: set[str], within: set[str]) -> None:
        """Ends the innermost open node of these tags, unless one of ``within`` is nearer."""
        node = self.top
        while node.parent is not None and node.tag not in tags:
            if node.tag in within:
                return
            node = node.parent
        if node.parent is not None:
            self.top = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in PARTING:  # an open paragraph ends where the next block starts
            self.end_open({"p"}, PARTING - {"p"})
        if tag in IMPLIED:
            self.end_open(*IMPLIED[tag])
        node = Node(tag, dict(attrs), self.top)
        self.top.items.append(node)
        if tag not in VOID:
            self.top = node

    def handle_endtag(self, tag):
        node = self.top
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.top = node.parent

    def handle_data(self, data):
        self.top.items.append(data)


def walk(node: Node) -> Iterator[Node]:
    stack = [i for i in reversed(node.items) if isinstance(i, Node)]
    while stack:
        here = stack.pop()
        yield here
        stack.extend(i for i in reversed(here.items) if isinstance(i, Node))


def matches(node: Node | None, steps: list[str]) -> bool:
    """Whether a node and its ancestors satisfy selector steps, read from the right."""
    if node is None or not node.fits(steps[-1]):
        return False
    if len(steps) == 1:
        return True
    if steps[-2] == ">":
        return matches(node.parent, steps[:-2])
    above = node.parent
    while above is not None:
        if matches(above, steps[:-1]):
            return True
        above = above.parent
    return False


def find_all(node: Node, selectors: str) -> list[Node]:
    options = [s.replace(">", " > ").split() for s in selectors.split(",") if s.strip()]
    return [n for n in walk(node) if any(matches(n, steps) for steps in options)]


def words(node: Node | None, drop: tuple[str, ...] = ()) -> str | None:
    """Text of a node, pieces joined by one blank."""
    if node is None:
        return None
    parts, stack = [], [node]
    while stack:
        here = stack.pop()
        if isinstance(here, str):
            parts.extend(here.split())
        elif here is node or not any(here.fits(d) for d in drop):
            stack.extend(reversed(here.items))
    return " ".join(parts) or None


def _article(html: str | None, rules: ArticleRules) -> dict:
    page = PageTree(html or "").root
    one = lambda scope, selector: next(iter(find_all(scope, selector)), None)
    box = one(page, rules.container)
    if box is None:
        raise ValueError(f"no '{rules.container}' in the page")
    core = one(box, rules.body) if rules.body else box
    if core is None:
        raise ValueError(f"no '{rules.body}' in the page")
    title = one(box, rules.title)
    if title is None:
        raise ValueError(f"no '{rules.title}' in the page")
    return {
        "section": words(one(box, rules.section)),
        "category": words(one(box, rules.category)),
        "title": words(title) or "",
        "subtitle": words(one(box, rules.subtitle)),
        "dates": words(one(box, rules.dates)),
        "tags": [t for t in (words(n) for n in find_all(page, rules.tags)) if t],
        "body": markdown(core, rules.drop),
        "error": None,
    }


def extract_articles(pages: DataFrame, rules: ArticleRules = ArticleRules(), key: str = "url") -> DataFrame:
    """(key, article fields, error) for every page; ``html`` is read whole."""
    raw = "section STRING, category STRING, title STRING, subtitle STRING, dates STRING, tags ARRAY<STRING>, body STRING, error STRING"
    blank = {"section": None, "category": None, "title": None, "subtitle": None, "dates": None, "tags": None, "body": None}
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, html in zip(batch[key], batch["html"]):
                try:
                    rows.append({key: k, **_article(html, rules)})
                except Exception as exc:  # noqa: BLE001 - the failure is data
                    rows.append({key: k, **blank, "error": str(exc)})
            yield pd.DataFrame(rows, columns=[key, *blank, "error"])

    found = pages.select(key, "html").mapInPandas(run, f"`{key}` {kind}, {raw}")
    stamp = dates.parse_article_dates("dates")
    return found.select(
        key, "section", "category", "title", "subtitle",
        stamp["published_at"].alias("published_at"), stamp["updated_at"].alias("updated_at"),
        "tags", "body", "error",
    )


def article_text(articles: DataFrame) -> DataFrame:
    """Canonical document of each extracted article: header lines, then the blocks of the body."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", ")))
    document = F.concat_ws(
        "\n\n",
        F.nullif("section", F.lit("")), F.nullif("category", F.lit("")),
        F.concat(F.lit("# "), F.col("title")), F.nullif("subtitle", F.lit("")),
        F.concat(F.lit("Publicado em "), F.col("published_at")),
        F.concat(F.lit("Atualizado em "), F.col("updated_at")),
        tags, F.col("body"),
    )
    return articles.where(F.col("error").isNull()).withColumn("markdown_text", document)


def extract_listing(pages: DataFrame, rules: ListingRules = ListingRules(), step: int = 60) -> DataFrame:
    """One index row per listing item; needs columns ``offset`` and ``html``.

    A page that cannot be read gives one row with its offset and ``error``, and no other page is lost.
    """
    raw = (
        "offset INT, item_index INT, categoria STRING, titulo STRING, subtitulo STRING, byline STRING, "
        "tag_list ARRAY<STRING>, link STRING, error STRING"
    )
    names = [c.split()[0] for c in raw.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for offset, html in zip(batch["offset"], batch["html"]):
                rows = []
                try:
                    page = PageTree(html or "").root
                    for pos, item in enumerate(find_all(page, rules.item), start=1):
                        one = lambda selector: next(iter(find_all(item, selector)), None)
                        head = one(rules.title)
                        tags = [t for t in (words(n) for n in find_all(item, rules.tags)) if t]
                        rows.append(
                            (offset, pos, words(one(rules.category)), words(head), words(one(rules.summary)),
                             words(one(rules.byline)), tags, head.attrs.get("href") if head else None, None)
                        )
                except Exception as exc:  # noqa: BLE001 - the failure is data
                    rows = [(offset, None, None, None, None, None, None, None, str(exc))]
                yield pd.DataFrame(rows, columns=names)

    items = pages.select(F.col("offset").cast("int"), "html").mapInPandas(run, raw)
    stamp = dates.parse_byline("byline")
    return items.select(
        "offset", links.page_number("offset", step).alias("page_number"), "item_index", "categoria", "titulo",
        "subtitulo", stamp["data_publicacao"].alias("data_publicacao"),
        stamp["hora_publicacao"].alias("hora_publicacao"), stamp["publicado_em"].alias("publicado_em"),
        dates.content_type("byline").alias("tipo_conteudo"), text.pack_list("tag_list").alias("tags"),
        F.coalesce(F.size("tag_list"), F.lit(0)).alias("total_tags"), "link", "error",
    )
