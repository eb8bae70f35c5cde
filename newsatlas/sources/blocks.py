"""Blocks of an article body as Markdown.

The body is walked once. Paragraphs, headings, list items, quotes, preformatted text and tables become blocks, parted by
an empty line; items of one list stand on neighbouring lines. Marks inside a block are dropped, links are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from newsatlas.sources.html import Node

INDENT = "    "
HEADINGS = {f"h{i}": i for i in range(1, 7)}
PARTING = {
    "address", "article", "aside", "blockquote", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "header", "hr", "main", "nav", "p", "section", "summary", "ul", "ol", "li", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "pre", *HEADINGS,
}


@dataclass
class Level:
    """A list that is open: its kind, the number of its last item, and whether the item's marker is still to come."""

    ordered: bool
    number: int = 0
    fresh: bool = False


@dataclass
class Table:
    rows: list[list[str]] = field(default_factory=list)
    cell: list[str] | None = None

    def text(self) -> str:
        rows = [r for r in self.rows if r]
        width = max(map(len, rows), default=0)
        if not any(any(r) for r in rows):
            return ""
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])


def flow(pieces: list[str | None]) -> str:
    """Running text with single blanks; a piece of None is a line break that was asked for."""
    lines: list[list[str]] = [[]]
    for piece in pieces:
        if piece is None:
            lines.append([])
        else:
            lines[-1].append(piece)
    joined = [" ".join("".join(line).split()) for line in lines]
    return "\n".join(x for x in joined if x)


class Renderer:
    def __init__(self):
        self.blocks: list[tuple[str, int, bool]] = []  # text, the number of the outermost list around it or 0, whether it begins an item
        self.pieces: list[str | None] = []
        self.levels: list[Level] = []
        self.lists = 0
        self.quotes = 0
        self.heading = 0
        self.links: list[tuple[int, str]] = []
        self.tables: list[Table] = []
        self.raw = 0

    def flush(self) -> None:
        """The text gathered so far becomes a block."""
        if self.raw:
            return
        text, self.pieces, self.links = flow(self.pieces), [], [(0, url) for _, url in self.links]
        if text:
            self.block("#" * self.heading + " " + text if self.heading else text)

    def block(self, text: str) -> None:
        if self.tables:
            table = self.tables[-1]
            if table.cell is not None:
                table.cell.append(" ".join(text.split()))
                return
        first = rest = INDENT * len(self.levels)
        begins = False
        if self.levels:
            level = self.levels[-1]
            begins = level.fresh
            if begins:
                first = INDENT * (len(self.levels) - 1) + (f"{level.number}. " if level.ordered else "- ")
                level.fresh = False
        lines = text.split("\n")
        text = "\n".join([first + lines[0], *[rest + x for x in lines[1:]]])
        if self.quotes:
            mark = "> " * self.quotes
            text = "\n".join(mark + x for x in text.split("\n"))
        self.blocks.append((text, self.lists if self.levels else 0, begins))

    def enter(self, node: Node) -> None:
        tag = node.tag
        if tag in PARTING:
            self.flush()
        if tag == "br":
            self.pieces.append(None)
        elif tag in HEADINGS:
            self.heading = HEADINGS[tag]
        elif tag in ("ul", "ol"):
            if not self.levels:
                self.lists += 1
            start = node.attrs.get("start") or ""
            self.levels.append(Level(tag == "ol", int(start) - 1 if start.isdecimal() else 0))
        elif tag == "li" and self.levels:
            self.levels[-1].number += 1
            self.levels[-1].fresh = True
        elif tag == "blockquote":
            self.quotes += 1
        elif tag == "pre":
            self.raw += 1
        elif tag == "a":
            self.links.append((len(self.pieces), node.attrs.get("href") or ""))
        elif tag == "table":
            self.tables.append(Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag in ("td", "th") and self.tables:
            self.tables[-1].cell = []

    def leave(self, node: Node) -> None:
        tag = node.tag
        if tag == "a":
            self.close_link()
        if tag == "pre":
            self.raw -= 1
            if not self.raw:
                text, self.pieces = "".join("\n" if p is None else p for p in self.pieces).strip("\n"), []
                if text.strip():
                    self.block(f"```\n{text}\n```")
        elif tag in PARTING:
            self.flush()
        if tag in HEADINGS:
            self.heading = 0
        elif tag in ("ul", "ol") and self.levels:
            self.levels.pop()
        elif tag == "blockquote":
            self.quotes -= 1
        elif tag in ("td", "th") and self.tables and self.tables[-1].cell is not None:
            table = self.tables[-1]
            if not table.rows:
                table.rows.append([])
            table.rows[-1].append(" ".join(table.cell).replace("|", "\\|"))
            table.cell = None
        elif tag == "table" and self.tables:
            text = self.tables.pop().text()
            if text:
                self.block(text)

    def close_link(self) -> None:
        start, url = self.links.pop()
        own = self.pieces[start:]
        inside = " ".join(flow(own).split("\n"))
        if inside and url and not self.raw:
            whole = "".join(p or " " for p in own)
            before, after = (" " if c.isspace() else "" for c in (whole[0], whole[-1]))
            self.pieces[start:] = [f"{before}[{inside}]({url}){after}"]

    def text(self) -> str | None:
        self.flush()
        out: list[str] = []
        before = 0
        for text, of, begins in self.blocks:
            if out:
                out.append("\n" if begins and of == before else "\n\n")
            out.append(text)
            before = of
        return "".join(out) or None


def steps(top: Node, drop: tuple[str, ...]) -> Iterator[tuple[str, object]]:
    """("in", node), ("text", string), ("out", node) in the order of the page, without a call per level."""
    stack: list[tuple[str, object]] = [("in", top)]
    while stack:
        what, here = stack.pop()
        yield what, here
        if what == "in":
            stack.append(("out", here))
            for item in reversed(here.items):
                if isinstance(item, str):
                    stack.append(("text", item))
                elif not any(item.fits(d) for d in drop):
                    stack.append(("in", item))


def markdown(node: Node | None, drop: tuple[str, ...] = ()) -> str | None:
    """Blocks of a node, without the dropped ones; null if there is no text."""
    if node is None:
        return None
    out = Renderer()
    for what, here in steps(node, drop):
        if what == "text":
            out.pieces.append(here)
        elif what == "in":
            out.enter(here)
        else:
            out.leave(here)
    return out.text()
