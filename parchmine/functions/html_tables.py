"""HTML tables as Markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

from pyspark.sql.types import StringType

from .text import column

TABLE = re.compile(r"<table\b[^>]*>.*?</table\s*>", re.I | re.S)
#: Most rows or columns that a cell spans.
MOST_SPAN = 100


class Cell(NamedTuple):
    text: str
    wide: int
    high: int
    head: bool


def _span(value: str | None) -> int:
    try:
        return min(MOST_SPAN, max(1, int(value or 1)))
    except ValueError:
        return 1


class _Rows(HTMLParser):
    """Rows of cells; rows without any text are left out."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[Cell]] = [[]]
        self.cell: tuple[str, dict] | None = None
        self.parts: list[str] = []
        self.feed(html)
        self.close()
        self.end_row()

    def end_cell(self):
        if self.cell:
            tag, attrs = self.cell
            self.rows[-1].append(Cell(" ".join("".join(self.parts).split()), _span(attrs.get("colspan")), _span(attrs.get("rowspan")), tag == "th"))
        self.cell, self.parts = None, []

    def end_row(self):
        self.end_cell()
        if any(c.text for c in self.rows[-1]):
            self.rows.append([])
        else:
            self.rows[-1] = []

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.end_row()
        elif tag in ("td", "th"):
            self.end_cell()
            self.cell = tag, dict(attrs)
        elif tag in ("br", "p", "div", "li"):
            self.parts.append(" ")
        elif tag == "img":
            found = {k: (v or "").strip() for k, v in attrs}
            self.parts.append(f"![{found.get('alt', '')}]({found['src']})" if found.get("src") else found.get("alt", ""))

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.end_cell()
        elif tag == "tr":
            self.end_row()
        elif tag in ("p", "div", "li"):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.cell:
            self.parts.append(data)


def grid_of(rows: list[list[Cell]]) -> list[list[str]]:
    """A rectangle of texts; a cell's text stands in the first place that it covers, and the others are empty."""
    grid: list[dict[int, str]] = [{} for _ in rows]
    for y, row in enumerate(rows):
        x = 0
        for cell in row:
            while x in grid[y]:
                x += 1
            for dy in range(min(cell.high, len(rows) - y)):
                for dx in range(cell.wide):
                    grid[y + dy].setdefault(x + dx, "")
            grid[y][x] = cell.text
            x += cell.wide
    width = max((max(g, default=-1) + 1 for g in grid), default=0)
    return [[g.get(x, "") for x in range(width)] for g in grid]


def table_markdown(html: str | None) -> str | None:
    """One table as Markdown; null if it has fewer than two columns.

    The header is the first row with a header cell, else the first with two texts and no wide cell, else the first.
    Single texts above it become bold lines, and rows of one wide cell below it bold cells.
    """
    rows = [r for r in _Rows(html or "").rows if r]
    grid = [[t.replace("|", "\\|") for t in row] for row in grid_of(rows)]
    if not grid or len(grid[0]) < 2:
        return None
    narrow = (i for i, r in enumerate(rows) if sum(map(bool, grid[i])) >= 2 and all(c.wide == 1 for c in r))
    head = next((i for i, r in enumerate(rows) if any(c.head for c in r)), next(narrow, 0))
    above = [f"**{t[0]}**" for row in grid[:head] if len(t := [x for x in row if x]) == 1]
    lines = [[t or f"Column {i}" for i, t in enumerate(grid[head], 1)], ["---"] * len(grid[0])]
    for i in range(head + 1, len(grid)):
        group = sum(map(bool, grid[i])) == 1 and any(c.wide > 1 for c in rows[i])
        lines.append([f"**{t}**" if t and group else t for t in grid[i]])
    return "\n\n".join([*above, "\n".join("| " + " | ".join(x) + " |" for x in lines)])


def with_markdown_tables(text: str | None) -> str | None:
    """The text with its HTML tables as Markdown; tables that can't be shown so stay."""
    return None if text is None else TABLE.sub(lambda m: table_markdown(m[0]) or m[0], text)


with_markdown_tables_of = column(with_markdown_tables, StringType())
