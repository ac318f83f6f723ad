"""Table-valued page extraction (E1-E8) on the standard library's parser, as ``mapInPandas`` over pages.

One extractor is a rule as data: where to look (the first container that exists), which tags, how long a text must be, where
it is cut, by how many characters duplicates are told, how text nodes are joined.  Python parses a page once; lengths, cuts,
duplicates and limits are plain list work on one page's items, so no page's items need a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {
    "p": ("p", frozenset()), "li": ("li", frozenset(("ul", "ol"))), "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table"))),
    "tr": ("tr", frozenset(("table",))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))), "option": ("option", frozenset(("select",))),
}
#: A start tag of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What holds in any open paragraph or cell: outside of these an implied end doesn't reach.
SCOPES = frozenset("table td th button".split())
LONG_NUMBER = re.compile("&#([0-9]{4301,})")


def feed(parser: HTMLParser, html: str) -> None:
    """Feed a whole page.

    Behind the last ``>`` no tag can end, so what stands there is text up to an unclosed comment; the parser would look for
    an end from each ``<`` again.  Of a number with more digits than Python reads, the first that count are enough: no character has that number.
    """
    html = LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), html)
    last = html.rfind(">") + 1
    parser.feed(html[:last])
    parser.feed(html[last:].partition("<!--")[0].replace("<", "&lt;"))
    parser.close()


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def all(self, *tags: str) -> Iterator[Node]:
        """Descendants with one of the tags, in page order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    if child.tag in tags:
                        yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self, sep: str = "") -> str:
        """The stripped text nodes, without empty ones, joined; scripts and styles aren't text."""
        out, stack = [], [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    if child.strip():
                        out.append(child.strip())
                elif child.tag not in ("script", "style", "template"):
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()
        return sep.join(out)


class Tree(HTMLParser):
    """A page's elements; implied ends of p, li, cells and rows are filled in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # where in ``open`` the elements of a tag are
        self.stops: list[int] = []  # and those that no implied end of a paragraph reaches beyond

    def parse_html_declaration(self, i):
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def handle_starttag(self, tag, attrs):
        names, bounds = ENDS.get(tag, ("", frozenset()))
        place = self.last([*names.split(), *["p"] * (tag in ENDS_P)])
        # An open paragraph holds no block, so none is beyond the nearest block.
        if place and place >= (self.last(bounds) if bounds else self.stops[-1] if self.stops else 0):
            self.close_from(place)
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            if tag in SCOPES or tag in ENDS_P:
                self.stops.append(len(self.open))
            self.open.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags, 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close_from(self, place: int) -> None:
        while len(self.open) > place:
            self.places[self.open.pop().tag].pop()
        while self.stops and self.stops[-1] >= place:
            self.stops.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if place := self.last((tag,)):
            self.close_from(place)

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    tree = Tree()
    feed(tree, html or "")
    return tree.root


def container(root: Node, places: tuple[str, ...]) -> Node:
    """The first of the places that exists (``div#id``, ``div.class`` or a tag), else the page."""
    for place in places:
        tag, mark, name = place.partition("#") if "#" in place else place.partition(".")
        for node in root.all(tag):
            if not mark or (mark == "#" and node.attrs.get("id") == name) or (mark == "." and name in node.attrs.get("class", "").split()):
                return node
    return root


def first_link(node: Node) -> str:
    """The href of the element itself or of its first link, else empty."""
    if node.tag == "a":
        return node.attrs.get("href", "")
    a = next(node.all("a"), None)
    return a.attrs.get("href", "") if a else ""


@dataclass(frozen=True)
class Blocks:
    """Text blocks with a link.  ``over``: shorter texts (as they are before the cut) go; ``same``: duplicates by that many characters go."""

    places: tuple[str, ...]
    tags: tuple[str, ...]
    over: int
    cut: int | None = None
    same: int | None = None
    sep: str = " "
    rows: bool = False  # take table rows instead if the container has a table

    def items(self, root: Node) -> list[tuple[str, str]]:
        at, found, seen = container(root, self.places), [], set()
        table = next(at.all("table"), None) if self.rows else None
        if table:
            texts = []
            for row in list(table.all("tr"))[1:]:
                cells = [c.text() for c in row.all("td")][:4]
                texts.append((row, " | ".join(cells)))
            texts = [(n, t) for n, t in texts if t.strip()]
        else:
            texts = [(n, t) for n in at.all(*self.tags) if len(t := n.text(self.sep)) > self.over]
        for node, text in texts:
            text = text[: self.cut]
            if self.same is not None:
                if text[: self.same] in seen:
                    continue
                seen.add(text[: self.same])
            found.append((text, first_link(node)))
        return found


# Containers, tags, lengths and cuts of the monitored sites' pages.
NEWS = Blocks(("div#main", "div.main"), ("p", "li"), 20, sep="")
LINKS = Blocks(("div#main",), ("a",), 0, sep="")
PANE = Blocks(("div#ContentPane", "main", "div.field-items"), ("p", "li", "h2", "h3", "h4"), 15, 400, 80)
MAIN = Blocks(("div#main", "div#content", "main"), ("p", "li", "h2", "h3", "h4", "td"), 10, 500, 120)
ROWS = Blocks(("div#main-content", "main", "div.container"), ("h2", "h3", "h4", "p", "li", "td"), 20, 400, 120, rows=True)


def table_rows(root: Node, links: bool = True) -> list[list[tuple[str, str]]]:
    """The first table's rows as (header, cell) pairs; with ``links`` a last pair ``_link``."""
    table = next(root.all("table"), None)
    if table is None:
        return []
    rows = list(table.all("tr"))
    headers = [c.text() for c in rows[0].all("th", "td")] if rows else []
    out = []
    for row in rows[1:]:
        cells = list(row.all("td"))
        if cells:
            pairs = dict(zip(headers, (c.text() for c in cells), strict=False))
            if links:
                pairs["_link"] = first_link(row)
            out.append(list(pairs.items()))
    return out


def post_items(root: Node, most: int = 20) -> list[tuple[str, str, str]]:
    """E5: (title, link, id) of headings and articles with a titled link; the id is the title only if there is no href."""
    out = []
    for node in root.all("h2", "h3", "h4", "article"):
        a = next(node.all("a"), None)
        if a is not None and (title := a.text()):
            out.append((title, a.attrs.get("href", ""), a.attrs.get("href", title)))
        if len(out) == most:
            break
    return out


def _rows(pages: DataFrame, key: str, html: str, schema: str, make) -> DataFrame:
    columns = [c.split(" ")[0] for c in ("key string, pos int, " + schema).replace("array<struct<name: string, value: string>>", "array").split(", ")]

    def run(parts):
        for part in parts:
            rows = [(k, i, *row) for k, h in zip(part["key"], part["html"], strict=True) for i, row in enumerate(make(parse(h)))]
            yield pd.DataFrame(rows, columns=columns)

    return pages.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html")).mapInPandas(run, f"key string, pos int, {schema}")


def blocks(pages: DataFrame, rule: Blocks, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, text, href)."""
    return _rows(pages, key, html, "text string, href string", rule.items)


def tables(pages: DataFrame, links: bool = True, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, cells)."""
    return _rows(pages, key, html, "cells array<struct<name: string, value: string>>", lambda root: [([{"name": n, "value": v} for n, v in r],) for r in table_rows(root, links)])


def posts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """E5: (key, pos, title, link, published, id)."""
    return _rows(pages, key, html, "title string, link string, published string, id string", lambda root: [(t, link, "", i) for t, link, i in post_items(root)])
