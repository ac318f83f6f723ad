"""Feeds, sound or not (S3): RSS 0.9x, 1.0 and 2.0 and Atom.

Sound feeds are read by Spark's XML expressions.  A body from which these get no item goes to an event reader that takes what can be
read: bare ampersands, white space or junk before the prolog, unclosed elements, a text cut off anywhere (an item that has begun counts),
names with any prefix.  A feed without items that isn't well-formed has failed, as one that couldn't be fetched; an empty
but sound one has not.  Of an Atom entry's links the first ``alternate`` one counts (no ``rel`` means that), else the first.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import default

ITEM = "title: string, description: string, summary: string, pubDate: string, published: string, updated: string, guid: struct<_VALUE: string>, id: string"
LINK = "struct<_VALUE: string, _href: string, _rel: string>"
FIELDS = "title string, link string, summary string, published string, id string"
#: Characters of texts whose items a worker holds.
SLICE = 1 << 20
#: What a feed's elements are called, without prefixes: fixed values.
ITEMS = {"item", "entry"}
READ = {"title", "link", "description", "summary", "content", "encoded", "pubdate", "published", "updated", "date", "guid", "id"}
#: Elements that may hold markup, and those that end them all the same if their own end is missing.
MARKUP = {"description", "summary", "content", "encoded"}
AFTER_MARKUP = {"link", "guid", "id", "pubdate", "published", "updated"}
TOKEN = re.compile(r"<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|<\?.*?(?:\?>|\Z)|<![^>]*>|<(?P<end>/?)(?P<name>[A-Za-z_][\w:.-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<alone>/?)>|(?P<text>[^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def events(text: str) -> Iterator[tuple[str, str, dict]]:
    """("start", name, attributes), ("end", name, {}) and ("text", text, {}) of any text, names in lower case without prefixes."""
    for m in TOKEN.finditer(text):
        if m["name"]:
            name = m["name"].rsplit(":", 1)[-1].lower()
            if not m["end"]:
                yield "start", name, {k.rsplit(":", 1)[-1].lower(): html.unescape(a or b) for k, a, b in ATTRIBUTE.findall(m["attrs"])}
            if m["end"] or m["alone"]:
                yield "end", name, {}
        elif m["cdata"] is not None:
            yield "text", m["cdata"], {}
        elif m["text"] is not None:
            yield "text", html.unescape(m["text"]), {}


def recovered(text: str) -> list[tuple[str, str, str, str, str]]:
    """(title, link, summary, published, id) of the items that can be read."""
    out, item, field, links, parts = [], None, "", [], []

    def finish() -> None:
        first = lambda *names: next((item[n].strip() for n in names if item.get(n, "").strip()), "")
        href = next((x["href"] for x in links if x.get("rel", "alternate") == "alternate"), links[0]["href"] if links else "")
        link = first("link") or href
        out.append((first("title"), link, first("summary", "description", "content", "encoded"), first("published", "pubdate", "date", "updated"), first("id", "guid") or link))

    def close() -> None:
        nonlocal field
        if field and field not in item:
            item[field] = "".join(parts)
        field = ""
        parts.clear()

    for kind, name, attrs in events(text):
        if kind == "start" and name in ITEMS:
            if item is not None:  # the one before has no end
                close()
                finish()
            item, links, field = {}, [], ""
            parts.clear()
        elif item is None:
            continue
        elif kind == "start" and name in (AFTER_MARKUP if field in MARKUP else READ):
            close()
            field = name
            if name == "link" and attrs.get("href"):
                links.append(attrs)
        elif kind == "end" and name in ITEMS:
            close()
            finish()
            item = None
        elif kind == "end" and name == field:
            close()
        elif kind == "text" and field:
            parts.append(name)
    if item is not None:
        close()
        if any(v.strip() for v in item.values()) or links:
            finish()
    return out


def well_formed(text: str) -> bool:
    try:
        ElementTree.fromstring(text)
        return True
    except (ElementTree.ParseError, ValueError):
        return False


def strict(text: str) -> Column:
    """The items that Spark's XML expressions find: array of (title, link, summary, published, id); null for none."""
    rss = F.from_xml(F.col(text), f"channel struct<item: array<struct<link: string, {ITEM}>>>", {"rowTag": "rss"})["channel"]["item"]
    atom = F.from_xml(F.col(text), f"entry array<struct<link: array<{LINK}>, {ITEM}>>", {"rowTag": "feed"})["entry"]
    published = lambda e: F.coalesce(e["published"], e["pubDate"], e["updated"], F.lit(""))

    def row(e: Column, link: Column) -> Column:
        value = (default(e["title"]), default(link), F.coalesce(e["summary"], e["description"], F.lit("")), published(e), F.coalesce(e["id"], e["guid"]["_VALUE"], link, F.lit("")))
        return F.struct(*(v.alias(n) for v, n in zip(value, ("title", "link", "summary", "published", "id"))))

    alternate = lambda e: F.coalesce(F.get(F.filter(e["link"], lambda x: default(x["_rel"], "alternate") == "alternate"), F.lit(0))["_href"], F.get(e["link"], F.lit(0))["_href"])
    found = F.when(F.contains(text, F.lit("<rss")), F.transform(rss, lambda e: row(e, e["link"]))).otherwise(F.transform(atom, lambda e: row(e, alternate(e))))
    return F.when(F.size(found) > 0, found)


def recovered_rows(batches: Iterable[pa.RecordBatch], n: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`read_feeds` from ``n`` keys and a text; of a batch, about ``most`` bytes of texts and their items are objects at a time."""
    names, types = ["status", "pos", "title", "link", "summary", "published", "id"], [pa.string(), pa.int32(), *[pa.string()] * 5]
    for batch in batches:
        at, rows, size = [], [], 0
        for i, body in enumerate(batch.column(n)):
            body = body.as_py()
            items = recovered(body or "")
            status = "recovered" if items else "empty" if body and well_formed(body) else "failed"
            at += [i] * max(1, len(items))
            rows += [(status, p, *item) for p, item in enumerate(items)] or [(status, None, None, None, None, None, None)]
            size += len(body or "")
            if size >= most or i + 1 == batch.num_rows:
                place = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.take(place) for c in batch.columns[:n]), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=[*batch.schema.names[:n], *names])
                at, rows, size = [], [], 0


def read_feeds(bodies: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys..., status, pos, item fields) of feeds' texts: one row an item; one row without fields for a feed that has none.

    status: ``read``, ``recovered``, ``empty`` (sound, no items) or ``failed`` (not well-formed, no items; or no text).
    """
    kinds = {k: bodies.schema[k].dataType for k in keys}
    told = bodies.select(*keys, F.col(text).alias("__text"), strict(text).alias("__items"))
    fine = told.filter("__items IS NOT NULL").select(*keys, F.lit("read").alias("status"), F.posexplode("__items").alias("pos", "i")).select(*keys, "status", "pos", "i.*")
    n = len(keys)
    run = lambda batches: recovered_rows(batches, n)

    schema = ", ".join([*(f"`{k}` {t.simpleString()}" for k, t in kinds.items()), "status string, pos int", FIELDS])
    return fine.unionByName(told.filter("__items IS NULL").select(*keys, "__text").mapInArrow(run, schema))
