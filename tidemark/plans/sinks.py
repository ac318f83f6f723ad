"""Where results go: partitioned tables, JSON, feed, digest, pages, callbacks (K1-K6)."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import default, first_filled, xml_escape

# Wording and order of feed and digest.
#: Branches of the feed in order: (domain, collection, kind, title with {title}, {text} or {group}, description, link if none).
#: Description: None is the text; ``payload x`` is field x of the record; else as it stands.
FEED_BRANCHES = (
    ("niap", "pps", "added", "New PP: {title}", None, ""),
    ("niap", "pps", "removed", "Removed PP: {title}", None, ""),
    ("niap", "tds", "added", "New TD: {text}", "payload pp_short_name", "https://www.niap-ccevs.org/"),
    ("niap", "news", "added", "{title}", None, "https://www.niap-ccevs.org/"),
    ("cctl_labs", "feeds", "added", "[{group}] {title}", None, "#"),
    ("csfc", "documents", "header_changed", "CSfC CP Updated: {group}", "Capability package updated.", "https://www.nsa.gov/"),
    ("nist", "documents", "header_changed", "NIST Doc Updated: {group}", "Document header updated.", "https://csrc.nist.gov/"),
    ("cc_crypto", "documents", "header_changed", "CC Crypto Doc Updated: {group}", "Document header updated.", "https://www.commoncriteriaportal.org/"),
)
#: Digest lines in order: (section, domain, collection, kind, group or None, label, content, rows a group or None).
DIGEST = (
    ("Profiles", "niap", "pps", "added", None, "NEW", "title - text", None),
    ("Profiles", "niap", "pps", "removed", None, "REMOVED", "title", None),
    ("Profiles", "niap", "pps", "sunset_change", None, "SUNSET", "title - sunset", None),
    ("Decisions", "niap", "tds", "added", None, "NEW TD", "text - title", None),
    ("Decisions", "niap", "tds", "removed", None, "REMOVED", "text", None),
    ("Products", "niap", "cisco_ndcpp", "added", None, "CERTIFIED", "title (text)", None),
    ("Products", "niap", "cisco_ndcpp", "newly_archived", None, "ARCHIVED", "title", None),
    ("Products", "niap", "cisco_ndcpp", "removed", None, "REMOVED", "title", None),
    ("News", "niap", "news", "added", None, "category", "title", None),
    ("Labs", "cctl_labs", "feeds", "added", None, "group 18", "title", 5),
    ("Packages", "csfc", "documents", "header_changed", None, "CP UPDATE", "group: detail", None),
    ("Packages", "csfc", "pages", "added", None, "NSA:group 8", "text 120", 3),
    ("Packages", "csfc", "feeds", "added", None, "ADVISORY", "title", 3),
    ("Crypto catalog", "cc_crypto", "documents", "header_changed", None, "DOC UPDATE", "group", None),
    ("Crypto catalog", "cc_crypto", "pages", "added", None, "CC:group 8", "text 120", 3),
    ("Standards", "nist", "documents", "header_changed", None, "NIST DOC", "group", None),
    ("Standards", "nist", "feeds", "added", None, "NIST", "title", 5),
    ("Standards", "nist", "pages", "added", "cmvp_mip", "CMVP MIP", "text 120", 5),
)
NOTHING = "No changes detected this week."


def here(domain: str, collection: str, kind: str, group: str | None = None):
    found = (F.col("domain") == domain) & (F.col("collection") == collection) & (F.col("kind") == kind)
    return found & (F.col("group_key") == group) if group else found


def write_changes(changes: DataFrame, path: str) -> None:
    """K1: the change log by day; a day that is written again replaces itself only."""
    changes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


# What a merged log has of every domain, changed or not.
SKELETON = {
    "niap": {"pps": ("added", "removed", "sunset_change", "status_change"), "tds": ("added", "removed"), "cisco_ndcpp": ("added", "removed", "newly_archived"), "news": ("added",), "events": ("added",), "cctls": ("added", "removed", "status_change")},
    "cc_portal": {"news": ("added",), "pps": ("added",), "products": ("added",)},
    "cctl_labs": {},
    "csfc": {"feeds": (), "pages": (), "documents": ()},
    "cc_crypto": {"pages": (), "documents": ()},
    "nist": {"pages": (), "documents": (), "feeds": ()},
}


def skeleton() -> dict:
    """Every domain and collection, empty."""
    return {domain: {name: {kind: [] for kind in kinds} for name, kinds in collections.items()} for domain, collections in SKELETON.items()}


def weekly_json(changes: DataFrame, alert_rows: DataFrame, days: list[str], indent: int = 2) -> str:
    """A merged log with its period, all domains and the alerts."""
    period = {"period_start": days[0], "period_end": days[-1]} if days else {}
    told = [{"source": r.source, "kind": r.kind, "title": r.title, "matched_keywords": r.matched_keywords} for r in alert_rows.orderBy("run_date", "pos").toLocalIterator()]
    return json.dumps(period | json.loads(as_json(changes, base=skeleton())) | {"alerts": told}, indent=indent, default=str, ensure_ascii=False)


def as_json(changes: DataFrame, indent: int = 2, base: dict | None = None) -> str:
    """K1: one day's log as nested JSON, for export; a day's log is small."""
    out: dict = {} if base is None else base
    for r in changes.orderBy("domain", "collection", "group_key", "kind", "pos", "entity_key").toLocalIterator():
        place = out.setdefault(r.domain, {}).setdefault(r.collection, {})
        place = place.setdefault(r.group_key, {}) if r.group_key is not None else place
        place.setdefault(r.kind, []).append(json.loads(r.payload) if r.payload else {"text": r.text})
    return json.dumps(out, indent=indent, default=str, ensure_ascii=False)


def rss_items(changes: DataFrame, branches=FEED_BRANCHES, alert_rows: DataFrame | None = None, alert_link: str = "#") -> DataFrame:
    """K3: (ord, pos, item) of the feed; alerts carry their title and terms."""
    row = None
    for i, (domain, collection, kind, title, said, link) in enumerate(branches):
        parts = [default("title") if p == "{title}" else default("group_key") if p == "{group}" else default("text") if p == "{text}" else F.lit(p) for p in re.split(r"(\{title\}|\{text\}|\{group\})", title) if p]
        text = default(F.get_json_object("payload", f"$.{said.split()[1]}")) if said and said.startswith("payload ") else F.lit(said) if said else F.left(default("text"), F.lit(200)) if collection == "feeds" else default("text")
        value = F.struct(F.lit(i).alias("ord"), F.concat(*parts).alias("name"), text.alias("said"), first_filled("link", otherwise=link).alias("to"))
        row = (F.when if row is None else row.when)(here(domain, collection, kind), value)
    item = F.concat(F.lit("<item><title>"), xml_escape("r.name"), F.lit("</title><link>"), xml_escape("r.to"), F.lit("</link><description>"), xml_escape("r.said"), F.lit("</description></item>"))
    out = changes.select(row.alias("r"), "pos", default("group_key").alias("group_key")).filter("r IS NOT NULL").select("r.ord", "pos", "group_key", item.alias("item"))
    if alert_rows is not None:
        item = F.concat(F.lit("<item><title>ALERT: "), xml_escape(F.concat_ws(" ", "source", "title")), F.lit(f"</title><link>{html.escape(alert_link, False)}</link><description>"), xml_escape(F.array_join("matched_keywords", ", ")), F.lit("</description></item>"))
        out = out.unionByName(alert_rows.select(F.lit(len(branches)).alias("ord"), "pos", F.lit("").alias("group_key"), item.alias("item")))
    return out


def rss_document(items: DataFrame, title: str, link: str, description: str) -> str:
    body = "\n".join(r.item for r in items.orderBy("ord", "group_key", "pos").toLocalIterator())
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel>\n<title>{html.escape(title, False)}</title>\n<link>{html.escape(link, False)}</link>\n'
    return f"{head}<description>{html.escape(description, False)}</description>\n{body}\n</channel></rss>\n"


def digest_rows(changes: DataFrame, lines=DIGEST) -> DataFrame:
    """K4: (ord, section, label, content, link, group_key, pos) of the weekly digest, from one pass over the log."""
    text = {
        "title": default("title"), "group": default("group_key"), "text 120": F.left(default("text"), F.lit(120)),
        "text": default("text"), "text - title": F.concat(default("text"), F.lit(" - "), default("title")),
        "title - text": F.concat(default("title"), F.lit(" - "), default("text")), "title (text)": F.concat(default("title"), F.lit(" ("), default("text"), F.lit(")")),
        "title - sunset": F.concat(default("title"), F.lit(" - Sunset: "), F.left(default("new_value"), F.lit(10))),
        "group: detail": F.concat(default("group_key"), F.lit(": "), default("text")),
    }
    row = None
    for i, (section, domain, collection, kind, group, label, content, most) in enumerate(lines):
        tag = default("category", "NEWS") if label == "category" else F.left(default("group_key"), F.lit(18)) if label == "group 18" else F.concat(F.lit(label.split("group")[0]), F.left(default("group_key"), F.lit(8))) if label.endswith("group 8") else F.lit(label)
        value = F.struct(F.lit(i).alias("ord"), F.lit(section).alias("section"), tag.alias("label"), text[content].alias("content"), F.lit(most or 1 << 30).alias("most"))
        row = (F.when if row is None else row.when)(here(domain, collection, kind, group), value)
    found = changes.select(row.alias("r"), default("link").alias("link"), default("group_key").alias("group_key"), "run_date", "pos").filter("r IS NOT NULL").select("r.*", "link", "group_key", "run_date", "pos")
    place = F.row_number().over(Window.partitionBy("ord", "group_key").orderBy("run_date", "pos"))
    return found.withColumn("__n", place).filter(F.col("__n") <= F.col("most")).drop("__n", "most")


def digest_alerts(alert_rows: DataFrame) -> DataFrame:
    """K4: (label, content, run_date, pos) of the alerts that head the digest."""
    return alert_rows.select(F.left("source", F.lit(14)).alias("label"), F.concat("title", F.lit(" \u2014 "), F.array_join("matched_keywords", ", ")).alias("content"), "run_date", "pos")


def digest_html(rows: DataFrame, title: str = "Weekly brief", alert_rows: DataFrame | None = None) -> str:
    """K4: the digest as a page, alerts first; everything is escaped."""
    parts, last = [], None
    told = list(digest_alerts(alert_rows).orderBy("run_date", "pos").toLocalIterator()) if alert_rows is not None else []
    if told:
        parts.append(f"<h2>{len(told)} KEYWORD ALERT(S)</h2>" + "".join(f"<p><b>{html.escape(r.label)}</b> {html.escape(r.content)}</p>" for r in told))
    for r in rows.orderBy("ord", "group_key", "run_date", "pos").toLocalIterator():
        if r.section != last:
            parts.append(f"<h2>{html.escape(r.section)}</h2>")
            last = r.section
        content = html.escape(r.content)
        parts.append(f"<p><b>{html.escape(r.label)}</b> " + (f'<a href="{html.escape(r.link)}">{content}</a>' if r.link else content) + "</p>")
    return f"<html><body><h1>{html.escape(title)}</h1>{''.join(parts) or f'<p>{NOTHING}</p>'}</body></html>"


def dashboard(totals: Sequence, stats: Sequence, sparklines: dict[str, list[int]], alert_rows: Sequence, generated: str, items: dict[str, list[str]] | None = None) -> str:
    """K2: a page of totals, bars and changes of each section, and alerts; everything is escaped."""
    items = items or {}
    listed = lambda section: "".join(f"<li>{html.escape(i)}</li>" for i in items.get(section, []))
    cells = "".join(f"<li>{html.escape(str(r['stat']))}: {r['n']}</li>" for r in stats)
    bars = "".join(f"<section id='sec-{html.escape(r['section'])}'><h2>{html.escape(r['section'])} ({r['n']})</h2>" + "".join(f"<i style='height:{p}%'></i>" for p in sparklines.get(r["section"], [0] * 7)) + f"<ul>{listed(r['section'])}</ul></section>" for r in totals)
    told = "".join(f"<li>[{html.escape(a['source'])}] {html.escape(a['title'])} ({html.escape(', '.join(a['matched_keywords']))})</li>" for a in alert_rows)
    return f"<html><body><p>{html.escape(generated)}</p><ul>{cells}</ul>{bars}<section id='sec-alerts'><h2>Alerts ({len(alert_rows)})</h2><ul>{told}</ul></section></body></html>"


def chat_message(alert_rows: Sequence, most: int = 10, total: int | None = None) -> str:
    """The first alerts and how many more there are (``total``: of all, where only the first are given)."""
    total = len(alert_rows) if total is None else total
    lines = [f"- **[{a['source']}]** {a['title']} ({', '.join(a['matched_keywords'])})" for a in alert_rows[:most]]
    return "\n".join(lines + [f"...and {total - most} more"] * (total > most))


def notify(message: str, send: Callable[[str], None] | None, log: Callable[[str], None] = print) -> bool:
    """K5, K6: hand a message to a mail or chat callback; without one nothing is sent, and a failure is only logged."""
    if send is None or not message:
        return False
    try:
        send(message)
        return True
    except Exception as e:
        log(f"notification failed: {e}")
        return False

