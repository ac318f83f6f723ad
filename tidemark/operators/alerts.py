"""Alerts: changes whose text has watched terms (A1-A13), in one pass over the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import default, spaced, with_hits
from tidemark.functions.vocab import REST, WATCHED

# What is scanned, and how an alert names its source and kind.
#: (domain, collection, kind, group or None, source, alert kind, scanned text); a {} takes the group's name.
#: Text: title, text, group, ``title text`` joined by a space; alert kind None is the row's category.
BRANCHES = (
    ("niap", "pps", "added", None, "NIAP PP", "new", "title text"),
    ("niap", "pps", "sunset_change", None, "NIAP PP", "sunset", "title"),
    ("niap", "tds", "added", None, "NIAP TD", "new", "title text"),
    ("niap", "news", "added", None, "NIAP News", None, "title"),
    ("cctl_labs", "feeds", "added", None, "Lab: {}", "post", "title"),
    ("csfc", "feeds", "added", None, "CSfC Feed: {}", "advisory", "title"),
    ("csfc", "pages", "added", "apl", "CSfC APL", "new", "text"),
    ("csfc", "documents", "header_changed", None, "CSfC CP", "updated", "group"),
    ("cc_crypto", "pages", "added", None, "CC Crypto: {}", "publication", "text"),
    ("cc_crypto", "documents", "header_changed", None, "CC Crypto Doc", "updated", "group"),
    ("nist", "pages", "added", None, "NIST: {}", "publication", "text"),
    ("nist", "documents", "header_changed", None, "NIST Doc", "updated", "group"),
    ("nist", "feeds", "added", None, "NIST Feed: {}", "news", "title"),
)


def alerts(changes: DataFrame, branches=BRANCHES, words: list[str] = WATCHED) -> DataFrame:
    """(run_date, source, kind, title, matched_keywords, pos) of the changes that one of the branches scans and that hit."""
    texts = {"title": default("title"), "text": default("text"), "group": default("group_key"), "title text": spaced("title", "text")}
    chosen = None
    for domain, collection, kind, group, source, alert, text in branches:
        here = (F.col("domain") == domain) & (F.col("collection") == collection) & (F.col("kind") == kind)
        if group:
            here = here & (F.col("group_key") == group)
        name = F.lit(source) if "{}" not in source else F.concat(F.lit(source.split("{}")[0]), default("group_key"), F.lit(source.split("{}")[1]))
        row = F.struct(name.alias("source"), (default("category", REST) if alert is None else F.lit(alert)).alias("kind"), texts[text].alias("title"))
        chosen = (F.when if chosen is None else chosen.when)(here, row)
    found = changes.select("run_date", "pos", chosen.alias("a")).filter("a IS NOT NULL").select("run_date", "pos", "a.*")
    return with_hits(found, "title", words)
