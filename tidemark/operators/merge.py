"""Merging the change logs of several days into one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import default

# How a merge treats the collections.
#: (domain, collection, kind or None) of which a merge keeps only the first day's rows.
FIRST_DAY_ONLY = (("cc_portal", "products", None), ("niap", "cctls", None), ("csfc", "pages", "removed"), ("cc_crypto", "pages", "removed"), ("nist", "pages", "removed"))
#: List collections that a later day always touches, whether it has rows or not.
ALWAYS_TOUCHED = (("niap", "pps"), ("niap", "tds"), ("niap", "cisco_ndcpp"), ("niap", "news"), ("niap", "events"), ("cc_portal", "news"), ("cc_portal", "pps"))


def first_wins(df: DataFrame, by: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """The first row of each key; null keys are keys."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def last_wins(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, whole, by a partial aggregate instead of a sort."""
    rest = F.struct(*df.columns)
    return df.groupBy(*by).agg(F.max_by(rest, F.struct(*order)).alias("__r")).select("__r.*")


def alert_key(source: str = "source", title: str = "title", words: str = "matched_keywords") -> Column:
    """W2."""
    return F.concat(default(source), F.lit("|"), default(title), F.lit("|"), F.array_join(F.array_sort(F.coalesce(words, F.array().cast("array<string>"))), ","))


def merge_alerts(alerts: DataFrame) -> DataFrame:
    return first_wins(alerts, [alert_key()], ["run_date", "pos"])


def frozen_rows() -> Column:
    """Is a row one of which a merge keeps only the first day's?"""
    frozen = F.lit(False)
    for domain, collection, kind in FIRST_DAY_ONLY:
        here = (F.col("domain") == domain) & (F.col("collection") == collection)
        frozen = frozen | (here & (F.col("kind") == kind) if kind else here)
    return frozen


#: What tells a list.
LIST = ["domain", "collection", "group_key", "kind"]


def row_key() -> Column:
    """What tells a row in a list."""
    return F.left(default("payload"), F.lit(120))


def merge_changes(changes: DataFrame, strict: bool = True, first: Column | None = None, days: Column | None = None) -> DataFrame:
    """The change logs of some days as one.  ``first`` and ``days``: the first day that has rows and the number of such days, where ``changes`` doesn't hold all rows.

    Lists keep the first row of each 120-character payload prefix within (domain, collection, group, kind); documents
    keep their last; some collections only what the first day had.  ``strict``: a list that no later day touches keeps
    its duplicates, as the day's log has them.
    """
    rows = changes.withColumn("first", changes.agg(F.min("run_date")).scalar() if first is None else first)
    rows = rows.withColumn("__frozen", frozen_rows()).filter(~F.col("__frozen") | (F.col("run_date") == F.col("first")))
    documents = last_wins(rows.filter("kind = 'header_changed'"), ["domain", "collection", "group_key"], ["run_date", "pos"])
    lists = rows.filter("kind <> 'header_changed' AND NOT __frozen").withColumn("__key", row_key())
    at = LIST
    w = Window.partitionBy(*at, "__key").orderBy("run_date", "pos")
    lists = lists.withColumn("__n", F.row_number().over(w))
    if strict:
        always = F.lit(False)
        for domain, collection in ALWAYS_TOUCHED:
            always = always | ((F.col("domain") == domain) & (F.col("collection") == collection))
        days = changes.select(F.countDistinct("run_date")).scalar() if days is None else days
        last = lists.groupBy("domain", "collection", "group_key", "kind").agg(F.max("run_date").alias("last"))
        nulls_equal = [F.col(f"l.{c}").eqNullSafe(F.col(f"t.{c}")) for c in at]
        lists = lists.alias("l").join(last.alias("t"), nulls_equal).select("l.*", "t.last").withColumn("days", days)
        touched = (always & (F.col("days") > 1)) | (F.col("last") > F.col("first"))
        lists = lists.filter((F.col("__n") == 1) | ~touched).drop("last", "days")
    else:
        lists = lists.filter("__n = 1")
    kept = rows.filter("kind <> 'header_changed' AND __frozen")
    return documents.select(*changes.columns).unionByName(lists.select(*changes.columns)).unionByName(kept.select(*changes.columns))
