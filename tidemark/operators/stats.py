"""Counts by day and section, totals, roll-ups, sparklines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What each section counts.
#: section: (domain, collection, kinds); the statistic that it counts into
SECTIONS = {
    "niap_pp": (("niap", "pps", ("added", "removed", "sunset_change", "status_change")), "niap"),
    "niap_td": (("niap", "tds", ("added", "removed")), "niap"),
    "cisco": (("niap", "cisco_ndcpp", ("added", "removed", "newly_archived")), "niap"),
    "niap_news": (("niap", "news", ("added",)), "niap"),
    "cctl": (("cctl_labs", "feeds", ("added",)), "cctl"),
    "csfc": (("csfc", "documents", ("header_changed",)), "csfc"),
    "cc_crypto": (("cc_crypto", "documents", ("header_changed",)), "nist"),
    "nist": (("nist", "documents", ("header_changed",)), "nist"),
}
DAILY = ("niap_pp", "niap_td", "niap_news", "cctl", "csfc", "cc_crypto", "nist")


def section() -> Column:
    out = None
    for name, ((domain, collection, kinds), _) in SECTIONS.items():
        here = (F.col("domain") == domain) & (F.col("collection") == collection) & F.col("kind").isin(*kinds)
        out = (F.when if out is None else out.when)(here, name)
    return out


def daily_counts(changes: DataFrame, days: DataFrame, sections=DAILY) -> DataFrame:
    """G1: (run_date, section, n) with a row for each of the days and sections, 0 where nothing changed."""
    counted = changes.withColumn("section", section()).filter(F.col("section").isin(*sections)).groupBy("run_date", "section").agg(F.count("*").alias("n"))
    every = days.select("run_date").distinct().withColumn("section", F.explode(F.array(*map(F.lit, sections))))
    return every.join(counted, ["run_date", "section"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sparkline(counts: DataFrame, by: str = "section", n: str = "n") -> DataFrame:
    """Counts as percent of their section's largest, rounded half to even."""
    largest = F.greatest(F.max(n).over(Window.partitionBy(by)), F.lit(1))
    return counts.withColumn("pct", F.bround(F.col(n) / largest * 100).cast("int"))


def totals(changes: DataFrame) -> DataFrame:
    """Rows of each section, all sections named."""
    named = changes.select(section().alias("section")).filter("section IS NOT NULL").groupBy("section").agg(F.count("*").alias("n"))
    every = changes.sparkSession.createDataFrame([(s, stat) for s, (_, stat) in SECTIONS.items()], "section string, stat string")
    return every.join(named, "section", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def roll_up(section_totals: DataFrame) -> DataFrame:
    """The totals by statistic."""
    return section_totals.groupBy("stat").agg(F.sum("n").alias("n"))


def domain_metrics(changes: DataFrame) -> DataFrame:
    """What a run says of each domain: (domain, page_items_added, document_changes, feed_items_new, entity_changes)."""
    at = lambda collection, kind: (F.col("collection") == collection) & (F.col("kind") == kind)
    pages, documents, feeds = at("pages", "added"), at("documents", "header_changed"), at("feeds", "added")
    others = ~F.col("collection").isin("pages", "documents", "feeds")
    return changes.groupBy("domain").agg(F.count_if(pages).alias("page_items_added"), F.count_if(documents).alias("document_changes"), F.count_if(feeds).alias("feed_items_new"), F.count_if(others).alias("entity_changes"))
