"""One snapshot of all sources of a catalog: fetch, then parse by domain, kind and mode.

Every URL is a partition of the fetch, so sources are read in parallel and a source that fails leaves no rows instead of
failing the others.  What is fetched is written before it is parsed, as several tables are parsed from it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expr import default
from tidemark.functions.vocab import SOURCES
from tidemark.sources import html as H
from tidemark.sources.feeds import read_feeds
from tidemark.sources.landed import doc_headers, envelope, fetch, union_events
from tidemark.sources.landing import RawStore, shared_root

#: REST source: where its list is in the answer, the record's fields.
REST = {
    "pcl": ("", "product_id string, vendor_id_name string, status_sort string, product_name string, protection_profiles array<struct<pp_short_name: string>>"),
    "pps": ("", "pp_id string, pp_short_name string, pp_name string, sunset_date string, status string"),
    "tds": ("", "td_id string, identifier string, title string, removed_on string, pp_short_name string"),
    "cctls": ("results.cctls", "cctl_id string, name string, status_id struct<status_name: string>"),
    "events_curr": ("results", "id string, title string, link string"),
    "events_prev": ("results", "id string, title string, link string"),
    "news": ("results", "id string, title string, link string, url string, date string"),
}
#: How a domain's pages become text items.
PAGE_RULES = {"csfc": H.PANE, "cc_crypto": H.MAIN, "nist": H.ROWS}


def feed_rows(bodies: DataFrame) -> DataFrame:
    """(domain, feed_name, title, link, summary, published, id, pos) of feeds' texts."""
    found = read_feeds(bodies, "domain", "name")
    return found.filter("pos IS NOT NULL").select("domain", F.col("name").alias("feed_name"), "title", "link", "summary", "published", "id", "pos")


def collect(spark: SparkSession, sources: Sequence[tuple] = SOURCES, get: Callable[..., DataFrame] = fetch, landing: str | None = None, run: str | None = None, **options) -> dict[str, DataFrame]:
    """The tables of a snapshot (see ``tidemark.plans.daily.SCHEMAS``), and the portal's pages that are never compared.

    What is fetched lands in the folder ``landing``, which the executors share, and is read from there; with the same ``run`` it isn't fetched again.
    """
    store = RawStore(spark, landing or f"{shared_root(spark)}/landing", run)
    listed = spark.createDataFrame([tuple(s) for s in sources], "domain string, kind string, name string, url string, mode string")
    urls = sorted({s[3] for s in sources if s[4] != "head"})
    bodies = store.keep("pages", lambda: get(spark, urls, **options)).select("url", F.col("body").cast("string").alias("text")).filter("text IS NOT NULL")
    bodies = listed.filter("mode <> 'head'").join(bodies, "url")

    def rest(name: str) -> DataFrame:
        return envelope(bodies.filter((F.col("kind") == "rest") & (F.col("name") == name)), "text", *REST[name])

    def pages(domain: str, name: str | None = None) -> DataFrame:
        here = bodies.filter((F.col("domain") == domain) & (F.col("kind") == "page"))
        return here.filter(F.col("name") == name) if name else here

    out = {
        "products": rest("pcl"), "profiles": rest("pps"), "decisions": rest("tds"), "labs_directory": rest("cctls"), "events": union_events(rest("events_curr"), rest("events_prev")), "news": rest("news"),
        "portal_news": H.blocks(pages("cc_portal", "news"), H.NEWS, "name", "text").select("text", F.col("href").alias("link"), "pos"),
        "portal_publications": H.blocks(pages("cc_portal", "publications"), H.NEWS, "name", "text").select("text", F.col("href").alias("link"), "pos"),
        "portal_communities": H.blocks(pages("cc_portal", "communities"), H.LINKS, "name", "text").select(F.col("text").alias("name"), F.col("href").alias("link"), "pos"),
        "portal_pps": H.tables(pages("cc_portal", "pps"), True, "name", "text").select("cells", "pos"),
        "portal_products": H.tables(pages("cc_portal", "products"), False, "name", "text").select("cells", "pos"),
    }
    items = [H.blocks(pages(domain), rule, "name", "text").select(F.lit(domain).alias("domain"), F.col("key").alias("page_key"), "text", "href", "pos") for domain, rule in PAGE_RULES.items()]
    out["page_items"] = items[0].unionByName(items[1]).unionByName(items[2])
    scraped = bodies.filter("mode = 'scrape'").withColumn("key", F.concat_ws("\0", "domain", "name"))
    posts = H.posts(scraped, "key", "text").withColumns({"domain": F.split_part("key", F.lit("\0"), F.lit(1)), "feed_name": F.split_part("key", F.lit("\0"), F.lit(2)), "summary": F.lit(None).cast("string")})
    feeds = feed_rows(bodies.filter("mode = 'rss'"))
    out["feed_items"] = feeds.unionByName(posts.select(*feeds.columns)).filter("domain <> 'cc_portal'")
    out["portal_feed"] = feeds.filter("domain = 'cc_portal'")

    documents = [s for s in sources if s[4] == "head"]
    heads = store.keep("heads", lambda: get(spark, list(dict.fromkeys(s[3] for s in documents)), method="HEAD", **options)).drop("body")
    blank = heads.filter((F.col("status_code").isNull()) | ((default("last_modified") == "") & (default("etag") == "") & (default("content_length") == "")))
    again = [r.url for r in blank.select("url").collect()]  # no more than the catalog has
    parts = store.keep("parts", lambda: get(spark, again, most=2048, **options))
    known = listed.filter("mode = 'head'").select("domain", F.col("name").alias("doc_name"), "url")
    out["doc_headers"] = known.join(doc_headers(heads, parts), "url").select("domain", "doc_name", "url", "status_code", "last_modified", "etag", "content_length", "partial_hash")
    return out
