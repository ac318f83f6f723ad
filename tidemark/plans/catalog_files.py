"""Registered queries over stored files and feeds: each row of a given table makes a file's text, sound or damaged by a rule on its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.plans.catalog import query, table
from tidemark.sources import feeds, shredded


def written(*pieces: str | Column) -> Column:
    """Texts and columns one after another."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces))


def snapshot_files(spark, sf) -> DataFrame:
    """A snapshot file an order: its profile, its line items as products, one page item.  Every thirteenth is cut off, some have fields of
    another type or unknown ones."""
    items = F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(items)).alias("items"))
    o = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    product = lambda x: written('{"product_id": ', x["l_partkey"], ', "product_name": "', x["l_returnflag"], '", "protection_profiles": [{"pp_short_name": "', x["l_linestatus"], '"}]}')
    status = F.when(k % 7 == 1, written('["', F.col("o_orderstatus"), '"]')).otherwise(written('"', F.col("o_orderstatus"), '"'))
    text = written(
        '{"schema_version": 2, "collected_at": "', day, '", "niap": {"pps": [{"pp_id": ', k, ', "pp_short_name": "', F.col("o_orderpriority"), '", "status": ', status, ', "sunset_date": "', day, '"',
        F.when(k % 5 == 0, ', "note": 1').otherwise(""), '}], "pcl": [', F.coalesce(F.array_join(F.transform("items", product), ", "), F.lit("")), ']}, "nist": {"pages": {"', F.col("o_orderpriority"), '": [{"text": "order ', k, '", "href": "/', k, '"}]}}}',
    )
    return shredded.parsed(o.select(written(k, ".json").alias("file"), F.when(k % 13 == 0, F.left(text, F.length(text) - 1)).otherwise(text).alias("text")))


@query("""WITH o AS (SELECT *, o_orderkey || '.json' AS file FROM orders WHERE o_orderkey % 13 <> 0)
SELECT file, 'profiles' AS name, CAST(o_orderkey AS VARCHAR) AS entity_key, CAST(NULL AS VARCHAR) AS group_key, 0 AS pos, o_orderpriority AS a, CASE WHEN o_orderkey % 7 <> 1 THEN o_orderstatus END AS b, strftime(o_orderdate, '%Y-%m-%d') AS c FROM o
UNION ALL SELECT file, 'products', CAST(l_partkey AS VARCHAR), NULL, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) - 1 AS INT), l_returnflag, l_linestatus, NULL FROM o JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT file, 'page_items', NULL, o_orderpriority, 0, 'order ' || o_orderkey, '/' || o_orderkey, NULL FROM o""")
def q_snapshot_tables(spark, sf):
    """Typed tables of snapshot files."""
    none = F.lit(None).cast("string")
    columns = lambda key, group, pos, a, b, c: {"entity_key": key, "group_key": group, "pos": pos, "a": a, "b": b, "c": c}
    return shredded.together(snapshot_files(spark, sf), {
        "profiles": lambda t: columns(t["pp_id"], none, t["pos"], t["pp_short_name"], t["status"], t["sunset_date"]),
        "products": lambda t: columns(t["product_id"], none, t["pos"], t["product_name"], t["protection_profiles"][0]["pp_short_name"], none),
        "page_items": lambda t: columns(none, t["page_key"], t["pos"], t["text"], t["href"], none),
    })


@query("""SELECT CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS field, 'corrupt' AS problem, count(*) AS files FROM orders WHERE o_orderkey % 13 = 0
UNION ALL SELECT 'profiles', 'status', 'type', count(*) FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 7 = 1
UNION ALL SELECT 'profiles', 'note', 'unknown', count(*) FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 5 = 0""")
def q_snapshot_problems(spark, sf):
    """What doesn't fit, told apart: files that can't be read, fields of another type, unknown fields."""
    return shredded.problems(snapshot_files(spark, sf)).groupBy(F.col("table").alias("name"), "field", "problem").agg(F.count("*").alias("files"))


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS run_date, 'niap' AS domain, 'pps' AS collection, CAST(NULL AS VARCHAR) AS group_key, CASE o_orderkey % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'sunset_change' ELSE 'status_change' END AS kind,
  CAST(o_orderkey AS VARCHAR) AS entity_key, o_orderpriority AS title, CASE o_orderkey % 3 WHEN 1 THEN 'never' WHEN 2 THEN 'O' END AS old_value, CASE o_orderkey % 3 WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN o_orderstatus END AS new_value,
  'https://www.niap-ccevs.org/Profile/PP.cfm?id=' || o_orderkey AS link FROM orders
UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d'), 'cctl_labs', 'feeds', o_orderstatus, 'added', 'post ' || o_orderkey, 'post ' || o_orderkey, NULL, NULL, NULL FROM orders
UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d'), 'nist', 'documents', 'doc ' || o_custkey, 'header_changed', 'doc ' || o_custkey, NULL, NULL, NULL, '/' || o_custkey FROM orders""")
def q_difference_files(spark, sf):
    """Stored differences as change log rows."""
    k, day = F.col("o_orderkey"), F.col("day")
    # Dealt out while rows are short: a table may be one row group, so one task, and its texts are some ten times as long.
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).repartition("o_orderkey")
    change = written('{"pp_id": "', k, '", "pp_short_name": "', F.col("o_orderpriority"), '", "old_sunset": "never", "new_sunset": "', day, '", "old_status": "O", "new_status": "', F.col("o_orderstatus"), '"}')
    listed = F.when(k % 3 == 0, "added").when(k % 3 == 1, "sunset_changes").otherwise("status_changes")
    text = written(
        '{"period_start": "", "period_end": "', day, '", "niap": {"pps": {"', listed, '": [', change, ']}, "tds": {"added": []}}, "cctl_labs": {"', F.col("o_orderstatus"), '": [{"title": "post ', k, '"}], "none": []}, ',
        '"nist": {"pages": {}, "doc_headers": {"doc ', F.col("o_custkey"), '": {"changed": true, "old_etag": "", "new_etag": "e", "url": "/', F.col("o_custkey"), '"}}}, "alerts": []}',
    )
    raw = orders.select(written(day, "_", k, "_diff.json").alias("file"), text.alias("text"))
    log = shredded.difference_log(shredded.parsed(raw))
    return log.select(F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "domain", "collection", "group_key", "kind", "entity_key", "title", "old_value", "new_value", "link")


@query(r"""SELECT doc_id, pos, CASE pos WHEN 0 THEN 'First & last of ' || doc_id ELSE 'Second' END AS title, '/' || pos || '/' || doc_id AS link, CASE pos WHEN 0 THEN md5(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) ELSE md5('') END AS summary, CASE WHEN pos = 1 AND doc_id % 6 <> 5 THEN 'id' || doc_id ELSE '/' || pos || '/' || doc_id END AS id
FROM documents, (VALUES (0), (1)) v(pos)""")
def q_feeds_recovered(spark, sf):
    """S3: a feed a document, its whole text as a summary.  Of six forms, one is sound RSS and one sound Atom with several links; the others have a bare
    ampersand, white space before the prolog, the form of RSS 1.0, or end in the middle of an element."""
    k, text = F.col("doc_id"), E.xml_escape("text")
    head, form = '<?xml version="1.0"?>', k % 6
    first = written("<item><title>First &amp; last of ", k, "</title><link>/0/", k, "</link><description>", text, "</description></item>")
    bare = written("<item><title>First & last of ", k, "</title><link>/0/", k, "</link><description>", text, "</description></item>")
    second = written("<item><title>Second</title><link>/1/", k, "</link><guid>id", k, "</guid></item>")
    cut = written("<item><title>Second</title><link>/1/", k, "</link><guid")
    atom = written(
        "<feed><entry><title>First &amp; last of ", k, '</title><link rel="self" href="/self"/><link rel="alternate" href="/0/', k, '"/><summary>', text,
        "</summary></entry><entry><title>Second</title><link href=\"/1/", k, '"/><link rel="self" href="/self"/><id>id', k, "</id></entry></feed>",
    )
    feed = (
        F.when(form == 0, written(head, "<rss><channel><title>c</title>", first, second, "</channel></rss>")).when(form == 1, written(head, "<rss><channel>", bare, second, "</channel></rss>"))
        .when(form == 2, written("\n ", head, "<rss><channel>", first, second, "</channel></rss>")).when(form == 3, written(head, '<rdf:RDF xmlns:rdf="r"><channel><title>c</title></channel>', first, second, "</rdf:RDF>"))
        .when(form == 4, written(head, atom)).otherwise(written(head, "<rss><channel>", first, cut))
    )
    found = feeds.read_feeds(table(spark, sf, "documents").select("doc_id", feed.alias("text")), "doc_id").filter("pos IS NOT NULL")
    summary = F.md5(F.trim(F.col("summary"), F.lit(" \t\n\r")))
    return found.select("doc_id", "pos", "title", "link", summary.alias("summary"), "id")
