"""Page extraction as a table function (E1-E8): several rules in one parse, laterally joined, so that a page's other columns stay.

    found = extracted(pages, "news,links,main")          # or in SQL, after register(spark):
    SELECT page_id, e.* FROM pages, LATERAL tidemark_extract(html, 'news,links,main') e
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import html as H

#: Names of the rules: E1, E4, E6, E7, E8; tables are E2 (with links) and E3, posts E5.
BLOCKS = {"news": H.NEWS, "links": H.LINKS, "pane": H.PANE, "main": H.MAIN, "rows": H.ROWS}
TABLES = {"table_links": True, "table": False}
POSTS = "posts"
FOUND = "rule string, pos int, text string, href string, id string, cells array<struct<name: string, value: string>>"


@F.udtf(returnType=FOUND)
class Extract:
    """(rule, pos, text, href, id, cells) of a page for each of the rules; none of a null page."""

    def eval(self, html: str, rules: str):
        if html is None:
            return
        root = H.parse(html)
        for rule in (rules or "").split(","):
            if rule in BLOCKS:
                rows = ((text, href, None, None) for text, href in BLOCKS[rule].items(root))
            elif rule in TABLES:
                rows = ((None, None, None, [{"name": n, "value": v} for n, v in cells]) for cells in H.table_rows(root, TABLES[rule]))
            elif rule == POSTS:
                rows = ((title, link, id, None) for title, link, id in H.post_items(root))
            else:
                raise ValueError(f"no rule {rule!r}")
            for pos, row in enumerate(rows):
                yield rule, pos, *row


def register(spark: SparkSession) -> None:
    spark.udtf.register("tidemark_extract", Extract)


def extracted(pages: DataFrame, rules: str, html: str = "html") -> DataFrame:
    """``pages`` with the columns of what the rules find, one row a find; each page is parsed once for all rules."""
    return pages.lateralJoin(Extract(F.col(html).outer(), F.lit(rules)))
