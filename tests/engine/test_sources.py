import json

import pytest

from tidemark.sources import html as H
from tidemark.sources import landed as L


def items(rule, page):
    return rule.items(H.parse(page))


def test_news_and_links():
    page = "<div id='main'><p>short</p><p>a text of <b>more than</b> twenty characters <a href='/x'>here</a></p><li>unclosed item that is long enough<li>second <p>nested paragraph of some length</p></div><p>outside of the container, long enough</p>"
    assert items(H.NEWS, page) == [("a text ofmore thantwenty charactershere", "/x"), ("unclosed item that is long enough", ""), ("secondnested paragraph of some length", ""), ("nested paragraph of some length", "")]
    assert items(H.LINKS, page) == [("here", "/x")]
    assert items(H.NEWS, "<p>no container, but more than twenty</p>") == [("no container, but more than twenty", "")]


def test_cut_and_duplicates():
    long = "w" * 500
    page = f"<main><p>{long}</p><p>{long}x</p><h2>{'v' * 16}</h2><h5>not a tag of the rule here</h5></main>"
    assert items(H.PANE, page) == [("w" * 400, ""), ("v" * 16, "")]
    assert len(items(H.MAIN, f"<div id='content'><td>{'c' * 11}</td><td>{'c' * 10}</td></div>")) == 1


def test_rows_or_blocks():
    table = "<main><table><tr><th>a</th></tr><tr><td> 1 </td><td><b>2</b> 3</td><td>4</td><td>5</td><td>6</td></tr><tr><td> </td></tr></table><p>ignored because there is a table here</p></main>"
    assert items(H.ROWS, table) == [("1 | 23 | 4 | 5", "")]
    assert items(H.ROWS, "<p>more than twenty <b>characters</b> here</p>") == [("more than twenty characters here", "")]


def test_tables_and_posts(spark):
    page = "<table><tr><th>A</th><th>B</th><th>A</th></tr><tr><td>1<td>2<td>3<tr><th>x</th><tr><td><a href='l'>4</a></td></tr></table>"
    pages = spark.createDataFrame([("p", page), ("none", None), ("empty", "")], "page_id string, html string")
    got = [(r.pos, [(c.name, c.value) for c in r.cells]) for r in H.tables(pages).collect()]
    assert got == [(0, [("A", "3"), ("B", "2"), ("_link", "")]), (1, [("A", "4"), ("_link", "l")])]
    post = "<h2><a href=''>t1</a></h2><h3><a>t2</a></h3><article><h4><a href='/3'>t3</a></h4></article><h2>no link</h2><h2><a href='x'> </a></h2>"
    pages = spark.createDataFrame([("p", post)], "page_id string, html string")
    assert [(r.title, r.link, r.id) for r in H.posts(pages).collect()] == [("t1", "", ""), ("t2", "", "t2"), ("t3", "/3", "/3"), ("t3", "/3", "/3")]
    many = "".join(f"<h2><a href='{i}'>t</a></h2>" for i in range(30))
    assert len(H.post_items(H.parse(many))) == 20


def test_retry():
    calls, slept = [], []
    assert L.with_retry(lambda: calls.append(1) or 1 / 0, sleep=slept.append) is None
    assert len(calls) == 4 and slept == [1, 2, 4, 8]
    assert L.with_retry(lambda: 7, sleep=slept.append) == 7


def test_settings():
    assert L.settings({"TIDEMARK_EMAIL_RECIPIENTS": " a@x , ,b@x"})["recipients"] == ["a@x", "b@x"]


def test_http_and_headers(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 3000)
    urls = [f"file://{tmp_path}/a.bin", f"file://{tmp_path}/missing"]
    got = {r.url: r for r in L.fetch(spark, urls, attempts=1, wait=0, most=2048).collect()}
    assert len(got[urls[0]].body) == 2048 and got[urls[0]].status_code == 200 and got[urls[1]].status_code is None
    head = "url string, status_code int, last_modified string, etag string, content_length string"
    heads = spark.createDataFrame([("a", 200, "", "", ""), ("b", 200, "d", "", ""), ("c", None, "", "", ""), ("d", 200, "", "", "")], head)
    bodies = spark.createDataFrame([("a", 206, bytearray(b"x" * 3000)), ("b", 200, bytearray(b"y")), ("c", 200, bytearray(b"z")), ("d", 404, bytearray(b"q"))], "url string, status_code int, body binary")
    import hashlib

    want = {"a": hashlib.md5(b"x" * 2048).hexdigest(), "b": "", "c": hashlib.md5(b"z").hexdigest(), "d": ""}
    assert {r.url: r.partial_hash for r in L.doc_headers(heads, bodies).collect()} == want


def test_polls_of_one_url(spark, tmp_path):
    """Pages that share a URL, or have none, are polled each for itself."""
    from tidemark.plans import catalog

    pages = [(12, "u", "first"), (24, "u", "second"), (36, None, "third"), (15, "u", "not fetched"), (13, "u", "has an etag")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.url or "", r.etag, r.partial_hash) for r in catalog.QUERIES["q_doc_poll"](spark, str(tmp_path)).collect())
    import hashlib

    h = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == sorted([("u", "", h("first")), ("u", "", h("second")), ("", "", h("third")), ("u", "", ""), ("u", "e13", "")])


def test_envelopes(spark):
    df = spark.createDataFrame([(json.dumps({"results": {"cctls": [{"id": 1.0}, {"id": "x"}]}}),), ("{}",), ("null",)], "j string")
    assert [r.id for r in L.envelope(df, "j", "results.cctls", "id: string").collect()] == ["1.0", "x"]
    top = spark.createDataFrame([('[{"id": 5, "z": null}]',)], "j string")
    assert [(r.pos, r.id) for r in L.envelope(top, "j", "", "id: string").collect()] == [(0, "5")]


def test_feeds_and_snapshots(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<rss><channel><item><title>t</title><link>l</link><description>d</description><guid isPermaLink="false">g</guid><pubDate>p</pubDate></item><item><title>u</title><link>m</link></item></channel></rss>')
    assert [tuple(r) for r in L.rss(spark, str(tmp_path / "f.xml")).collect()] == [("t", "l", "d", "p", "g"), ("u", "m", "", "", "m")]
    (tmp_path / "s1.json").write_text('{"a": [1]}')
    (tmp_path / "s2.json").write_text("{broken")
    assert [r.file for r in L.snapshots(spark, str(tmp_path / "*.json")).collect()] == ["s1.json"]
    assert L.catalog(spark).groupBy("mode").count().count() == 5


@pytest.mark.parametrize("page", [None, "", "<p", "</p></div>", "<![x", "<table><tr>"])
def test_bad_pages(page):
    assert H.parse(page) is not None and items(H.ROWS, page) == [] and H.table_rows(H.parse(page)) == []
