import json

from tidemark.plans import daily
from tidemark.sources.collect import collect

RSS = "<rss version='2.0'><channel><title>c</title><item><title>one</title><link>l1</link><guid isPermaLink='false'>g1</guid></item><item><title>two</title><link>l2</link></item></channel></rss>"
ATOM = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>a</title><link href='h'/><id>i</id><updated>u</updated></entry></feed>"
PAGE = "<main><p>a paragraph that is longer than twenty characters</p></main>"


def test_a_snapshot_from_landed_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    sources = [
        ("niap", "rest", "pcl", put("pcl", json.dumps([{"product_id": 7, "protection_profiles": [{"pp_short_name": "CPP_ND"}]}])), "json"),
        ("niap", "rest", "pps", put("pps", "[]"), "json"), ("niap", "rest", "tds", put("tds", "null"), "json"), ("niap", "rest", "news", f"file://{tmp_path}/missing", "json"),
        ("niap", "rest", "cctls", put("cctls", json.dumps({"results": {"cctls": [{"cctl_id": 1, "status_id": {"status_name": "x"}}]}})), "json"),
        ("niap", "rest", "events_curr", put("ec", json.dumps({"results": [{"id": 1}]})), "json"), ("niap", "rest", "events_prev", put("ep", json.dumps({"results": [{"id": 1}, {"id": 2}]})), "json"),
        ("cc_portal", "page", "news", put("news", "<p>portal news that is long enough to stay</p>"), "html"), ("cc_portal", "page", "pps", put("t", "<table><tr><th>A</th></tr><tr><td>1</td></tr></table>"), "html"),
        ("cc_portal", "feed", "pp_rss", put("prss", RSS), "rss"), ("cctl_labs", "feed", "Lab", put("lab", "<h2><a href='/p'>post</a></h2>"), "scrape"),
        ("csfc", "page", "apl", put("apl", PAGE), "html"), ("nist", "page", "news", put("nn", PAGE), "html"), ("cc_crypto", "page", "news", put("cn", PAGE), "html"),
        ("nist", "feed", "R", put("rss", RSS), "rss"), ("csfc", "feed", "A", put("atom", ATOM), "rss"), ("nist", "document", "D", put("doc", "x" * 9), "head"), ("nist", "document", "gone", f"file://{tmp_path}/nothing", "head"),
    ]
    got = collect(spark, sources, attempts=1, wait=0)
    n = {k: v.count() for k, v in got.items()}
    assert n == {
        "products": 1, "profiles": 0, "decisions": 0, "labs_directory": 1, "events": 3, "news": 0, "portal_news": 1, "portal_publications": 0, "portal_communities": 0, "portal_pps": 1, "portal_products": 0,
        "page_items": 3, "feed_items": 4, "portal_feed": 2, "doc_headers": 2,
    }
    assert {(r.domain, r.feed_name, r.title, r.link, r.id) for r in got["feed_items"].collect()} == {("nist", "R", "one", "l1", "g1"), ("nist", "R", "two", "l2", "l2"), ("csfc", "A", "a", "h", "i"), ("cctl_labs", "Lab", "post", "/p", "/p")}
    assert got["products"].first().product_id == "7"
    changes = daily.compute_changes(daily.empty_snapshot(spark), daily.empty_snapshot(spark) | got)
    assert changes.filter("collection = 'feeds'").count() == 4 and changes.filter("collection = 'events'").count() == 2
