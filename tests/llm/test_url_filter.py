import re

import pytest

from tidemark.llm import url_filter as u

SCHEMA = "page_id bigint, url string, host string, token string, best int"
URLS = [
    None, "", "no scheme", "://", "http://", "http://org", "http://org/", "https://Example.ORG/es/x?y", "https://www.example.org/en/1", "https://www.example.org/en/12/3#t",
    "https://example.org/en/2", "https://notexample.org/es/", "https://badorg/", "http://x.com/fr/?q", "http://com/de/", "http://a.b.com/de", "http://a.b.net/de/", "ftp://ads.x.net/q",
    "http://m.ads-track.example.com/en/4", "http://m.ads-track.example.com/fr/4", "http://x.net/ads/policy/", "http://x.net/ads/other", "http://x.net/Ads/", "http://ÄÖ.com/fr/ü", "http://x.com:80/fr/", "a://b://org/",
    "http://x.net/" + "ads/" * 5000, "http://x\n.org/\n",
]


def plain(url, listed=u.LIST, patterns=u.PATTERNS):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[2], max(fit)[3]
    fit = {v for p, v in patterns if re.search(u.compiled(p), host + path)}
    return host, path, None, "allow" if "allow" in fit else "block" if fit else "allow"


MANY = tuple((f"h{i}.net", f"/p{i}/", "block" if i % 2 else "allow") for i in range(3000))


@pytest.mark.parametrize("listed", [u.LIST, (*u.LIST, *MANY)])
def test_verdicts(spark, listed):
    """However many rules there are, and whatever the ids are."""
    urls = [*URLS, "http://x.h7.net/p7/z", "http://h8.net/p8/", "http://h9.net/p8/"]
    df = spark.createDataFrame([(i, x, "h", "t", 1) for i, x in enumerate(urls)] + [(1, "http://a.com/fr/", "", "", 1), (1, "http://b.com/de/", "", "", 1), (None, "http://b.com/de/", "", "", 1)], SCHEMA)
    got = [(r.id, r.host, r.path, r.rule, r.verdict) for r in u.judge_urls(df, listed).collect()]
    want = [(i, *plain(x, listed)) for i, x in enumerate(urls)] + [(1, "a.com", "/fr/", "com/fr/", "allow"), (1, "b.com", "/de/", "com/de/", "block"), (None, "b.com", "/de/", "com/de/", "block")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_verdicts_stated_by_hand(spark):
    want = {
        "https://www.example.org/en/12": ("www.example.org", "/en/12", "example.org/en/1", "block"), "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://x.com/es/": ("x.com", "/es/", None, "allow"), "http://ads.x.net/q": ("ads.x.net", "/q", None, "block"), "http://x.net/ads/policy/a": ("x.net", "/ads/policy/a", None, "allow"),
        "http://m.ads-track.example.com/fr/1": ("m.ads-track.example.com", "/fr/1", "com/fr/", "allow"),
    }
    df = spark.createDataFrame([(x,) for x in want], "url string").selectExpr("url AS page_id", "url")
    assert {r.id: (r.host, r.path, r.rule, r.verdict) for r in u.judge_urls(df).collect()} == want


def test_driver_urls(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    got = u.op3_url_filters(spark, sf_dir).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain(x) for i, x in url.items()}


def test_rules_are_filed_under_their_rarest_token(spark):
    df = spark.createDataFrame([(1, "http://a.org/en/"), (2, "http://b.org/es/"), (3, "http://c.com/es/")], "id int, address string")
    filed = u.file_rules(df, u.rule_rows([("example.org", "/es/", "block"), ("org", "/", "allow")], []))
    assert [r["token"] for r in filed] == ["example", "org"]
    assert u.literal_tokens("||ads-track.x*y/z^") == ["ads", "track", "z"]
    with pytest.raises(ValueError):
        u.rule_rows([], [("*a*", "block")])


def test_empty(spark):
    assert u.judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0
