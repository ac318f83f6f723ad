"""Hits by shared pieces, HEAD polls, torn days, digests with alerts, linear page trees."""

import http.server
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.functions.vocab import WATCHED
from tidemark.plans import daily, sinks
from tidemark.sources import html as H
from tidemark.sources.landed import fetch


def test_hits_against_plain_search(spark):
    words = ["ab", "xab", "abc", "Zed", "a", "", "mit ", *WATCHED]
    texts = ["", "xabc zED", "fips 203 and FIPS 140-3, cp-wan", "MIT license", "nothing here", "NSA CSfC apl"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, None)]
    df = spark.createDataFrame(rows, "i int, t string")
    plain = {i: [w for w in words if w.lower() in (t or "").lower()] for i, t in rows}
    assert {r.i: r.h for r in df.select("i", E.hits("t", words).alias("h")).collect()} == plain
    assert {r.i: r.h for r in E.with_hits(df, "t", words, "h").collect()} == {i: h for i, h in plain.items() if h}
    of = E.guards([w.lower() for w in WATCHED])
    assert all(g in w for w, g in of.items()) and len(set(of.values())) < 0.8 * len(of)


def test_head_keeps_the_headers_of_error_pages_and_is_tried_once(spark):
    asked = []

    class Site(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            asked.append(self.path)
            self.send_response(404 if self.path == "/gone" else 200)
            self.send_header("ETag", "e" + self.path)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        got = {r.url: (r.status_code, r.etag) for r in fetch(spark, [f"{at}/gone", f"{at}/here", "http://127.0.0.1:9/none"], method="HEAD", wait=0).collect()}
    finally:
        server.shutdown()
    assert got == {f"{at}/gone": (404, "e/gone"), f"{at}/here": (200, "e/here"), "http://127.0.0.1:9/none": (None, "")}
    assert asked.count("/gone") == 1


def test_a_torn_day_is_done_again_and_never_compared_with(spark, tmp_path):
    store = daily.Store(spark, f"file://{tmp_path}")
    snapshot = daily.empty_snapshot(spark)
    store.write(snapshot, "2024-01-01")
    assert store.finished() == [] and store.prior("2024-01-02") is None
    store.finish("2024-01-01", version=1)
    assert store.prior("2024-01-02") == "2024-01-01" and store.version("2024-01-01") == 1 and store.version(None) is None


def test_weekly_json_has_every_domain_and_the_period(spark):
    changes = spark.createDataFrame([], f"{daily.CHANGE}, run_date date")
    alerts = spark.createDataFrame([], "run_date date, pos int, source string, kind string, title string, matched_keywords array<string>")
    import json

    said = json.loads(sinks.weekly_json(changes, alerts, ["2024-01-01", "2024-01-07"]))
    assert said["period_start"] == "2024-01-01" and said["period_end"] == "2024-01-07" and said["alerts"] == []
    assert set(said) == {"period_start", "period_end", "alerts", *sinks.SKELETON} and said["niap"]["cctls"] == {"added": [], "removed": [], "status_change": []}


def test_a_digest_of_alerts_alone_isnt_empty(spark):
    rows = spark.createDataFrame([], "ord int, section string, label string, content string, link string, group_key string, run_date date, pos int")
    alerts = spark.createDataFrame([("NIAP PP of a long name", "A <b>", ["SSH", "TLS 1.3"], 1)], "source string, title string, matched_keywords array<string>, pos int").withColumn("run_date", F.to_date(F.lit("2024-01-01")))
    page = sinks.digest_html(rows, alert_rows=alerts)
    assert "1 KEYWORD ALERT(S)" in page and "<b>NIAP PP of a l</b> A &lt;b&gt; \u2014 SSH, TLS 1.3" in page and sinks.NOTHING not in page
    assert sinks.NOTHING in sinks.digest_html(rows)


@pytest.mark.parametrize("page", ["<span><div>x</div>" * 8000, "<b>" * 20_000 + "</i>" * 20_000, "<div>x" * 15_000, "<p>" * 30_000 + "x", "<li><b>" * 12_000])
def test_page_trees_are_linear(page):
    start = time.process_time()
    H.parse(page)
    assert time.process_time() - start < 10
