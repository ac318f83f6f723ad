import datetime

import pytest

from tidemark.operators import merge, quality, stats
from tidemark.plans import daily, sinks
from tidemark.streaming import landing

#: Documents of a first run: capability packages, standards, catalog documents.
NAMES = {"csfc": 8, "nist": 7, "cc_crypto": 2}


def snapshot(spark, day: int):
    table = lambda name, rows: spark.createDataFrame(rows, daily.SCHEMAS[name])
    profiles = [(str(i), f"PP{i}", f"CPP_ND profile {i}", "2030-01-01" if i == 3 and day else None, "ok" if i != 4 or not day else "old", i) for i in range(12 + day)]
    products = [(str(i), "Cisco" if i % 2 else "Other", "Archived" if day and i == 1 else "Certified", f"product {i}", [("CPP_ND_V2",)], i) for i in range(60)]
    headers = [(d, f"file {len(d)}-{i}", f"http://{d}/{i}", 200, f"day {day}" if i == 0 else "day", "", "", "") for d, n in NAMES.items() for i in range(n)]
    return {
        "profiles": table("profiles", profiles), "products": table("products", products), "doc_headers": table("doc_headers", headers),
        "news": table("news", [(str(i), f"Labgram {i} published", "", f"u{i}", "d", i) for i in range(1 + day)]),
        "decisions": table("decisions", [("t", "TD1", "about SSH", "2024" if day else "", "PP", 0)]),
        "labs_directory": table("labs_directory", [("l", "Lab", ("Active" if not day else "Closed",), 0)]),
        "feed_items": table("feed_items", [("nist", "F", f"ML-KEM {i}", "l", "s", "p", f"{i}", i) for i in range(1 + day)] + [("cctl_labs", "Lab A", "TLS 1.3 post", "l", "s", "p", None, 0)] * day),
        "page_items": table("page_items", [("csfc", "apl", f"SSH client {i}", "", i) for i in range(5 + day)]),
        "portal_pps": table("portal_pps", [([("n", f"row {i}")], i) for i in range(1 + day)]),
    }


def test_daily_weekly(spark, tmp_path):
    store, sent = daily.Store(spark, str(tmp_path)), []
    first = daily.run_daily(store, lambda: snapshot(spark, 0), "2024-01-01", sent.append)
    assert first["prior"] is None and first["alerts"] == [] and not sent
    log = store.changes(["2024-01-01"])
    assert dict(log.groupBy("domain").count().collect()) == NAMES and {r.kind for r in log.select("kind").collect()} == {"header_changed"}
    assert {r.stat: r.n for r in stats.roll_up(stats.totals(log)).collect()} == {"niap": 0, "cctl": 0, "csfc": 8, "nist": 9}

    assert daily.run_daily(store, lambda: snapshot(spark, 0), "2024-01-01")["skipped"]
    second = daily.run_daily(store, lambda: snapshot(spark, 1), "2024-01-03", sent.append)
    assert second["prior"] == "2024-01-01" and len(sent) == 1 and len(second["warnings"]) == 2
    got = {(r.domain, r.collection, r.kind): r["count"] for r in store.changes(["2024-01-03"]).groupBy("domain", "collection", "kind").count().collect()}
    assert got == {
        ("niap", "pps", "added"): 1, ("niap", "pps", "sunset_change"): 1, ("niap", "pps", "status_change"): 1, ("niap", "tds", "removed"): 1, ("niap", "cisco_ndcpp", "newly_archived"): 1,
        ("niap", "news", "added"): 1, ("niap", "cctls", "status_change"): 1, ("cc_portal", "pps", "added"): 1, ("nist", "feeds", "added"): 1, ("cctl_labs", "feeds", "added"): 1,
        ("csfc", "pages", "added"): 1, ("csfc", "documents", "header_changed"): 1, ("nist", "documents", "header_changed"): 1, ("cc_crypto", "documents", "header_changed"): 1,
    }
    assert {(a["source"], a["kind"], tuple(a["matched_keywords"])) for a in second["alerts"]} == {
        ("NIAP PP", "new", ("CPP_ND",)), ("NIAP News", "LABGRAM", ("labgram",)), ("Lab: Lab A", "post", ("TLS 1.3",)), ("CSfC APL", "new", ("SSH",)), ("NIST Feed: F", "news", ("ML-KEM",)),
    }
    week, told = daily.run_weekly(store)
    documents = week.filter("kind = 'header_changed'")
    assert documents.count() == 17 and documents.filter("run_date = DATE'2024-01-03'").count() == 3
    assert told.count() == 5
    rows = sinks.digest_rows(week)
    assert "Labgram 1" in sinks.digest_html(rows) and sinks.NOTHING in sinks.digest_html(rows.limit(0))
    page = daily.render(store, "2024-01-03", "<now>")
    assert "&lt;now&gt;" in page and "height:100%" in page
    feed = sinks.rss_document(sinks.rss_items(store.changes(["2024-01-01"])), "t", "l", "d")
    assert feed.count("<item>") == 17 and feed.index("CSfC CP") < feed.index("NIST Doc") < feed.index("CC Crypto Doc")
    assert '"header_changed"' in sinks.as_json(log)
    for day in range(4, 8):
        store.write(daily.empty_snapshot(spark), f"2024-01-0{day}")
    store.rotate(keep=2)
    assert store.days() == ["2024-01-06", "2024-01-07"]


def test_rejected_and_bootstrap(spark, tmp_path):
    store = daily.Store(spark, str(tmp_path))
    with pytest.raises(quality.SnapshotRejected):
        daily.run_daily(store, dict, "2024-01-01")
    assert store.days() == []
    with pytest.raises(FileNotFoundError):
        daily.run_weekly(store)
    daily.run_bootstrap(store, lambda: snapshot(spark, 0), "2024-01-01")
    assert store.days() == ["2024-01-01"] and store.days("changes", "run_date") == []


def change(day, pos, payload, domain="nist", collection="feeds", group="g", kind="added"):
    return (domain, collection, group, kind, "e", pos, "t", None, None, None, None, None, payload, datetime.date(2024, 1, day))


def merged(spark, rows, **how):
    df = spark.createDataFrame(rows, f"{daily.CHANGE}, run_date date")
    return sorted((r.run_date.day, r.pos) for r in merge.merge_changes(df, **how).collect())


def test_merge_rules(spark):
    twice = [change(1, 0, "a"), change(1, 1, "a"), change(1, 2, "b")]
    assert merged(spark, twice) == [(1, 0), (1, 1), (1, 2)]  # nothing later touches the list
    assert merged(spark, twice, strict=False) == [(1, 0), (1, 2)]
    assert merged(spark, [*twice, change(2, 0, "c"), change(2, 1, "b")]) == [(1, 0), (1, 2), (2, 0)]
    assert merged(spark, [change(1, 0, "x" * 120 + "1"), change(2, 0, "x" * 120 + "2")]) == [(1, 0)]
    assert merged(spark, [change(1, 0, "p", kind="removed", collection="pages"), change(2, 0, "q", kind="removed", collection="pages")]) == [(1, 0)]
    assert merged(spark, [change(1, 0, "p", kind="header_changed", collection="documents"), change(2, 0, "p", kind="header_changed", collection="documents")]) == [(2, 0)]
    assert merged(spark, [change(1, 0, "a", "niap", "news", None), change(1, 1, "a", "niap", "news", None), change(2, 0, "z")]) == [(1, 0), (2, 0)]
    assert merged(spark, []) == []


def test_half_even(spark):
    df = spark.createDataFrame([("s", 1), ("s", 8), ("z", 0)], "section string, n int")
    assert {(r.section, r.n): r.pct for r in stats.sparkline(df).collect()} == {("s", 1): 12, ("s", 8): 100, ("z", 0): 0}


def test_messages():
    told = [{"source": "s", "title": f"t{i}", "matched_keywords": ["k"]} for i in range(12)]
    text = sinks.chat_message(told)
    assert text.count("\n") == 10 and text.endswith("...and 2 more") and sinks.chat_message(told[:10], total=12) == text
    logged = []
    assert not sinks.notify("x", lambda m: 1 / 0, logged.append) and logged
    assert not sinks.notify("", print) and not sinks.notify("x", None)


def test_streams(spark, tmp_path):
    schema = "k string, s string"
    for i, rows in enumerate(([("1", "a"), ("2", "b")], [("2", "c"), ("3", "d")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        landing.diff_stream(landing.landed(spark, str(tmp_path / "in"), schema), str(tmp_path / "state"), str(tmp_path / "out"), "k", [landing.Transition("status_change", "s")], str(tmp_path / "cp")).awaitTermination()
        got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/batch={i}").collect()}
        assert got == ([{("1", "added", None, None), ("2", "added", None, None)}, {("1", "removed", None, None), ("2", "status_change", "b", "c"), ("3", "added", None, None)}][i])
    spark.createDataFrame([("f", "1", datetime.datetime(2024, 1, 1), "SSH here"), ("f", "1", datetime.datetime(2024, 1, 1, 1), "x"), ("f", "2", datetime.datetime(2024, 1, 2), "y")], "feed_name string, id string, ts timestamp, title string").write.parquet(str(tmp_path / "feed"))
    stream = landing.landed(spark, str(tmp_path / "feed"), "feed_name string, id string, ts timestamp, title string", 10)
    query = landing.new_items(stream, "ts").writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("fresh").count() == 2
    query = landing.daily_counts(stream, "ts", "feed_name").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.n for r in spark.table("counted").collect()} == {1, 2}
    told = []
    landing.keyword_alerts(stream, "title", ["ssh"], told.extend, str(tmp_path / "cp2")).awaitTermination()
    assert [r.id for r in told] == ["1"]
    told = []
    landing.keyword_alerts(stream, "title", ["ssh", "x", "y"], told.extend, str(tmp_path / "cp3"), str(tmp_path / "found"), most=2).awaitTermination()
    assert len(told) == 2 and spark.read.parquet(str(tmp_path / "found")).count() == 3  # all are written, the first are sent
