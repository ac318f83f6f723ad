"""Snapshot and difference files against the tables and the log that they were written from."""

import json
import re
from datetime import datetime

from tidemark.plans.catalog import QUERIES
from tidemark.plans.daily import compute_changes, empty_snapshot
from tidemark.sources import shredded as S

OLD = {
    "schema_version": 2, "collected_at": "2024-01-01T00:00:00",
    "niap": {
        "pps": [{"pp_id": "1", "pp_short_name": "A", "sunset_date": None, "status": "x"}, {"pp_id": 2, "pp_short_name": "B", "status": "x"}], "tds": [], "events": [{"id": 5, "title": "e"}], "news": [],
        "pcl": [{"product_id": "p", "vendor_id_name": "Cisco", "status_sort": "Certified", "product_name": "P", "protection_profiles": [{"pp_short_name": "CPP_ND_V2"}]}],
        "cctls": [{"cctl_id": 1, "name": "L", "status_id": {"status_name": "on"}}],
    },
    "cc_portal": {"news": [{"text": "t" * 30, "link": "l"}], "pps": [{"Zeta": "1", "Alpha": "2", "_link": ""}], "products": []},
    "cctl_labs": {"Lab One": [{"id": "i", "title": "post", "link": "/1", "published": ""}], "Lab: two": []},
    "csfc": {"pages": {"apl": [{"text": "item", "href": ""}]}, "feeds": {"F": [{"id": "f1", "title": "ft", "link": "fl", "summary": "s", "published": "p"}]}, "capability_package_headers": {"CP-X y": {"url": "u", "status_code": 200, "etag": "e", "last_modified": "", "content_length": "5", "partial_hash": ""}}},
    "cc_crypto": {"pages": {}, "doc_headers": {}},
    "nist": {"pages": {"news": []}, "doc_headers": {"D": {"url": "u2", "status_code": None, "etag": "", "last_modified": "", "content_length": "", "partial_hash": "h"}}, "feeds": {}},
}


def texts(spark, **files):
    rows = [(name, text if isinstance(text, str) else json.dumps(text)) for name, text in files.items()]
    return S.parsed(spark.createDataFrame(rows, "file string, text string"))


def test_tables_of_a_snapshot(spark):
    raw = texts(spark, a=OLD, broken=json.dumps(OLD)[:-1])
    got = {n: [r.asDict(recursive=True) for r in df.collect()] for n, df in S.tables(raw).items()}
    assert {r["file"] for rows in got.values() for r in rows} == {"a"}
    assert [(r["pp_id"], r["pp_short_name"], r["sunset_date"], r["status"], r["pos"]) for r in got["profiles"]] == [("1", "A", None, "x", 0), ("2", "B", None, "x", 1)]
    assert got["products"][0]["protection_profiles"] == [{"pp_short_name": "CPP_ND_V2"}] and got["labs_directory"][0]["status_id"] == {"status_name": "on"}
    assert got["portal_pps"][0]["cells"] == [{"name": "Zeta", "value": "1"}, {"name": "Alpha", "value": "2"}, {"name": "_link", "value": ""}]  # in the order of the columns
    assert [(r["domain"], r["feed_name"], r["id"], r["summary"]) for r in sorted(got["feed_items"], key=str)] == [("cctl_labs", "Lab One", "i", None), ("csfc", "F", "f1", "s")]
    assert [(r["domain"], r["page_key"], r["text"], r["pos"]) for r in got["page_items"]] == [("csfc", "apl", "item", 0)]
    assert sorted((r["domain"], r["doc_name"], r["status_code"], r["etag"]) for r in got["doc_headers"]) == [("csfc", "CP-X y", 200, "e"), ("nist", "D", None, "")]
    assert [tuple(r) for r in S.envelopes(texts(spark, a=OLD, b={"collected_at": 5})).orderBy("file").collect()] == [("a", 2, "2024-01-01T00:00:00"), ("b", 1, "5")]


def test_problems(spark):
    odd = {"niap": {"pps": [{"pp_id": "1", "status": ["x"], "extra": 1}, 7, {"pp_short_name": "no id"}, {"pp_id": None}], "tds": {"not": "a list"}, "news": "text"}, "nist": {"doc_headers": {"D": {"status_code": "many", "etag": None}}, "pages": {"k": {"text": 1}}, "feeds": []}}
    got = {tuple(r) for r in S.problems(texts(spark, odd=odd, broken="{", fine=OLD, empty="{}", top="[1]")).collect()}
    assert got == {
        ("broken", None, None, "corrupt", 1), ("odd", "profiles", "status", "type", 1), ("odd", "profiles", "extra", "unknown", 1), ("odd", "profiles", None, "no record", 1), ("odd", "profiles", None, "no identity", 2),
        ("odd", "decisions", "niap.tds", "no list", 1), ("odd", "news", "niap.news", "no list", 1), ("odd", "doc_headers", "status_code", "type", 1), ("odd", "page_items", "nist.pages.k", "no list", 1), ("odd", "feed_items", "nist.feeds", "no map", 1),
    }


def test_differences_between_files_and_their_log(spark, tmp_path):
    """Files read from disk, compared by the same differences as any snapshot."""
    new = json.loads(json.dumps(OLD))
    new["niap"]["pps"][1]["status"] = "y"
    new["niap"]["pps"].append({"pp_id": "3", "pp_short_name": "C"})
    new["csfc"]["pages"]["apl"] = [{"text": "other", "href": ""}]
    for name, content in (("2024-01-01.json", OLD), ("2024-01-02.json", new)):
        (tmp_path / name).write_text(json.dumps(content, indent=2))
    one, two = (S.snapshot(S.files(spark, str(tmp_path / f"2024-01-0{i}.json"))) for i in (1, 2))
    log = sorted((r.domain, r.collection, r.kind, r.entity_key or r.text, r.old_value, r.new_value) for r in compute_changes(one, two).collect())
    assert log == [("csfc", "pages", "added", "other", None, None), ("csfc", "pages", "removed", "item", None, None), ("niap", "pps", "added", "3", None, None), ("niap", "pps", "status_change", "2", "x", "y")]
    assert compute_changes(one, one).count() == 0 and compute_changes(empty_snapshot(spark), one).count() > 5


def test_a_stored_difference(spark):
    stored = {
        "period_start": "", "niap": {"pps": {"added": [], "status_changes": [{"pp_id": "2", "pp_short_name": "B", "old_status": "x", "new_status": "y"}]}, "news": {"added": [{"id": 9, "title": "t", "link": "", "url": "u", "_category": "CISA"}]}, "cisco_ndcpp": {"newly_archived": [{"product_id": "p"}]}},
        "cc_portal": {"news": {"added": []}, "pps": {"added": [{"Zeta": "1", "Alpha": "2"}]}, "products": {"added": []}},
        "csfc": {"pages": {"apl": {"added": [{"text": "a", "href": "h"}], "removed": [{"text": "r", "href": ""}]}}, "capability_packages": {"CP": {"changed": True, "old_content_length": "1", "new_content_length": "2", "url": "u"}, "same": {"changed": False}}, "feeds": {"F": [{"title": "ft", "link": "l"}]}},
    }
    log = S.difference_log(texts(spark, **{"2024-03-05_diff.json": stored})).collect()
    assert {str(r.run_date) for r in log} == {"2024-03-05"}
    got = sorted((r.domain, r.collection, r.group_key or "", r.kind, r.entity_key or "", r.text or "", r.link or "", r.category or "", r.old_value or "", r.new_value or "") for r in log)
    assert got == [
        ("cc_portal", "pps", "", "added", "", "1 | 2", "", "", "", ""), ("csfc", "documents", "CP", "header_changed", "CP", "Size: 1 → 2 bytes", "u", "", "", ""), ("csfc", "feeds", "F", "added", "ft", "", "l", "", "", ""),
        ("csfc", "pages", "apl", "added", "", "a", "h", "", "", ""), ("csfc", "pages", "apl", "removed", "", "r", "", "", "", ""), ("niap", "cisco_ndcpp", "", "newly_archived", "p", "", "", "", "Certified", "Archived"),
        ("niap", "news", "", "added", "9", "", "u", "CISA", "", ""), ("niap", "pps", "", "status_change", "2", "", S.PROFILE + "2", "", "x", "y"),
    ]
    assert json.loads(next(r.payload for r in log if r.collection == "news"))["id"] == 9


def test_files_are_read_once(spark):
    """Whatever the number of collections; and tables taken together are the same rows as one by one."""
    raw = texts(spark, a=OLD, broken="{", c={"niap": {"pps": [{"pp_id": None}, {"pp_id": 4}, 5, None]}})
    key = lambda name: lambda t: {"key": t[name], "pos": t["pos"]}
    both = S.together(raw, {"profiles": key("pp_id"), "page_items": key("page_key"), "feed_items": key("feed_name")})
    for df in (both, S.problems(raw), S.difference_log(raw)):
        assert df._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    apart = S.tables(raw)
    want = [(r.file, t, r[n], r.pos) for t, n in (("profiles", "pp_id"), ("page_items", "page_key"), ("feed_items", "feed_name")) for r in apart[t].collect()]
    assert sorted(map(tuple, both.collect())) == sorted(want) and len(want) == 6


def test_a_stored_difference_is_cast_once(spark):
    """A part that is taken out of a VARIANT is written anew, so a file goes through one cast (and one look for each list of cells), whatever it could hold."""
    odd = {
        "niap": {"pps": 7, "news": {"added": [None, 5]}}, "csfc": {"pages": {"apl": {"added": [{"text": "a"}], "other": [{"text": "b"}]}}, "feeds": ["no map"]}, "cctl_labs": {"added": [{"title": "t"}], "none": {}},
        "cc_portal": {"pps": {"added": [{"Zeta": "1"}, {}], "removed": [{"Zeta": "2"}]}, "products": 5}, "nist": {"doc_headers": {"C": {"changed": False}, "D": {"changed": "true"}, "E": 1, "F": {"changed": True}}},
    }
    log = S.difference_log(texts(spark, **{"2024-03-05_diff.json": odd}))
    assert sorted((r.domain, r.collection, r.group_key or "", r.pos, r.entity_key or "", r.text or "") for r in log.collect()) == [
        ("cc_portal", "pps", "", 0, "", "1"), ("cc_portal", "pps", "", 1, "", ""), ("cctl_labs", "feeds", "added", 0, "t", ""), ("csfc", "pages", "apl", 0, "", "a"),
        ("niap", "news", "", 0, "", ""), ("niap", "news", "", 1, "", ""), ("nist", "documents", "D", 0, "D", "Size:  →  bytes"), ("nist", "documents", "F", 0, "F", "Size:  →  bytes"),
    ]
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and len(re.findall(r"try_variant_get\(v#", plan)) == 3


def test_orders_are_dealt_out_before_their_differences_are_parsed(spark, tmp_path):
    """A table of one row group is read by one task, which must not parse all of its files."""
    day = datetime(2024, 1, 1)
    spark.createDataFrame([(k, k, "O", day, "1-URGENT") for k in range(1, 401)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shares = QUERIES["q_difference_files"](spark, str(tmp_path)).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(shares) == 1200 and max(shares) < 600
