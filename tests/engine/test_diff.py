from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.functions.vocab import PROFILE_WORDS, SCHEMA_VERSION, SOURCES, VENDOR_WORDS, WATCHED
from tidemark.operators import diff as D


def log(df):
    return sorted(map(tuple, df.select("entity_key", "kind", "old_value", "new_value").collect()), key=str)


RULES = [D.Transition("sunset_change", "d", "changed_to_value"), D.Transition("status_change", "s"), D.Transition("gone", "d", "became_set"), D.Transition("archived", "s", "pair", "Certified", "Archived")]


def test_transitions_by_hand(spark):
    old = spark.createDataFrame([(1, "a", None, 0), (2, None, "x", 1), (3, "Certified", "", 2), (4, "z", "z", 3), (None, "z", "z", 4)], "k int, s string, d string, pos int")
    new = spark.createDataFrame([(1, "a", "2030", 0), (2, None, "", 1), (3, "Archived", None, 2), (5, "n", None, 3), (5, "last", "v", 4)], "k int, s string, d string, pos int")
    assert log(D.keyed_diff(old, new, "k", RULES, order="pos")) == sorted([
        ("1", "sunset_change", None, "2030"), ("1", "gone", None, "2030"), ("3", "status_change", "Certified", "Archived"), ("3", "archived", "Certified", "Archived"),
        ("4", "removed", None, None), ("5", "added", None, None)], key=str)
    last = D.keyed_diff(old, new, "k", order="pos").filter("entity_key = '5'").select("new.s").first()
    assert last.s == "last"


rows = st.lists(st.tuples(st.integers(0, 6), st.sampled_from(["a", "", None])), max_size=8, unique_by=lambda r: r[0])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=rows, b=rows)
def test_properties(spark, a, b):
    old, new = (spark.createDataFrame(x, "k int, s string") for x in (a, b))
    rule = [D.Transition("status_change", "s")]
    assert log(D.keyed_diff(old, old, "k", rule)) == []
    there = log(D.keyed_diff(old, new, "k", rule))
    back = {(k, {"added": "removed", "removed": "added"}.get(kind, kind), n, o) for k, kind, o, n in log(D.keyed_diff(new, old, "k", rule))}
    assert set(there) == back
    want = {(str(k), "added", None, None) for k in dict(b).keys() - dict(a).keys()} | {(str(k), "removed", None, None) for k in dict(a).keys() - dict(b).keys()}
    want |= {(str(k), "status_change", dict(a)[k], dict(b)[k]) for k in dict(a).keys() & dict(b).keys() if dict(a)[k] != dict(b)[k]}
    assert set(there) == want


def test_text_feed_cells(spark):
    schema = "domain string, page_key string, text string, href string"
    old = spark.createDataFrame([("d", "p", "same", "1"), ("d", "p", None, "2"), ("d", "q", "here only", "3"), ("d", "p", "x" * 120 + "old", "4")], schema)
    new = spark.createDataFrame([("d", "p", "same", "5"), ("d", "p", "", "6"), ("d", "p", "new", "7"), ("d", "p", "new", "8"), ("d", "q", "same", "9"), ("d", "p", "x" * 120 + "new", "10")], schema)
    got = {(r.kind, r.href) for r in D.text_diff(old, new, group=("domain", "page_key")).collect()}
    assert got == {("added", "6"), ("added", "7"), ("added", "8"), ("added", "9"), ("removed", "2"), ("removed", "3")}
    feed = "f string, id string, title string, link string"
    a, b = spark.createDataFrame([("f", "1", "t", "l"), ("f", None, "t2", "l"), ("f", None, None, "l3")], feed), spark.createDataFrame([("f", "1", "other", "l"), ("f", None, "t2", "z"), ("f", None, None, "l4"), ("g", "1", "t", "l"), ("f", None, None, None)], feed)
    assert {(r.f, r.link) for r in D.feed_diff(a, b, "f").collect()} == {("f", "l4"), ("g", "l"), ("f", None)}
    assert {(r.f, r.link) for r in D.feed_diff(a, b, "f", ("id", "title")).collect()} == {("g", "l")}
    cells = "cells array<struct<name: string, value: string>>"
    a, b = spark.createDataFrame([([("h", "1"), ("i", "2")],), ([("h", "3")],)], cells), spark.createDataFrame([([("h", "1"), ("i", "9")],), ([("h", "3")],), ([],)], cells)
    assert [len(r.cells) for r in D.cells_diff(a, b, n=1).collect()] == [0]
    assert sorted(len(r.cells) for r in D.cells_diff(a, b, n=2).collect()) == [0, 2]


def test_headers(spark):
    schema = "doc_name string, url string, status_code int, last_modified string, etag string, content_length string, partial_hash string"
    old = spark.createDataFrame([("same", "u", 200, "d", "e", "1", ""), ("code", "u", 200, "", None, "1", ""), ("gone", "u", 200, "d", "", "", ""), ("blank", "u", 200, "", "", "", "")], schema)
    new = spark.createDataFrame([("same", "v", 200, "d", "e", "1", ""), ("code", "u", 404, "", "", "1", None), ("fresh", "w", 200, "", "", "", "h"), ("nothing", "u", None, "", None, "", "")], schema)
    got = {r.doc_name: (r.old_last_modified, r.new_partial_hash, r.url) for r in D.header_diff(old, new).collect()}
    assert got == {"gone": ("d", "", "u"), "fresh": ("", "h", "w")}


def test_expressions(spark):
    one = lambda e, **v: spark.createDataFrame([tuple(v.values())] if v else [(1,)], ", ".join(f"{k} string" for k in v) or "x int").select(e).first()[0]
    for text, want in {"FIPS 203 vulnerability": "CISA", "Published: PP-Module": "PUBLICATION", "ML-KEM hash function": "CRYPTO", "prevent": "EVENT", "hello": "NEWS", "New LABGRAM policy": "LABGRAM"}.items():
        assert one(expr.category("t"), t=text) == want
    assert one(expr.hits("t"), t="FIPS 203 ML-KEM and ssh") == ["SSH", "FIPS 203", "ML-KEM"]
    assert one(expr.hits("t"), t="") == [] and len(WATCHED) == 46
    assert one(expr.strip("t"), t="  a b\t\n") == "a b"
    assert one(expr.first_filled("t", "u", otherwise="#"), t="", u=None) == "#"
    assert one(expr.spaced("t", "u"), t=None, u="b") == " b"
    assert one(expr.xml_escape("t"), t="<a & b>") == "&lt;a &amp; b&gt;"
    body = "é" * 2000
    import hashlib

    assert one(expr.fingerprint("t"), t=body) == hashlib.md5(body.encode()[:2048]).hexdigest()
    v = spark.createDataFrame([(1, "CISCO Inc", [("CPP_ND_V2",)]), (2, "Cisco", [("cpp_nd",)]), (3, "Other", [("CPP_ND",)]), (4, None, None), (5, "cisco", [])], "i int, v string, p array<struct<pp_short_name: string>>")
    assert [r.i for r in v.filter(expr.vendor_profile("v", "p", VENDOR_WORDS, PROFILE_WORDS)).collect()] == [1]
    assert D.schema_warnings(None, 2, SCHEMA_VERSION) and not D.schema_warnings(2, 2, 2)
    assert len(SOURCES) == 59 and len({(s[0], s[1], s[2]) for s in SOURCES}) == 59
    changes = spark.createDataFrame([("d", "e", "1", "2"), ("", "e", "1", ""), ("", "", None, None)], "old_last_modified string, new_last_modified string, old_content_length string, new_content_length string")
    assert [r[0] for r in changes.select(expr.header_detail()).collect()] == ["d → e", "Size: 1 →  bytes", "Content changed"]
    assert [r[0] for r in spark.range(3).select(expr.plural("id", "day")).collect()] == ["0 days", "1 day", "2 days"]
    assert spark.range(1).select(F.size(F.array())).first()[0] == 0
