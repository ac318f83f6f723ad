import hashlib
import re
from random import Random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import exact_dedup, exact_groups, sha256

SCHEMA = "doc_id bigint, text string, digest string, kept int, n string"


def plain(rows):
    norm = {}
    groups = {}
    for i, text, *_ in rows:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups.setdefault(t, []).append(i)
        norm.setdefault(i, set()).add(t)
    out = []
    for i, text, *_ in rows:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rnd = Random(1)
    texts = ["", " ", None, "a b", "a  b", "a\tb", "a\u00a0b", "A b", "é" * 50, "x " * 40_000, "x\n" * 40_000, "same"]
    made = [(i, rnd.choice(texts), "d", 1, None) for i in range(120)]
    made += [(500 + i, f"only {i}", None, None, None) for i in range(30)]
    made += [(None, "same", None, None, None), (None, "nobody else", None, None, None), (3, made[3][1], "d", 1, None)]
    return made + [(10_000 + i, "copies of one text", "d", 0, "n") for i in range(700)]


def found(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept, r.sha) for r in df.select("*", F.lower(F.hex("digest")).alias("sha")).collect()), key=str)


def test_groups(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    assert found(exact_groups(df)) == plain(rows())


def test_digest_collisions_are_told_apart(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    weak = exact_groups(df, digest=lambda c: F.pmod(F.crc32(c), F.lit(3)))
    got = sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in weak.collect()), key=str)
    assert got == sorted((x[:4] for x in plain(rows())), key=str)


@pytest.mark.parametrize("most_bits", [None, 64])
def test_rows_that_stay(spark, most_bits):
    """One row a text, also of repeated rows, of null ids, and when the filter lets all rows through or the digest collides."""
    given = [*rows(), (3, "another text of row 3", "z", 1, None), *[(77, "twice", c, 1, None) for c in "bab"]]
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    first = {}
    for r in given:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        first[t] = min(first.get(t, (True, 0)), (r[0] is None, r[0] or 0))
    for digest in (sha256, lambda c: F.pmod(F.crc32(c), F.lit(3))):
        out = exact_dedup(df, digest=digest, most_bits=most_bits)
        assert out.columns == df.columns
        got = out.collect()
        assert sorted((re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id is None, r.doc_id or 0) for r in got) == sorted((t, *i) for t, i in first.items())
        assert [r.digest for r in got if r.text == "twice"] == ["a"]


def test_any_filter_gives_the_same_groups(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert found(exact_groups(df, most_bits=64)) == plain(rows())


def test_unique_texts_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, f"text {i % 90}") for i in range(100)], "doc_id bigint, text string")
    plan = exact_dedup(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate [digest") == 2


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_groups(df).count() == 0 and exact_dedup(df).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    assert found(exact_groups(one)) == [(1, 1, 1, True, hashlib.sha256(b"").hexdigest())]
