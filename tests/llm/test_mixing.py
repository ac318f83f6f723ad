from fractions import Fraction
from random import Random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def plain_targets(sizes: dict, share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, fixed = Fraction(share) * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        rest = total - sum(fixed.values())
        shares = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if shares[s] > epochs * sizes[s]]
        if not over:
            return fixed | shares
        fixed |= {s: Fraction(epochs * sizes[s]) for s in over}


def plain_apportionment(weights: dict, seats: int):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        got[min(weights, key=lambda k: (-weights[k] / (2 * got[k] + 1), k))] += 1
    return got


def test_apportionment_by_highest_quotients(spark):
    rnd = Random(3)
    cases = [{f"k{i:02}": rnd.choice([0.0, 1.0, 2.5, 100.0, rnd.random() * 50]) for i in range(rnd.randint(1, 14))} for _ in range(8)]
    rows = [(g, k, w, 37 * g + 3) for g, case in enumerate(cases) for k, w in case.items()]
    df = spark.createDataFrame(rows, "g int, k string, w double, n int")
    got = {(r.g, r.k): r.quota for r in mixing.sainte_lague(df, ["g"], "k", "w", "n").collect()}
    for g, case in enumerate(cases):
        want = plain_apportionment(case, 37 * g + 3) if sum(case.values()) else dict.fromkeys(case, 0)
        assert {k: got[g, k] for k in case} == want


DOCS = "doc_id bigint, text string, source string, size string, `order` int"


def test_many_equal_keys(spark):
    """Rows in proportion to the keys, however many seats rounding moves: 0.6 seats for each of many equal keys."""
    import time

    for n, seats in ((300, 180), (300, 211), (100_000, 60_000)):
        df = spark.range(n).select(F.lit(1).alias("g"), "id", F.lit(7.0).alias("w"), F.lit(seats).alias("n"))
        start = time.time()
        got = {r.id: r.quota for r in mixing.sainte_lague(df, ["g"], "id", "w", "n").collect()}
        assert n < 1000 or time.time() - start < 30
        assert got == (plain_apportionment(dict.fromkeys(range(n), 7.0), seats) if n < 1000 else {i: int(i < seats) for i in range(n)})


def test_taken_against_a_plain_mix(spark):
    """Each document's part of the mix from the definition: whole passes over its shard, then the run of words from the start block on."""
    rnd = Random(8)
    rows = [(i, " ".join("w" * rnd.choice([0, 1, 7, 30])), "ab"[i % 3 > 0], None, None) for i in range(500)]
    df = spark.createDataFrame(rows, DOCS)
    shard_rows, size = 60, {r[0]: len(r[1].split()) for r in rows}
    got = {r.id: r for r in mixing.mix(df, shard_rows=shard_rows).collect()}
    S = mixing.SEED
    seen = df.select("doc_id", "source", F.xxhash64(F.lit(S), "doc_id", "text").alias("order"), F.xxhash64(F.lit(S + 1), "doc_id", "text").alias("spread")).collect()
    targets = plain_targets({s: sum(size[r.doc_id] for r in seen if r.source == s) for s in "ab"})
    blocks = plain_apportionment(targets, round(sum(targets.values())))  # blocks of one word
    for s in "ab":
        mine = [r for r in seen if r.source == s]
        n = -(-len(mine) // shard_rows)
        shards = {k: sorted((r for r in mine if r.spread % n == k), key=lambda r: (r.order, r.doc_id)) for k in range(n)}
        words = {k: sum(size[r.doc_id] for r in v) for k, v in shards.items() if v}
        quota = plain_apportionment({k: float(w) for k, w in words.items()}, blocks[s])
        for k, w in words.items():
            take = min(quota[k], 2 * w)
            first = spark.range(1).select(F.pmod(F.xxhash64(F.lit(S + 2), F.lit("=" + s), F.lit(k).cast("long")), F.lit(w))).first()[0]
            chosen, at = {(first + i) % w for i in range(take % w)}, 0
            for r in shards[k]:
                here = range(at, at + size[r.doc_id])
                at += size[r.doc_id]
                assert got[r.doc_id].taken == take // w * len(here) + len(chosen & set(here)), (s, k, r.doc_id)


def test_columns_with_the_names_used_inside(spark):
    schema = "doc_id bigint, text string, source string, __copy int, __key string, __id int, __copies int, copies int, copy int, row string, key string, `order` int, c_id int"
    rows = [(i, f"a b {i}", "s" if i % 3 else "t", 777, "k", 1, 2, 3, 4, "r", "key", 5, 6) for i in range(200)]
    out = mixing.mixed_documents(spark.createDataFrame(rows, schema))
    assert set(map(tuple, out.collect())) <= set(rows) and out.count() > 200


def test_targets_and_taken(spark):
    rnd = Random(5)
    rows = [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.choice([0, 1, 5, 40, 400]))), rnd.choice(["a", "b", "b", "b", "c", "É", None]), "x", 1) for i in range(600)]
    rows += [(1000, None, "a", None, None), (1001, " \t\x0b\n", "empty", None, None), (1002, "long " * 30_000, "z", "x", 2), (5, "w w", rows[5][2], "x", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    source = {i: s for i, _, s, _, _ in rows}
    for r in got:
        sizes[source[r.id]] = sizes.get(source[r.id], 0) + r.size
        taken[source[r.id]] = taken.get(source[r.id], 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[source[r.id]]
        assert r.target == pytest.approx(float(want[source[r.id]]))
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 2 for s in want)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixed_documents_repeat_whole_rows(spark):
    rows = [(i, "a b c d e", "s" if i % 3 else "t", "x", i) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    n = dict(out.groupBy("source").count().collect())
    want = plain_targets({"s": 3000, "t": 1500})
    assert all(abs(5 * n[s] - want[s]) <= 0.12 * float(want[s]) for s in want)
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix(df).count() == 0
    assert mixing.mixed_documents(df).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None, None, None)], DOCS)).select("size", "taken", "target").first() == (0, 0, 0.0)


def test_query(spark, sf_dir):
    got = mixing.op10_mixing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()
    import re

    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    assert {r.doc_id: r["size"] for r in got} == size
    total = {}
    for i, n in size.items():
        total[source[i]] = total.get(source[i], 0) + n
    want, taken = plain_targets(total), {}
    for r in got:
        assert r.target == pytest.approx(float(want[source[r.doc_id]]))
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in want)


def test_rows_without_an_id_are_mixed_like_others(spark):
    rows = [(None if i % 2 else i, f"a b c d {i}", "s" if i % 3 else "t", "x", i) for i in range(900)]
    out = mixing.mixed_documents(spark.createDataFrame(rows, DOCS)).collect()
    taken = [tuple(r) for r in out]
    assert set(taken) <= set(rows) and max(map(taken.count, set(taken))) <= 2
    want = plain_targets({"s": 3000, "t": 1500})
    assert all(abs(5 * sum(r.source == s for r in out) - want[s]) <= 0.12 * float(want[s]) for s in want)
    assert 0.8 < sum(r.doc_id is None for r in out) / sum(r.doc_id is not None for r in out) < 1.25


def test_shards_follow_the_source(spark):
    """Whatever the number of documents a shard, the sources' words come near their targets; more documents make more shards."""
    rows = [(i, "w " * (1 + i % 5), "a" if i % 3 else "b", None, None) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS)
    for shard_rows in (20, 10_000):
        got = mixing.mix(df, shard_rows=shard_rows).collect()
        for target in {r.target for r in got}:
            taken = sum(r.taken for r in got if r.target == target)
            assert abs(taken - target) <= 2 * 900 / shard_rows + 2
        assert all(r.taken <= 2 * r.size for r in got)
    plan = mixing.mix(df, shard_rows=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod" in plan and "shards" in plan
