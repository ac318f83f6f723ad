"""Weights, scores and draws against plain counting."""

import hashlib
import math
import re
import zlib
from collections import Counter
from random import Random

from pyspark.sql import functions as F

from tidemark.llm import resampling as r

SCHEMA = "doc_id bigint, text string, score string, __place int"


def features(text, max_n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def plain(docs, aims, max_n=1, buckets=10_000, min_words=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, max_n)[1])
    t = Counter(bucket(f) for x in aims for f in features(x, max_n)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    rows = []
    for id, text in docs:
        words, found = features(text, max_n)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'null' if id is None else id}".encode()).hexdigest()[:8], 16)
        rows.append([id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((x for x in rows if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0]))
    for i, x in enumerate(fit[: len(fit) * percent // 100]):
        x[5] = i + 1
    return sorted(map(tuple, rows), key=str)


def texts(n, seed):
    rnd = Random(seed)
    vocabulary = ["Über", "der", "THE", "x1", "é—", "日本", "a", "b-c", "don't", " ", "Q" * 40] + [f"w{i}" for i in range(300)]
    return [" ".join(rnd.choices(vocabulary, k=rnd.choice([0, 3, 19, 20, 21, 80]))) for _ in range(n)]


def test_equal_to_plain_counting(spark):
    docs = [*enumerate(texts(400, 1)), (1000, None), (1001, ""), (1002, " .,;\t"), (None, "word " * 30), (5000, "long text " * 40_000)]
    aims = [*texts(30, 2), None]
    df = spark.createDataFrame([(*d, "own", 1) for d in docs], SCHEMA).repartition(3)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(aims)], "item_id int, text string")
    for max_n, buckets in ((1, 10_000), (3, 997), (2, 100_000)):
        got = sorted((tuple(x) for x in r.resample(df, target, max_n=max_n, buckets=buckets).collect()), key=str)
        assert got == plain(docs, aims, max_n, buckets)


def test_small_dictionaries_give_the_same(spark, monkeypatch):
    docs = list(enumerate(texts(200, 3)))
    f = r.Features(3, 500)
    whole = f.of([t for _, t in docs])
    monkeypatch.setattr(r, "KNOWN", 10)
    g, parts = r.Features(3, 500), []
    for i in range(0, 200, 7):
        parts.append(g.of([t for _, t in docs[i : i + 7]]))
    for k in range(3):
        assert [x for p in parts for x in p[k].tolist()] == whole[k].tolist()
    assert len(g.words) < 400


def test_each_tuple_is_hashed_once(monkeypatch):
    calls = Counter()
    real = zlib.crc32
    monkeypatch.setattr(r.zlib, "crc32", lambda data: calls.update([data]) or real(data))
    r.Features(2, 1000).of(["a b a b a b", "b a b", "a b"])
    assert calls == {b"a": 1, b"b": 1, b"a b": 1, b"b a": 1}


def test_ranks_over_repeated_rows_and_few_partitions(spark):
    rows = [(i % 7, 5) for i in range(3000)] + [(9, 6)]
    df = spark.createDataFrame(rows, "id int, score int").repartition(5)
    got = r.ranked(df, [F.col("score").desc(), F.col("id")]).orderBy("rank").collect()
    assert [x["rank"] for x in got] == list(range(1, 3002))
    assert [(x.score, x.id) for x in got] == sorted(((s, i) for i, s in rows), key=lambda x: (-x[0], x[1]))


def test_empty(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b", "", 1)], SCHEMA)
    assert r.resample(none, none).count() == 0
    assert r.resample(some, none).select("n_features", "rank").first() == (2, None)


def test_query(spark, sf_dir):
    docs = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    aims = [x.text for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted((tuple(x) for x in r.op11_resampling(spark, sf_dir).collect()), key=str)
    assert got == sorted(((x[0], *x[2:]) for x in plain(docs, aims)), key=str)
