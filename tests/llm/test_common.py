"""Salted copies, and intermediate tables: each operator sees and drops only its own, and none outlives what reads it."""

import gc
import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, queries
from tidemark.llm.common import bloom, for_each_salt, materialise, salted, sweep, tidy


def test_salted_copies_count_in_the_size_estimate(spark):
    table = materialise(spark.range(1000).select("id", F.md5(F.col("id").cast("string")).alias("text")))
    copies = for_each_salt(table, 16)
    size = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(size(copies)) >= 16 * int(size(table))
    assert copies.columns == ["id", "text", "__salt"]
    assert copies.count() == copies.distinct().count() == 16_000


def test_salted_join_keeps_nulls_and_ties(spark):
    left = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "n long, k string")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, v long")
    found = salted(left, "n", 8).join(for_each_salt(right, 8), ["k", "__salt"], "left").select("n", "v")
    assert sorted(map(tuple, found.collect())) == [(1, 10), (2, 10), (3, None), (4, None)]
    assert for_each_salt(right.limit(0), 8).count() == 0


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    return tmp_path


def left(spark, folder) -> list[str]:
    """What is left once nothing is read any more."""
    for _ in range(20):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        sweep(spark)
        if not os.listdir(folder):
            break
        time.sleep(0.25)
    return os.listdir(folder)


def test_tables_go_with_their_readers(spark, folder):
    def inner_results(n):
        rows, keys = materialise(spark.range(n)), materialise(spark.range(n))
        return rows.filter(bloom(keys)("id"))

    out = tidy(inner_results)(100)
    assert len(os.listdir(folder)) == 2  # a table, and the keys that only a subquery reads
    derived = out.select((F.col("id") + 1).alias("next"))
    del out
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    sweep(spark)
    assert derived.count() == 100
    del derived
    assert left(spark, folder) == []


def test_a_failing_operator_leaves_nothing(spark, folder):
    @tidy
    def inner():
        return materialise(spark.range(3))

    @tidy
    def outer():
        inner()
        materialise(spark.range(5))
        raise ValueError("stop")

    with pytest.raises(ValueError, match="stop"):
        outer()
    assert os.listdir(folder) == []


def test_operators_side_by_side(spark, folder):
    """Each query twice in eight threads: the same rows as alone, and no table is left."""
    sf = "/root/testdata/sf0.001"
    names = ["op2_embedding_dedup", "op6_minhash_dedup", "op8_exact_dedup", "op9_secret_scan", "op10_mixing", "op11_resampling", "op12_token_files"]
    found = queries.queries()
    rows = lambda name: sorted(map(str, found[name](spark, sf).collect()))
    alone = {n: rows(n) for n in names}
    with ThreadPoolExecutor(8) as pool:
        for name, got in zip(names * 2, pool.map(rows, names * 2)):
            assert got == alone[name], name
    assert left(spark, folder) == []
