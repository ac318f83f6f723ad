"""All days at once against the chain of pairwise differences."""

from random import Random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.diff import Transition, keyed_diff
from tidemark.operators.history import history_diff, intervals

RULES = [Transition("status_change", "s"), Transition("sunset_change", "d", "changed_to_value"), Transition("removed_on", "d", "became_set"), Transition("archived", "s", "pair", "a", "b")]
SCHEMA = "day string, k string, s string, d string, pos int"


def made(spark, seed=3):
    rnd = Random(seed)
    rows = []
    for day in range(1, 15):
        if day in (4, 9, 10):  # no snapshot, or none with rows
            continue
        for k in range(40):
            for _ in range(rnd.choice([0, 1, 1, 1, 1, 2])):
                rows.append((f"2024-01-{day:02}", rnd.choice([f"k{k}"] * 30 + [None]), rnd.choice(["a", "b", None]), rnd.choice(["", None, "x", "y"]), len(rows)))
    return rows, spark.createDataFrame(rows + [(None, "k1", "a", "", 0)], SCHEMA)


@pytest.mark.parametrize("empty_day", [False, True])
def test_equal_to_the_chain(spark, empty_day):
    rows, df = made(spark)
    days = sorted({r[0] for r in rows} | ({"2024-01-09", "2024-01-20"} if empty_day else set()))
    given = spark.createDataFrame([(d,) for d in days], "day string") if empty_day else None
    got = sorted(map(str, map(tuple, history_diff(df.repartition(3), "day", "k", ["s", "d"], RULES, "pos", given).collect())))
    want = []
    for old, new in zip(days, days[1:]):
        a, b = (df.filter(F.col("day") == d).select("k", "s", "d", "pos") for d in (old, new))
        want += [(new, r.entity_key, r.kind, r.old_value, r.new_value) for r in keyed_diff(a, b, "k", RULES, order="pos").collect()]
    assert got == sorted(map(str, want)) and len(got) > 200
    assert {"added", "removed", "status_change", "sunset_change", "removed_on", "archived"} == {w[2] for w in want}


def test_two_shuffles_of_the_history(spark):
    """One of rows combined by key and day, one of these by key; the calendar, a row a day, is broadcast."""
    import re

    _, df = made(spark)
    plan = history_diff(df, "day", "k", ["s", "d"], RULES, "pos")._jdf.queryExecution().executedPlan().toString()
    by = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert sum("entity_key" in x for x in by) == 1 and sum("_groupingexpression" in x for x in by) == 1
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_intervals(spark):
    rows = [(f"2024-01-0{d}", "k", s, "", 0) for d, s in ((1, "a"), (2, "a"), (3, None), (4, None), (6, None), (7, "a"))] + [("2024-01-05", "other", "x", "", 0), ("2024-01-07", "new", "x", "", 0)]
    got = sorted(map(str, ((r.entity_key, r.record.s, r.valid_from, r.valid_to, r.days) for r in intervals(spark.createDataFrame(rows, SCHEMA), "day", "k", ["s"]).collect())))
    assert got == sorted(map(str, [("k", "a", "2024-01-01", "2024-01-02", 2), ("k", None, "2024-01-03", "2024-01-04", 2), ("k", None, "2024-01-06", "2024-01-06", 1), ("k", "a", "2024-01-07", None, 1), ("other", "x", "2024-01-05", "2024-01-05", 1), ("new", "x", "2024-01-07", None, 1)]))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert history_diff(df, "day", "k", ["s"], RULES[:1]).count() == intervals(df, "day", "k", ["s"]).count() == 0
