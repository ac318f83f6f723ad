"""A crash at any step of a day leaves no half day in daily, weekly or dashboard, and the next run makes up for it."""

import os

import pytest

from tests.engine.test_runs import snapshot
from tidemark.operators import quality
from tidemark.plans import daily

STEPS = ["write", "write_alerts", "write_text", "finish", "promote", "mark_delivered"]


class Crash(RuntimeError):
    pass


def seen(store):
    """What readers see: whole days, the days of the weekly log, the latest files."""
    top = [f for f in sorted(os.listdir(f"{store.root}/published")) if not f.startswith(("day=", "."))] if os.path.isdir(f"{store.root}/published") else []
    return store.finished(), store.logged(), top


def test_crashes(spark, tmp_path, monkeypatch):
    for step in STEPS:
        store, sent = daily.Store(spark, str(tmp_path / step)), []
        store.write(daily.empty_snapshot(spark) | snapshot(spark, 0), "2024-01-01")
        store.finish("2024-01-01")
        before, whole = seen(store), getattr(daily.Store, step)

        def crash(self, *a, **k):
            if step == "write":
                whole(self, *a, **k)  # in the middle: the tables are there
            raise Crash(step)

        with monkeypatch.context() as m:
            m.setattr(daily.Store, step, crash)
            with pytest.raises(Crash):
                daily.run_daily(store, lambda: snapshot(spark, 1), "2024-01-03", sent.append, log=lambda _: None)
        committed = STEPS.index(step) > STEPS.index("finish")
        if not committed:
            assert seen(store) == before and not sent and store.prior("2024-01-05") == "2024-01-01"
        again = daily.run_daily(store, lambda: snapshot(spark, 1), "2024-01-03", sent.append, log=lambda _: None)
        assert again["skipped"] == committed
        assert seen(store) == (["2024-01-01", "2024-01-03"], ["2024-01-03"], ["2024-01-03_diff.json", "changes.rss", "dashboard.html"])
        assert len(sent) == (2 if step == "mark_delivered" else 1) and set(sent) == {sent[0]}  # rather twice than never
        assert daily.run_daily(store, dict, "2024-01-03", sent.append)["sent"] is False and "(5)" in open(f"{store.root}/published/dashboard.html").read()


def test_a_rejected_day_leaves_nothing(spark, tmp_path):
    store = daily.Store(spark, str(tmp_path))
    short = daily.empty_snapshot(spark) | snapshot(spark, 0)
    short["products"] = short["products"].limit(49)
    with pytest.raises(quality.SnapshotRejected, match="niap.pcl has 49 rows"):
        daily.run_daily(store, lambda: short, "2024-01-01")
    assert store.days() == [] and store.finished() == [] and not any(f.endswith(".parquet") for _, _, fs in os.walk(tmp_path) for f in fs)


def test_counts_come_with_the_write(spark, tmp_path):
    """The checks' numbers are those of separate counts, taken in the jobs that write."""
    given = daily.empty_snapshot(spark) | snapshot(spark, 1)
    store = daily.Store(spark, str(tmp_path))
    got = {(r.domain, r.collection): r.n for r in store.write(given, "2024-01-01").collect()}
    want = {(r.domain, r.collection): r.n for r in daily.counts(given).collect()}
    assert got == {k: want.get(k, 0) for k in got} and got["niap", "pcl"] == 60 and got["csfc", "apl"] == 6
