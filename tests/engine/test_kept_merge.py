"""The merge that is kept up equals the merge of the window's logs, on each of twenty days."""

import datetime
from random import Random

from tidemark.operators.kept_merge import KeptMerge
from tidemark.operators.merge import merge_changes
from tidemark.plans.daily import CHANGE

SCHEMA = f"{CHANGE}, run_date date"
PLACES = [("niap", "pps", None, "added"), ("niap", "news", None, "added"), ("niap", "cctls", None, "removed"), ("cc_portal", "products", None, "added"), ("nist", "feeds", "F", "added"), ("nist", "feeds", "G", "added"), ("csfc", "pages", "apl", "added"), ("csfc", "pages", "apl", "removed"), ("nist", "documents", "D1", "header_changed"), ("nist", "documents", "D2", "header_changed")]


def made(day, rnd):
    rows = []
    for pos in range(rnd.choice([0, 0, 3, 10, 25])):
        domain, collection, group, kind = rnd.choice(PLACES[2:4] if day % 6 == 0 else PLACES)
        payload = rnd.choice([None, "a", "b", "c", "x" * 119 + rnd.choice("123") + rnd.choice("45")])
        rows.append((domain, collection, group, kind, "e", pos, f"{day}-{pos}", None, None, None, None, None, payload, datetime.date(2024, 1, day)))
    return rows


def test_equal_on_each_day(spark, tmp_path):
    rnd = Random(11)
    logs = {day: made(day, rnd) for day in range(1, 21)}
    kept, read = KeptMerge(spark, str(tmp_path), SCHEMA, 5), []
    for day, rows in logs.items():
        log = spark.createDataFrame(rows, SCHEMA)
        kept.add(f"2024-01-{day:02}", log)
        window = [r for d in range(max(1, day - 4), day + 1) for r in logs[d]]
        for strict in (True, False) if day % 5 == 0 else (True,):
            want = sorted(map(str, map(tuple, merge_changes(spark.createDataFrame(window, SCHEMA), strict).select("title", "run_date", "domain").collect())))
            assert sorted(map(str, map(tuple, kept.merged(strict).select("title", "run_date", "domain").collect()))) == want, (day, strict)
            read.append(len(want))
    assert len(kept.days()) == 5 and sum(read) > 200
    kept.add("2024-01-20", log)  # again
    assert sorted(map(str, kept.merged().collect())) == sorted(map(str, merge_changes(spark.createDataFrame(window, SCHEMA)).collect()))
