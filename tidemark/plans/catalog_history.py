"""Registered queries over whole histories of snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import history
from tidemark.operators.diff import Transition
from tidemark.operators.kept_merge import KeptMerge
from tidemark.plans.catalog import MERGED, change_log, query, table
from tidemark.plans.schema import CHANGE
from tidemark.sources.landing import shared_root

#: A snapshot a day of each user's last event; no snapshot was taken on days that 7 divides.
DAYS_SQL = """h AS (SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS k, event_type AS s, CASE WHEN value < 50 THEN '' ELSE props END AS p FROM events WHERE day(ts) % 7 <> 0
  QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) = 1),
n AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT DISTINCT day FROM h)), r AS (SELECT * FROM h JOIN n USING (day)), t AS (SELECT max(i) AS top FROM n)"""


def daily(spark, sf):
    e = table(spark, sf, "events").filter(F.dayofmonth("ts") % 7 != 0)
    return e.select(F.to_date("ts").alias("day"), "user_id", F.col("event_type").alias("state"), F.when(F.col("value") < 50, "").otherwise(F.col("props")).alias("note"), "ts", "event_id")


TRANSITIONS = [Transition("status_change", "state"), Transition("sunset_change", "note", "changed_to_value")]


@query(f"""WITH {DAYS_SQL}
SELECT a.day, a.k AS entity_key, 'added' AS kind, CAST(NULL AS VARCHAR) AS old_value, CAST(NULL AS VARCHAR) AS new_value FROM r a LEFT JOIN r b ON b.k = a.k AND b.i = a.i - 1 WHERE a.i > 1 AND b.k IS NULL
UNION ALL SELECT n.day, a.k, 'removed', NULL, NULL FROM r a LEFT JOIN r b ON b.k = a.k AND b.i = a.i + 1 JOIN n ON n.i = a.i + 1 WHERE b.k IS NULL
UNION ALL SELECT a.day, a.k, 'status_change', b.s, a.s FROM r a JOIN r b ON b.k = a.k AND b.i = a.i - 1 WHERE a.s IS DISTINCT FROM b.s
UNION ALL SELECT a.day, a.k, 'sunset_change', b.p, a.p FROM r a JOIN r b ON b.k = a.k AND b.i = a.i - 1 WHERE a.p IS DISTINCT FROM b.p AND coalesce(a.p, '') <> ''""", "day")
def q_history_diff(spark, sf):
    """D18, J8 over all days at once: each against the one before it."""
    return history.history_diff(daily(spark, sf), "day", "user_id", ["state", "note"], TRANSITIONS, order=["ts", "event_id"])


@query(f"""WITH {DAYS_SQL}, m AS (SELECT *, CASE WHEN lag(i) OVER w = i - 1 AND lag(s) OVER w IS NOT DISTINCT FROM s THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY k ORDER BY i)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS span FROM m)
SELECT k AS entity_key, min(s) AS state, min(day) AS valid_from, CASE WHEN max(i) < (SELECT top FROM t) THEN max(day) END AS valid_to, count(*) AS days FROM g GROUP BY k, span""", "valid_from", "valid_to")
def q_history_intervals(spark, sf):
    """Spans of days in which a key's record stayed the same."""
    found = history.intervals(daily(spark, sf), "day", "user_id", ["state"], order=["ts", "event_id"])
    return found.select("entity_key", "record.state", "valid_from", "valid_to", "days")


@query(MERGED, "run_date")
def q_weekly_kept_up(spark, sf):
    """W1, W3-W7 kept up: seven days taken in one by one, each read once, then merged from the state."""
    root = f"{shared_root(spark)}/merge-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    log = change_log(spark, sf)
    kept = KeptMerge(spark, root, f"{CHANGE}, run_date date")
    for day in range(1, 8):
        kept.add(f"2024-01-{day:02}", log.filter(F.col("run_date") == F.lit(f"2024-01-{day:02}").cast("date")))
    return kept.merged().select("domain", "collection", "kind", "group_key", "run_date", "pos")
