"""Differences over a whole history of snapshots (D1-D8, D18 day by day), all days in one pass.

A history is a table of (day, key, fields).  Days get dense numbers, so the day before is the number before, whatever the calendar says; the records of a key
are laid out by day, each with the one before and the one after.  A record whose key wasn't there the day before is added, one whose key isn't there the
day after is removed then, and the fields of records on neighbouring days are compared.  The result is that of comparing each day with
the day before it, all days at once; the first day has nothing before it and is no change.  :func:`intervals` gives the spans in which a key's record stayed the same.

Where a key repeats in a day, the last record by ``order`` counts.  Rows without a key or a day are no records.  Rows are combined to one a key and day before
they are shuffled, and these are shuffled once more, by key; the only group is a key's days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import changed, key
from tidemark.operators.diff import Transition


def calendar(history: DataFrame, day: str, by: str, days: DataFrame | None = None) -> DataFrame:
    """(day, number, last): the snapshot days in order, one row each, so small whatever a day holds.

    ``days``: all snapshot days (a column ``day``), where some may have no records at all; else those that occur.
    """
    seen = history.filter(F.col(by).isNotNull()).select(F.col(day).alias("day")) if days is None else days.select("day")
    dense = seen.filter("day IS NOT NULL").distinct().withColumn("number", F.row_number().over(Window.orderBy("day")))
    return dense.withColumn("last", F.max("number").over(Window.partitionBy()))


def numbered(history: DataFrame, day: str, by: str, fields: Sequence[str], order: str | Sequence[str] | None = None, days: DataFrame | None = None) -> DataFrame:
    """(entity_key, day, number, last, record): one record a key and day."""
    at = [order] if isinstance(order, str) else list(order or ())
    record = F.struct(*fields)
    pick = F.max_by(record, F.struct(*at)) if at else F.max(record)
    rows = history.filter(F.col(by).isNotNull() & F.col(day).isNotNull())
    one = rows.groupBy(F.col(day).alias("day"), key(by).alias("entity_key")).agg(pick.alias("record"))
    return one.join(F.broadcast(calendar(history, day, by, days)), "day")  # a row a day, whatever the days hold


def history_diff(history: DataFrame, day: str, by: str, fields: Sequence[str], transitions: Sequence[Transition] = (), order: str | Sequence[str] | None = None, days: DataFrame | None = None) -> DataFrame:
    """(day, entity_key, kind, old_value, new_value) of every day against the day before it."""
    line = Window.partitionBy("entity_key").orderBy("number")
    rows = numbered(history, day, by, fields, order, days)
    x = rows.withColumns({"o": F.lag("record").over(line), "before": F.lag("number").over(line), "after": F.lead("number").over(line)})
    nothing = F.lit(None).cast("string")
    event = lambda kind, gone, a, b: F.struct(F.lit(kind).alias("kind"), F.lit(gone).alias("gone"), a.alias("old_value"), b.alias("new_value"))
    follows = F.col("before") == F.col("number") - 1
    events = [
        F.when((F.col("number") > 1) & ~F.coalesce(follows, F.lit(False)), event("added", False, nothing, nothing)),
        F.when((F.col("number") < F.col("last")) & ~F.coalesce(F.col("after") == F.col("number") + 1, F.lit(False)), event("removed", True, nothing, nothing)),
    ]
    for t in transitions:
        values = (F.col(f"{side}.{t.field}").cast("string") for side in ("o", "n"))
        events.append(F.when(follows & t.holds(), event(t.kind, False, *values)))
    found = x.withColumnRenamed("record", "n").withColumn("e", F.explode(F.array(*events))).filter("e IS NOT NULL")
    # A removal counts on the day after the last one that had the key.
    number = F.col("number") + F.col("e.gone").cast("int")
    told = found.select(number.alias("next_number"), "entity_key", "e.kind", "e.old_value", "e.new_value")
    named = calendar(history, day, by, days).select(F.col("day").alias("next_day"), F.col("number").alias("next_number"))
    return told.join(F.broadcast(named), "next_number").select(F.col("next_day").alias("day"), "entity_key", "kind", "old_value", "new_value")


def intervals(history: DataFrame, day: str, by: str, fields: Sequence[str], order: str | Sequence[str] | None = None, days: DataFrame | None = None) -> DataFrame:
    """(entity_key, record, valid_from, valid_to, days): spans of neighbouring days with the same record; ``valid_to`` is null while it holds on the last day."""
    line = Window.partitionBy("entity_key").orderBy("number")
    rows = numbered(history, day, by, fields, order, days)
    same = (F.lag("number").over(line) == F.col("number") - 1) & ~changed(F.lag("record").over(line), F.col("record"))
    span = F.sum(F.coalesce(~same, F.lit(True)).cast("int")).over(line)
    by_span = rows.withColumn("span", span).groupBy("entity_key", "span")
    out = by_span.agg(F.first("record").alias("record"), F.min("day").alias("valid_from"), F.max("day").alias("until"), F.count("*").alias("days"), F.max(F.col("number") == F.col("last")).alias("open"))
    return out.select("entity_key", "record", "valid_from", F.when(~F.col("open"), F.col("until")).alias("valid_to"), "days")
