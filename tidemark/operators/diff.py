"""Differences between two snapshots of a collection.

Output is a long change log (``CHANGE``).  Keyed collections take one full outer join, whose keys are grouped first where
they may repeat; text and feed collections take anti joins on their key expression, which read only the key of the other side.
Keys are compared as strings.  Spark picks broadcast, hash or sort-merge by size, and AQE splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import changed, default, fields_changed, filled, key, prefix

HEADER_FIELDS = ("etag", "last_modified", "content_length", "partial_hash")


@dataclass(frozen=True)
class Transition:
    """A change of ``field`` of an entity that both snapshots have.

    rule: ``changed``; ``changed_to_value`` (and the new value is there); ``became_set`` (from nothing to something);
    ``pair`` (exactly ``before`` to ``after``).
    """

    kind: str
    field: str
    rule: str = "changed"
    before: str | None = None
    after: str | None = None

    def holds(self) -> Column:
        o, n = F.col(f"o.{self.field}"), F.col(f"n.{self.field}")
        if self.rule == "changed":
            return changed(o, n)
        if self.rule == "changed_to_value":
            return changed(o, n) & filled(n.cast("string"))
        if self.rule == "became_set":
            return ~filled(o.cast("string")) & filled(n.cast("string"))
        if self.rule == "pair":
            return o.eqNullSafe(F.lit(self.before)) & n.eqNullSafe(F.lit(self.after))
        raise ValueError(self.rule)


def last_wins(df: DataFrame, by: str, order: str | Sequence[str]) -> DataFrame:
    """One record a key, the last in order."""
    order = [order] if isinstance(order, str) else list(order)
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return df.filter(F.col(by).isNotNull()).groupBy(key(by).alias("__key")).agg(F.max_by(F.struct(*df.columns), at).alias("r")).select("r.*")


def keyed_diff(old: DataFrame, new: DataFrame, by: str, transitions: Sequence[Transition] = (), added: bool = True, removed: bool = True, order: str | Sequence[str] | None = None) -> DataFrame:
    """(entity_key, kind, old_value, new_value, old, new) in one pass; ``old`` and ``new`` are the records.

    ``order`` names the position columns where keys may repeat inside a snapshot (the last record then counts).
    """
    if set(old.columns) == set(new.columns):
        old = old.select(*new.columns)
    if order:
        old, new = last_wins(old, by, order), last_wins(new, by, order)
    o = old.filter(F.col(by).isNotNull()).select(key(by).alias("entity_key"), F.struct(*old.columns).alias("o"))
    n = new.filter(F.col(by).isNotNull()).select(key(by).alias("entity_key"), F.struct(*new.columns).alias("n"))
    nothing = F.lit(None).cast("string")
    event = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("old_value"), b.alias("new_value"))
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    events = [F.when(F.col("o").isNull(), event("added", nothing, nothing))] * added + [F.when(F.col("n").isNull(), event("removed", nothing, nothing))] * removed
    events += [F.when(both & t.holds(), event(t.kind, F.col(f"o.{t.field}").cast("string"), F.col(f"n.{t.field}").cast("string"))) for t in transitions]
    found = o.join(n, "entity_key", "full_outer").withColumn("e", F.explode(F.array(*events))).filter("e IS NOT NULL")
    return found.select("entity_key", "e.kind", "e.old_value", "e.new_value", F.col("o").alias("old"), F.col("n").alias("new"))


def added_rows(old: DataFrame, new: DataFrame, by: Sequence[Column], probe: Column | None = None) -> DataFrame:
    """Rows of ``new`` whose key no row of ``old`` has (duplicates in ``new`` stay); ``probe`` limits the old rows that count."""
    names = [f"__k{i}" for i in range(len(by))]
    seen = old if probe is None else old.filter(probe)
    return new.withColumns(dict(zip(names, by, strict=True))).join(seen.select(*(c.alias(n) for c, n in zip(by, names, strict=True))), names, "left_anti").drop(*names)


def text_diff(old: DataFrame, new: DataFrame, text: str = "text", n: int = 120, group: Sequence[str] = (), both: bool = True) -> DataFrame:
    """Rows added (and removed) by the first ``n`` characters of their text within their group.

    Rows without text are always added and removed: an empty key is never in the other side's set.
    """
    by = [*(F.col(g) for g in group), prefix(text, n)]
    gone = added_rows(new, old, by, filled(text)).withColumn("kind", F.lit("removed"))
    fresh = added_rows(old, new, by, filled(text)).withColumn("kind", F.lit("added"))
    return fresh.unionByName(gone) if both else fresh


def cells_key(cells: str, n: int) -> Column:
    """The first ``n`` cell values joined by a space; cells are (name, value) in column order."""
    return default(F.array_join(F.transform(F.slice(F.col(cells), 1, n), lambda c: default(c["value"])), " "))


def cells_diff(old: DataFrame, new: DataFrame, cells: str = "cells", n: int = 1) -> DataFrame:
    return added_rows(old, new, [cells_key(cells, n)]).withColumn("kind", F.lit("added"))


def feed_diff(old: DataFrame, new: DataFrame, group: str, keys: Sequence[str] = ("id", "title", "link")) -> DataFrame:
    """D12 (keys id, title), D16: items of a group that are new by the first of ``keys`` they have."""
    return added_rows(old, new, [F.col(group), F.coalesce(*keys, F.lit(""))]).withColumn("kind", F.lit("added"))


def header_diff(old: DataFrame, new: DataFrame, name: str = "doc_name", group: Sequence[str] = ()) -> DataFrame:
    """Documents of either side whose headers differ; a missing side counts as empty, the new URL goes first."""
    by = [*group, name]
    o, n = (df.select(*by, F.struct("url", *HEADER_FIELDS).alias(side)) for df, side in ((old, "o"), (new, "n")))
    found = o.join(n, by, "full_outer").filter(fields_changed("o", "n", HEADER_FIELDS))
    values = [default(f"{side[0]}.{f}").alias(f"{side}_{f}") for f in ("last_modified", "etag", "content_length", "partial_hash") for side in ("old", "new")]
    return found.select(*by, F.lit(True).alias("changed"), *values, F.coalesce("n.url", "o.url", F.lit("")).alias("url"))


def schema_warnings(old_version: int | None, new_version: int | None, current: int) -> list[str]:
    """Versions that differ only warn; a missing one is 1."""
    a, b = old_version or 1, new_version or 1
    out = [f"snapshots have schema versions {a} and {b}"] if a != b else []
    return out + [f"a snapshot has schema version {v}, the engine has {current}" for v in {a, b} if v != current]
