"""Checks of a snapshot before it is written (V1-V6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vocab import FATAL_LIMITS, WARN_LIMITS


class SnapshotRejected(ValueError):
    """A collection is so small that its source must have failed."""


def checks(counts: DataFrame, fatal=FATAL_LIMITS, warn=WARN_LIMITS) -> DataFrame:
    """(domain, collection, n, least, level, ok) from (domain, collection, n); a missing collection counts 0."""
    rows = [(d, c, n, level) for level, limits in (("fatal", fatal), ("warn", warn)) for (d, c), n in limits.items()]
    limits = counts.sparkSession.createDataFrame(rows, "domain string, collection string, least long, level string")
    out = limits.join(counts, ["domain", "collection"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("domain", "collection", "n", "least", "level", (F.col("n") >= F.col("least")).alias("ok"))


def require(found: DataFrame) -> list[str]:
    """Raise for a fatal check that fails; return what only warns."""
    bad = found.filter("NOT ok").collect()
    said = [f"{r.domain}.{r.collection} has {r.n} rows, expected {r.least} at least" for r in bad]
    if any(r.level == "fatal" for r in bad):
        raise SnapshotRejected("; ".join(s for s, r in zip(said, bad, strict=True) if r.level == "fatal"))
    return said


def first_run(changes: DataFrame) -> DataFrame:
    """V5: without an earlier snapshot only document changes count."""
    return changes.filter("kind = 'header_changed'")
