"""Exact deduplication by skew-safe combining.

1. Every text gets a digest.  A Bloom filter of the digests that repeat, of a fixed size at most, goes to the tasks; a row that
   it rules out is alone with its text and stays where it is.
2. The other rows are combined with their *full text* in the grouping key: locally (the map side of the
   aggregation), then within (digest, text, salt), then the winners of the salts within (digest, text).  A group that
   holds a third of all rows so arrives as one row from each map task, in ``salts`` tasks.  A unique text that the filter
   let through is a group of one.
3. :func:`exact_dedup` carries whole rows through this, so what comes out stays and nothing is joined back.
   :func:`exact_groups` joins the winners' ids back to the rows by digest, without texts.  Where different texts share a digest they go
   back by digest and text.

Cases: a null text counts as empty; texts of white space only are equal to each other (one space), not to empty ones; very long
texts are compared whole like any other; null ids count in ``group_size`` and lose to any other id.  In the groups, rows with the same id and
text are kept or not together; of the rows that stay there is one for each text, whatever repeats (of equal ids, the
first by its other columns), so a group without any id keeps one row too.  Other columns are
carried along whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SALTS, bloom, computed, for_each_salt, materialise, named_apart, rows_again, salted, tidy

#: White space that isn't a single space already.
LOOSE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), LOOSE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def repeated(digests: DataFrame) -> DataFrame:
    return materialise(digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"))


@tidy
def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = SALTS, most_bits: int | None = None) -> DataFrame:
    """(id, digest, keep_id, group_size, kept) for every row of ``docs``; ``digest`` may collide, and the filter may let all rows through."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = computed(computed(base, body=normalised(F.col("text"))).drop("text"), digest=digest(F.col("body")))
    digests = materialise(base.select("id", "digest"))
    may_repeat = bloom(repeated(digests), most_bits)
    classes = (
        salted(base.filter(may_repeat("digest")), "id", salts)
        .groupBy("digest", "body", "__salt").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
        .groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    )
    winners = materialise(classes.groupBy("digest").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")).filter("n > 1"))
    found = salted(digests, "id", salts).join(for_each_salt(winners, salts), ["digest", "__salt"], "left").drop("__salt")
    collisions = winners.filter("texts > 1").select("digest")
    if collisions.count():
        may_collide = bloom(collisions, most_bits)
        apart = salted(base.filter(may_collide("digest")), "id", salts)
        by_text = apart.join(for_each_salt(classes.join(collisions, "digest", "left_semi"), salts), ["digest", "body", "__salt"])
        found = found.filter("texts IS NULL OR texts = 1").drop("texts").unionByName(by_text.select("digest", "id", "keep_id", "n"))
    keep = F.coalesce("keep_id", "id")
    return found.select("id", "digest", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"))


@tidy
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, salts: int = SALTS, most_bits: int | None = None) -> DataFrame:
    """One row of ``docs`` for each text, with all its columns."""
    id, text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    base = computed(computed(named_apart(docs), body=normalised(text)), digest=digest(F.col("body")))
    may_repeat = bloom(repeated(base.select("digest")), most_bits)("digest")
    others = [F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in (id_col, text_col)]
    order = F.struct(id.isNull(), id, F.to_json(F.struct(*others)) if others else F.lit(""), F.xxhash64(text))
    rows = base.filter(may_repeat).select("digest", "body", "row", F.pmod(F.xxhash64(id), F.lit(salts)).alias("salt"), order.alias("order"))
    first = F.min_by(F.struct("order", "row"), "order").alias("first")
    winners = rows.groupBy("digest", "body", "salt").agg(first).select("digest", "body", "first.*").groupBy("digest", "body").agg(first)
    return rows_again(base.filter(~may_repeat).select("row").unionByName(winners.select("first.row")), docs)


def op8_exact_dedup(spark, sf_dir):
    from tidemark.llm.common import read

    out = exact_groups(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
