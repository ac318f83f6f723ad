"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

1. Targets: ``share`` of all words is dealt to the sources by weight; no target is above ``epochs`` times its source's
   size, and what is over goes to the others by weight (the level at which that holds is found by a running sum over
   the sources sorted by size/weight).
2. Blocks: the mix has equal blocks of ``block`` words (all words of the mix over 2**20, at least one).  The highest
   quotients target/(2k+1) give each source its blocks, then the highest quotients size/(2k+1) give each of the
   source's shards (by a hash of id and text, some ``SHARD_ROWS`` documents each, however many there are) its own.
3. Selection: a shard lays its documents in a seeded order.  Its quota is taken as whole passes, then as a run of
   blocks from a seeded block on, around the end of the shard.  A document's share is the overlap of two intervals.

All windows run over sources (which are few: their names are compared in one task), shards of one source or documents of one
shard, never over a whole source.

Cases: a null text has size 0; null is a source of its own, the last; sources are sorted by code point; documents of
size 0 and sources without words take nothing; a very long document is taken whole or not, or in part by ``taken``; rows with the same id are taken as separate documents; rows with a null
id come out like others (rows of one source, id and text, as
often as the most taken of them); other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialise, named_apart, read, rows_again, tidy

WEIGHTS = (3, 1, 2)
SHARE, EPOCHS, BLOCKS, SHARD_ROWS, SEED = 1.5, 2, 1 << 20, 20_000, 20240229


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def hashed(seed: int, id: Column, text: Column) -> Column:
    """By id and text, so that one id's texts are laid apart; a hash passes over its null arguments."""
    return F.xxhash64(F.lit(seed), id, text)


def water_level(sources: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to (key, source_size, weight): weight times the one level that shares out everything under the caps."""
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "key")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = (
        sources.withColumn("cap", F.lit(epochs) * F.col("source_size"))
        .withColumn("filled", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.lit(share) * F.sum("source_size").over(every) - F.col("filled")) / F.col("open"))
    )
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every)
    at = x.withColumn("at", level)
    return at.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("at") * F.col("weight"), F.col("cap")))).select(*sources.columns, "target")


def sainte_lague(df: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """Add ``quota``: the seats of each group, dealt to its keys by the highest quotients weight/(2k+1), ties by key.

    With the right divisor each of ``n`` keys is rounded by a half at most, so all shares together are within n/2 of the seats, and a
    key's share is within that of its part of ``seats - n/2`` and ``seats + n/2``.  What lies below is won, what lies above is
    lost, and the quotients between, some n of all keys together, are ranked; rows stay in proportion to the keys.
    """
    g = Window.partitionBy(*group)
    total, n = F.sum(weight).over(g), F.count("*").over(g)
    x = df.withColumns({"__seats": F.when(total > 0, F.col(seats)).otherwise(0), "__part": F.coalesce(F.col(weight) / F.nullif(total.cast("double"), F.lit(0.0)), F.lit(0.0)), "__n": n})
    # A seat of slack either way, as these shares are rounded themselves.
    low = F.floor(F.col("__part") * F.greatest(F.lit(0), F.col("__seats") - F.col("__n") / 2) - 1.5)
    high = F.ceil(F.col("__part") * (F.col("__seats") + F.col("__n") / 2) + 1.5)
    x = x.withColumns({"__base": F.greatest(F.lit(0), low).cast("long"), "__top": high.cast("long")})
    x = x.withColumn("__open", F.col("__seats") - F.sum("__base").over(g))
    tries = x.select(*group, key, "__base", "__open", weight, F.explode(F.sequence("__base", "__top")).alias("__k"))
    best = Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("__k") + 1)).desc(), key, "__k")
    won = tries.withColumn("__rank", F.row_number().over(best)).groupBy(*group, key).agg((F.first("__base") + F.count_if(F.col("__rank") <= F.col("__open"))).alias("quota"))
    return df.join(won, [*group, key], "left")


def source_targets(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """(key, source_size, source_rows, target): the sources by code point, null last, with the weights in turn."""
    by_source = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    return water_level(weighed.drop("source"))


@tidy
def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """(id, size, source_size, target, taken, copies, key, order) for every row; ``copies`` is ``taken`` to whole documents."""
    id, text, source = F.col(id_col), F.col(text_col), F.col(source_col)
    sizes = materialise(
        docs.select(
            id.alias("id"), source.cast("string").alias("source"), source_key(source).alias("key"), n_words(text).alias("size"),
            hashed(seed, id, text).alias("order"), hashed(seed + 1, id, text).alias("spread"),
        )
    )
    targets = source_targets(sizes, weights)
    mixed = Window.partitionBy("all")
    targets = targets.withColumn("all", F.lit(0)).withColumn("sum", F.sum("target").over(mixed))
    targets = targets.withColumn("block", F.greatest(F.lit(1), F.floor(F.col("sum") / BLOCKS)).cast("long")).withColumn("blocks", F.round(F.col("sum") / F.col("block")).cast("long"))
    targets = sainte_lague(targets, ["all"], "key", "target", "blocks").withColumn("shards", F.ceil(F.col("source_rows") / shard_rows))
    targets = materialise(targets.select("key", "source_size", "target", "block", F.col("quota").alias("blocks"), "shards"))
    sizes = sizes.join(targets.select("key", "shards"), "key").withColumn("shard", F.pmod("spread", "shards")).drop("spread", "shards")

    by_shard = sizes.groupBy("key", "shard").agg(F.sum("size").alias("words")).join(targets.select("key", "block", "blocks"), "key")
    quotas = sainte_lague(by_shard, ["key"], "shard", "words", "blocks")
    take = F.least(F.col("quota") * F.col("block"), F.lit(EPOCHS) * F.col("words"))
    some = F.greatest(F.col("words"), F.lit(1))
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "key", "shard"), F.ceil(some / F.col("block"))) * F.col("block")
    quotas = quotas.select("key", "shard", "words", F.floor(take / some).cast("long").alias("passes"), (take % some).alias("rest"), start.alias("start"))

    laid = Window.partitionBy("key", "shard").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.withColumn("at", F.coalesce(F.sum("size").over(laid), F.lit(0)))
    at = at.join(quotas, ["key", "shard"]).join(targets.select("key", "source_size", "target"), "key")
    end, stop = F.col("at") + F.col("size"), F.col("start") + F.col("rest")
    run = F.greatest(F.lit(0), F.least(end, stop) - F.greatest("at", "start")) + F.greatest(F.lit(0), F.least(end, stop - F.col("words")) - F.col("at"))
    inside = (F.col("at") >= F.col("start")) & (F.col("at") < stop) | (F.col("at") < stop - F.col("words"))
    return at.select(
        "id", "size", "source_size", "target", (F.col("passes") * F.col("size") + run).cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.col("passes") + inside.cast("long")).otherwise(0).alias("copies"), "key", "order",
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: never, once or twice."""
    copies = mix(docs, id_col, text_col, source_col, weights).filter("copies > 0").groupBy("id", "key", "order").agg(F.max("copies").alias("copies"))
    copies = copies.select(F.col("id").alias("c_id"), F.col("key").alias("c_key"), F.col("order").alias("c_order"), "copies")
    id, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    rows = named_apart(docs, id=id, key=source_key(source), order=hashed(SEED, id, text))
    same = F.col("id").eqNullSafe(F.col("c_id")) & (F.col("key") == F.col("c_key")) & (F.col("order") == F.col("c_order"))
    out = rows.join(copies, same)
    return rows_again(out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")), docs)


def op10_mixing(spark, sf_dir):
    out = mix(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
