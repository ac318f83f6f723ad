"""Connected components of a graph of links, by alternating large and small stars.

Every round sends each node's larger neighbours, then its smaller ones, to the smallest node it knows; links turn into
stars around the smallest node of each component after a number of rounds that grows with the logarithm of the size.
Nothing is gathered in one place: a node's smallest neighbour is an aggregate, and goes back to its links by a salted
join, so a node with very many links is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import for_each_salt, materialise, salted, tidy

SALTS = 8


def _smallest(links: DataFrame) -> DataFrame:
    """Add ``m``, the smallest of a node ``u`` and its neighbours ``v``, to each link."""
    least = for_each_salt(links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), SALTS)
    return salted(links, "v", SALTS).join(least, ["u", "__salt"]).drop("__salt")


@tidy
def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(id, component) for every node that has a link to another; ``component`` is the smallest id it can reach."""
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    e = materialise(e)
    before = None
    for _ in range(most_rounds):
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        held = _smallest(large)
        small = held.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("l")).select("l.*").filter("u > v")
        e = materialise(small.distinct())
    else:
        raise RuntimeError(f"links didn't settle in {most_rounds} rounds")
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
