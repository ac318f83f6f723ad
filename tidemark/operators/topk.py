"""First rows of each group, latest days, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """Planned with a partial limit in each group before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def latest_days(df: DataFrame, n: int, day: str = "run_date") -> DataFrame:
    """L1: the n latest days there are, oldest first."""
    return df.select(day).distinct().orderBy(F.desc(day)).limit(n).orderBy(day)


def prior_day(df: DataFrame, today, day: str = "run_date") -> DataFrame:
    """L2: the latest day that isn't today's (a later one counts too)."""
    return df.filter(F.col(day) != F.lit(today)).agg(F.max(day).alias(day))


def retention(df: DataFrame, keep: int, day: str = "run_date") -> DataFrame:
    """L3: (day, kept) of every day; the ``keep`` latest stay.  Days are few, so one sort of them is enough."""
    return df.select(day).distinct().withColumn("kept", F.row_number().over(Window.orderBy(F.desc(day))) <= keep)


def capped_list(df: DataFrame, order: Sequence, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows, and how many more there are."""
    return df.orderBy(*order).limit(n), df.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
