"""A merge of the last days kept up day by day (W1-W7): one new day is read, the day that leaves is taken back.

The state has a folder a day, made from that day's log alone, in four parts: the first row of each key of a list; the other rows of a list; each document's last
row; the rows of which only the first day counts.  A new day adds its folder and the day that leaves the window loses its own, which retracts it: a key that it came first for falls to the next
day that has it.  The merge reads the first rows and documents of all days, but the other two parts of the window's first day only: a
later day's repeats are never kept (the list is then touched by it), nor its rows of collections that keep the first day's.

A day without rows leaves an empty folder and isn't one of the days that count, as in :func:`tidemark.operators.merge.merge_changes`, whose result this equals.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.merge import LIST, frozen_rows, last_wins, merge_changes, row_key


class KeptMerge:
    """The state of a merge under ``root``; ``schema`` is that of a change log with its ``run_date``."""

    def __init__(self, spark: SparkSession, root: str, schema: str, window: int = 7):
        self.spark, self.root, self.schema, self.window = spark, root.rstrip("/"), schema, window

    def _folder(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def days(self) -> list[tuple[str, bool]]:
        """(day, has it rows) of the finished days in the state."""
        fs, p = self._folder(f"{self.root}/finished")
        return sorted(tuple(s.getPath().getName().split("=", 1)[1].split("+")) for s in fs.listStatus(p)) if fs.exists(p) else []

    def add(self, day: str, log: DataFrame) -> None:
        """Take in a day's log, and take back the days that leave the window.  Doing it again for a day changes nothing."""
        kind = F.when(F.col("kind") == "header_changed", "documents").when(frozen_rows(), "frozen").otherwise("lists")
        rows = log.withColumn("run_date", F.lit(datetime.date.fromisoformat(day))).withColumn("part", kind)
        documents = last_wins(rows.filter("part = 'documents'"), ["domain", "collection", "group_key"], ["run_date", "pos"])
        place = F.row_number().over(Window.partitionBy(*LIST, row_key()).orderBy("pos"))
        lists = rows.filter("part = 'lists'").withColumn("__n", place).withColumn("part", F.when(F.col("__n") == 1, "lists").otherwise("repeats")).drop("__n")
        out = documents.unionByName(lists).unionByName(rows.filter("part = 'frozen'"))
        folder = f"{self.root}/state/day={day}"
        out.write.mode("overwrite").partitionBy("part").parquet(folder)
        some = not self.spark.read.schema(f"{self.schema}, part string").parquet(folder).isEmpty()
        fs, p = self._folder(f"{self.root}/finished/day={day}+{'rows' if some else 'none'}")
        fs.create(p, True).close()
        for gone, kind in self.days()[: -self.window]:
            for path in (f"finished/day={gone}+{kind}", f"state/day={gone}"):
                fs, p = self._folder(f"{self.root}/{path}")
                fs.delete(p, True)

    def read(self, day: str, *parts: str) -> DataFrame:
        rows = self.spark.read.schema(f"{self.schema}, part string").parquet(f"{self.root}/state/day={day}")
        return rows.filter(F.col("part").isin(*parts)).drop("part")

    def merged(self, strict: bool = True) -> DataFrame:
        """What the window's logs merge to."""
        days = [d for d, kind in self.days() if kind == "rows"]
        if not days:
            return self.spark.createDataFrame([], self.schema)
        rows = self.read(days[0], "lists", "documents", "repeats", "frozen")
        for day in days[1:]:
            rows = rows.unionByName(self.read(day, "lists", "documents"))
        return merge_changes(rows, strict, F.lit(datetime.date.fromisoformat(days[0])), F.lit(len(days)))
