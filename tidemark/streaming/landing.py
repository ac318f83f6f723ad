"""Extensions beyond batch parity: snapshots and feed items that land as files, read with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.expr import hits
from tidemark.operators.diff import Transition, keyed_diff


def landed(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def diff_stream(stream: DataFrame, state_path: str, out_path: str, by: str, transitions: Sequence[Transition], checkpoint: str) -> StreamingQuery:
    """Each batch is a snapshot: diff it against the one before, append the changes, and keep it as the next one's base.

    State is written by batch number and changes by batch, so a batch that is run again overwrites what it wrote.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        before = spark.read.schema(batch.schema).parquet(f"{state_path}/batch={number - 1}") if number else spark.createDataFrame([], batch.schema)
        found = keyed_diff(before, batch, by, transitions).select("entity_key", "kind", "old_value", "new_value")
        found.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        batch.write.mode("overwrite").parquet(f"{state_path}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_items(stream: DataFrame, time: str, keys: Sequence[str] = ("feed_name", "id"), late: str = "2 days") -> DataFrame:
    """Feed items not seen before; what is forgotten is older than the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def daily_counts(stream: DataFrame, time: str, group: str, late: str = "1 day") -> DataFrame:
    """Items a day and group, in tumbling windows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), group).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("run_date"), group, "n")


def keyword_alerts(stream: DataFrame, text: str, words: list[str], send: Callable[[list], None], checkpoint: str, out: str | None = None, most: int = 100) -> StreamingQuery:
    """Rows whose text has watched words: all are written by the tasks, a folder a batch, under ``out`` (by default beside the
    checkpoint); the first ``most`` of a batch are handed to ``send``."""
    found = stream.withColumn("matched_keywords", hits(text, words)).filter(F.size("matched_keywords") > 0)

    def step(batch: DataFrame, number: int) -> None:
        folder = f"{out or f'{checkpoint}-found'}/batch={number}"
        batch.write.mode("overwrite").parquet(folder)
        send(batch.sparkSession.read.schema(batch.schema).parquet(folder).limit(most).collect())

    return found.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
