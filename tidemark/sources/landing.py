"""What a run has fetched, written before anything is parsed.

Bodies are stored once by the SHA-256 of their content (``blobs``), whatever the run or the URL; a run's answers (``runs/run=.../<name>``) are rows of URL, status, headers
and digest.  Every parser reads these files, so a lost executor costs no second request and no two tables of a snapshot see different
versions of a page.  A name of a run that was written whole is never fetched again: a run that is done again after a crash goes on from what it has.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADERS = "url string, status_code int, last_modified string, etag string, content_length string"
BLOBS = "sha256 string, body binary"


def shared_root(spark: SparkSession) -> str:
    """A folder that all executors see: that of checkpoints, else the warehouse."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")


class RawStore:
    """The answers of one run, under ``root``."""

    def __init__(self, spark: SparkSession, root: str, run: str | None = None):
        self.spark, self.root, self.run = spark, root.rstrip("/"), run or uuid.uuid4().hex

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _drop(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def blobs(self) -> DataFrame:
        if not self._exists(f"{self.root}/blobs/_SUCCESS"):
            return self.spark.createDataFrame([], BLOBS)
        return self.spark.read.schema(BLOBS).parquet(f"{self.root}/blobs")

    def keep(self, name: str, fetch: Callable[[], DataFrame]) -> DataFrame:
        """(url, status_code, headers, body) of ``fetch()``, which is asked once in a run; what it gave is read from files."""
        place = f"{self.root}/runs/run={self.run}/{name}"
        if not self._exists(f"{place}/_SUCCESS"):
            staged = f"{self.root}/staged/{uuid.uuid4().hex}"
            found = fetch()
            body = F.col("body") if "body" in found.columns else F.lit(None).cast("binary")
            found.select(*(f.split()[0] for f in HEADERS.split(", ")), body.alias("body"), F.sha2(body, 256).alias("sha256")).write.parquet(staged)
            rows = self.spark.read.schema(f"{HEADERS}, body binary, sha256 string").parquet(staged)
            # Bodies first: an answer never names one that isn't there.
            fresh = rows.filter("sha256 IS NOT NULL").select("sha256", "body").dropDuplicates(["sha256"]).join(self.blobs().select("sha256"), "sha256", "left_anti")
            fresh.write.mode("append").parquet(f"{self.root}/blobs")
            rows.drop("body").write.mode("overwrite").parquet(place)
            self._drop(staged)
        answers = self.spark.read.schema(f"{HEADERS}, sha256 string").parquet(place)
        # A blob may have been written by two runs at once; one is as good as the other.
        bodies = self.blobs().join(answers.select("sha256").distinct(), "sha256", "left_semi").dropDuplicates(["sha256"])
        return answers.join(bodies, "sha256", "left").drop("sha256")
