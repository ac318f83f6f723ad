"""Landed files and live endpoints: JSON envelopes, feeds, snapshots, headers, catalog."""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.expr import default, fingerprint
from tidemark.functions.vocab import ATTEMPTS, BACKOFF, SOURCES

FEED = "title string, link string, summary string, published string, id string"


def with_retry(call: Callable[[], object], attempts: int = ATTEMPTS, backoff: int = BACKOFF, sleep: Callable[[float], None] = time.sleep):
    """What the call returns, or None after that many failures; waits 1, 2, 4, 8 seconds, also after the last."""
    for i in range(attempts):
        try:
            return call()
        except Exception:
            sleep(backoff**i)
    return None


def settings(environment=os.environ) -> dict:
    """Settings from the environment; lists are comma-separated, trimmed, without empty parts."""
    listed = lambda name: [x.strip() for x in environment.get(name, "").split(",") if x.strip()]
    return {
        "log_level": environment.get("TIDEMARK_LOG_LEVEL", "INFO"), "smtp_host": environment.get("TIDEMARK_SMTP_HOST", "localhost"), "smtp_port": int(environment.get("TIDEMARK_SMTP_PORT", "587")),
        "username": environment.get("TIDEMARK_EMAIL_USERNAME", ""), "password": environment.get("TIDEMARK_EMAIL_PASSWORD", ""), "sender": environment.get("TIDEMARK_EMAIL_FROM", ""),
        "recipients": listed("TIDEMARK_EMAIL_RECIPIENTS"), "chat_token": environment.get("TIDEMARK_CHAT_TOKEN", ""), "chat_room": environment.get("TIDEMARK_CHAT_ROOM", ""),
    }


def catalog(spark: SparkSession, sources=SOURCES) -> DataFrame:
    """One row a source; ``mode`` says how it is read."""
    return spark.createDataFrame([tuple(s) for s in sources], "domain string, kind string, name string, url string, mode string")


class _Part(InputPartition):
    def __init__(self, row):
        self.row = row


class _HttpReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.method, self.most, self.timeout = options.get("method", "GET"), int(options.get("most", 0)), float(options.get("timeout", 30))
        self.attempts, self.wait = int(options.get("attempts", ATTEMPTS)), float(options.get("wait", 1))

    def partitions(self):
        return [_Part(u) for u in self.urls]

    def answer(self, request):
        """The response; to a HEAD, that of an error page too, whose status and headers count."""
        try:
            return urllib.request.urlopen(request, timeout=self.timeout)
        except urllib.error.HTTPError as e:
            if self.method != "HEAD":
                raise
            return e

    def read(self, partition):
        if partition is None:  # no URLs at all
            return

        def fetch():
            request = urllib.request.Request(partition.row, method=self.method)
            if self.most:
                request.add_header("Range", f"bytes=0-{self.most - 1}")
            with self.answer(request) as r:
                h = r.headers
                return (partition.row, getattr(r, "status", None) or 200, h.get("Last-Modified", ""), h.get("ETag", ""), h.get("Content-Length", ""), r.read(self.most or -1) if self.method == "GET" else b"")

        # A HEAD is tried once.
        found = with_retry(fetch, 1 if self.method == "HEAD" else self.attempts, sleep=lambda s: time.sleep(s * self.wait))
        yield found or (partition.row, None, "", "", "", None)


class HttpSource(DataSource):
    """``spark.read.format("tidemark_http").option("urls", "one a line")``; each URL is a partition.

    method GET or HEAD, ``most`` bytes of the body, ``attempts``.  A URL that fails for good gives a row without a status.
    """

    @classmethod
    def name(cls):
        return "tidemark_http"

    def schema(self):
        return "url string, status_code int, last_modified string, etag string, content_length string, body binary"

    def reader(self, schema):
        return _HttpReader(self.options)


def fetch(spark: SparkSession, urls: list[str], **options) -> DataFrame:
    spark.dataSource.register(HttpSource)
    return spark.read.format("tidemark_http").options(urls="\n".join(urls), **{k: str(v) for k, v in options.items()}).load()


def doc_headers(heads: DataFrame, bodies: DataFrame, key: str = "url") -> DataFrame:
    """Header rows (url, ...) with ``partial_hash``: only where the HEAD failed or gave no header at all, of a 200 or 206 body.

    ``key`` tells one request from another in both; where several ask for the same URL, it must be another column than that.
    """
    blank = (default("last_modified") == "") & (default("etag") == "") & (default("content_length") == "")
    wanted = F.col("status_code").isNull() | blank
    body = bodies.filter(F.col("status_code").isin(200, 206)).select(key, F.lit(True).alias("fetched"), fingerprint("body").alias("hash"))
    return heads.join(body, key, "left").withColumn("partial_hash", F.when(wanted & F.col("fetched"), F.col("hash")).otherwise("")).select("url", "status_code", "last_modified", "etag", "content_length", "partial_hash")


def envelope(df: DataFrame, json: str, path: str, element: str) -> DataFrame:
    """The records of ``path`` (dots go down; empty for a top-level list) in a column of JSON text; none if it is missing."""
    inner, schema = f"array<struct<{element}>>", f"array<struct<{element}>>"
    for part in reversed(path.split(".") if path else []):
        schema = f"struct<{part}: {schema}>"
    parsed = F.from_json(F.col(json), schema)
    for part in path.split(".") if path else []:
        parsed = parsed[part]
    return df.select(F.posexplode(F.coalesce(parsed, F.array().cast(inner))).alias("pos", "r")).select("pos", "r.*")


def union_events(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Both lists, duplicates too."""
    return current.unionByName(previous)


def rss(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """S3: the items of a landed feed (``entry`` for Atom); the id falls back to the link."""
    schema = "title string, link string, description string, summary string, pubDate string, published string, updated string, guid struct<_VALUE: string>, id string"
    raw = spark.read.schema(schema).option("rowTag", tag).option("mode", "PERMISSIVE").xml(path)
    return raw.select(
        default("title").alias("title"), default("link").alias("link"), F.coalesce("summary", "description", F.lit("")).alias("summary"),
        F.coalesce("published", "pubDate", "updated", F.lit("")).alias("published"), F.coalesce("id", "guid._VALUE", "link", F.lit("")).alias("id"),
    )


def snapshots(spark: SparkSession, glob: str) -> DataFrame:
    """(v variant, file) of whole JSON files; unreadable files are left out."""
    raw = spark.read.text(glob, wholetext=True).select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_name").alias("file"))
    return raw.filter("v IS NOT NULL")
