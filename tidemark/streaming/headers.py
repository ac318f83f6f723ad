"""Document headers as a stream (S4): a Python streaming source whose offsets are the last headers seen.

An offset is a map of URL to headers.  Each trigger polls the URLs with HEAD requests side by side; those whose headers differ from the offset's are the rows of the
batch, one partition each, so a trigger without a change has no batch at all, and a restart goes on from the offsets in the checkpoint and repeats none.
A URL that can't be polled keeps the headers it had.  The map has a row for each URL of the source catalog and is all the state there is.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FIELDS = ("last_modified", "etag", "content_length")
SCHEMA = "url string, status_code int, " + ", ".join(f"{side}_{f} string" for side in ("old", "new") for f in FIELDS)


class _Changed(InputPartition):
    def __init__(self, url: str, old: list | None, new: list):
        self.url, self.old, self.new = url, old, new


class HeaderReader(DataSourceStreamReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.timeout, self.threads = float(options.get("timeout", 20)), int(options.get("threads", 8))
        self.known: dict[str, list] = {}

    def head(self, url: str) -> list | None:
        """[status, last_modified, etag, content_length], of an error page too; null if there is no answer."""
        import urllib.error
        import urllib.request

        try:
            try:
                answer = urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=self.timeout)
            except urllib.error.HTTPError as e:
                answer = e
            with answer as r:
                return [getattr(r, "status", None) or 200, *(r.headers.get(h, "") for h in ("Last-Modified", "ETag", "Content-Length"))]
        except OSError:
            return None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        with ThreadPoolExecutor(self.threads) as pool:
            found = dict(zip(self.urls, pool.map(self.head, self.urls)))
        self.known |= {u: h for u, h in found.items() if h is not None}
        # An offset's text must be the same for the same headers.
        return {u: self.known[u] for u in sorted(self.known)}

    def partitions(self, start: dict, end: dict):
        self.known = {**start, **end, **self.known}  # after a restart: what the checkpoint knows
        return [_Changed(u, start.get(u), h) for u, h in end.items() if start.get(u) != h]

    def read(self, partition):
        old = partition.old or [None, "", "", ""]
        yield (partition.url, partition.new[0], *old[1:], *partition.new[1:])


class HeaderSource(DataSource):
    """``spark.readStream.format("tidemark_headers").option("urls", "one a line")``"""

    @classmethod
    def name(cls):
        return "tidemark_headers"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return HeaderReader(self.options)


def header_stream(spark: SparkSession, urls: list[str], **options) -> DataFrame:
    """(url, status_code, old and new headers) of each change."""
    spark.dataSource.register(HeaderSource)
    return spark.readStream.format("tidemark_headers").options(urls="\n".join(urls), **{k: str(v) for k, v in options.items()}).load()

