import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidemark.streaming.headers import HeaderReader, header_stream


@pytest.fixture
def server():
    tags = {"/a": "a1", "/b": "b1"}

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            if self.path not in tags:
                return self.send_error(404)
            self.send_response(200)
            self.send_header("ETag", tags[self.path])
            self.end_headers()

        def log_message(self, *a):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", tags
    http.shutdown()


def test_changes_only_and_a_restart_repeats_none(spark, server, tmp_path):
    url, tags = server
    urls = [f"{url}/{p}" for p in ("a", "b", "gone")] + ["http://127.0.0.1:1/no-answer"]

    def start():
        return header_stream(spark, urls, timeout=5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()

    def rows():
        return sorted((r.url.rsplit("/", 1)[1], r.status_code, r.old_etag, r.new_etag) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    query = start()
    query.processAllAvailable()
    first = [("a", 200, "", "a1"), ("b", 200, "", "b1"), ("gone", 404, "", "")]
    assert rows() == first
    query.processAllAvailable()
    assert rows() == first  # nothing has changed
    tags["/a"] = "a2"
    query.processAllAvailable()
    second = sorted([*first, ("a", 200, "a1", "a2")])
    assert rows() == second
    query.stop()
    tags["/b"] = "b2"
    query = start()
    query.processAllAvailable()
    query.stop()
    assert rows() == sorted([*second, ("b", 200, "b1", "b2")])


def test_a_url_without_an_answer_keeps_its_headers(monkeypatch):
    reader = HeaderReader({"urls": "u\nv"})
    answers = {"u": [200, "", "1", ""], "v": [200, "", "1", ""]}
    monkeypatch.setattr(reader, "head", answers.get)
    one = reader.latestOffset()
    answers["u"] = None
    assert reader.latestOffset() == one and reader.partitions(one, one) == []
    after = HeaderReader({"urls": "u\nv"})  # a restart while u gives no answer
    monkeypatch.setattr(after, "head", answers.get)
    after.partitions(one, one)
    assert after.latestOffset() == one
