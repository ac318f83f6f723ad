"""Answers land once: no URL is asked twice in a run, and unchanged bodies are stored once."""

import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidemark.sources.collect import collect
from tidemark.sources.landed import fetch
from tidemark.sources.landing import RawStore

PAGE = "<main><p>paragraph {} of more than twenty characters</p></main>"


@pytest.fixture
def server():
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body):
            asked[self.command, self.path] += 1
            if self.path == "/gone":
                return self.send_error(404)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            # Another version each time it is asked: two requests would show.
            self.answer(PAGE.format(asked["GET", self.path] if self.path == "/moving" else self.path).encode())

        def do_HEAD(self):
            self.answer(b"")

        def log_message(self, *a):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", asked
    http.shutdown()


def test_a_run_asks_once(spark, server, tmp_path):
    url, asked = server
    sources = [("nist", "page", "a", f"{url}/moving", "html"), ("nist", "page", "b", f"{url}/b", "html"), ("csfc", "page", "c", f"{url}/moving", "html"), ("nist", "page", "d", f"{url}/gone", "html"), ("nist", "document", "D", f"{url}/doc", "head")]
    first = collect(spark, sources, landing=str(tmp_path), run="one", attempts=1, wait=0)
    rows = lambda got: sorted(map(str, (tuple(r) for n in ("page_items", "doc_headers") for r in got[n].collect())))
    seen = rows(first)
    spark.catalog.clearCache()  # what an executor held is gone
    assert rows(first) == seen and "paragraph 0 of" in str(seen)
    assert rows(collect(spark, sources, landing=str(tmp_path), run="one", attempts=1, wait=0)) == seen  # done again after a crash
    assert asked == {("GET", "/moving"): 1, ("GET", "/b"): 1, ("GET", "/gone"): 1, ("HEAD", "/doc"): 1, ("GET", "/doc"): 1}
    assert rows(collect(spark, sources, landing=str(tmp_path), run="two", attempts=1, wait=0)) != seen and asked["GET", "/moving"] == 2


def test_bodies_are_stored_once(spark, server, tmp_path):
    url, _ = server
    urls = [f"{url}/{i}" for i in (1, 2)]
    for run in ("one", "two"):
        store = RawStore(spark, str(tmp_path), run)
        got = store.keep("pages", lambda: fetch(spark, [*urls, f"{url}/gone"], attempts=1, wait=0))
        assert {r.url.rsplit("/", 1)[1]: r.body and bytes(r.body).decode() for r in got.collect()} == {"1": PAGE.format("/1"), "2": PAGE.format("/2"), "gone": None}
    assert store.blobs().count() == 2
    assert store.keep("none", lambda: fetch(spark, [], attempts=1)).count() == 0
