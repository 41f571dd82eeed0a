import gzip
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from linkloom.functions.hashing import list_hash, ordered_hash, string_hash
from linkloom.operators.crawl import crawl, queue_urls
from linkloom.operators.policy import CrawlPolicy
from linkloom.sources import http as live
from linkloom.sources.seeds import PROFILES, seeds
from linkloom.streaming import frontier

PAGES = [
    ("http://s/a", '<a href="http://s/b"><a href="HTTP://S/C"><a href="http://t/x">', 200, "text/html", None),
    ("http://s/b", '<a href="http://s/a"><a href="http://s/d">', 200, "text/html", None),
    ("http://s/c", None, 301, "text/html", "http://s/e"),
    ("http://s/d", "<a href=http://s/f>", 200, "image/png", None),
    ("http://s/e", "<a href=http://s/g>", 200, "application/xhtml+xml", None),
]


def tables(spark):
    return spark.createDataFrame([("http://s/a",)], "url string"), spark.createDataFrame(PAGES, "url string, html string, http_code int, content_type string, location string")


def states(result):
    return {r["url"]: (r["depth"], r["outcome"], r["state"]) for r in result.states.collect()}


def test_crawl_levels_outcomes_and_edges(spark):
    got = crawl(*tables(spark), CrawlPolicy(max_depth=2))
    assert states(got) == {
        "http://s/a": (0, "OK", "DONE"), "http://s/b": (1, "OK", "DONE"), "HTTP://S/C": (1, "REDIRECT", "DONE"), "http://t/x": (1, "NOT_FOUND", "FAILED"),
        "http://s/e": (1, "OK", "DONE"), "http://s/d": (2, "CONTENT_SKIP", "FAILED"), "http://s/g": (2, "NOT_FOUND", "FAILED"),
    }
    assert got.discovered == got.fetched == 7 and got.links.count() == 6
    assert [r["dst_url"] for r in got.links.orderBy("seq").collect()][:3] == ["http://s/b", "HTTP://S/C", "http://t/x"]


def test_depth_budget_and_domain(spark):
    assert set(states(crawl(*tables(spark), CrawlPolicy(max_depth=0)))) == {"http://s/a"}
    assert set(states(crawl(*tables(spark), CrawlPolicy(max_depth=2, max_pages=3)))) == {"http://s/a", "http://s/b", "HTTP://S/C"}
    assert "http://t/x" not in states(crawl(*tables(spark), CrawlPolicy(max_depth=2, same_domain=True)))


def test_queue_ignores_case_and_repeats(spark):
    rows = [("http://example.com", 0, 0), ("http://example.com/page", 0, 1), ("HTTP://EXAMPLE.COM", 0, 2), ("http://example.com/page", 0, 3)]
    got = queue_urls(spark.createDataFrame(rows, "url string, depth int, place long")).orderBy("seq").collect()
    assert [r["url"] for r in got] == ["http://example.com", "http://example.com/page"]


def test_seed_lists_have_the_known_hashes(spark):
    assert list_hash(list(PROFILES["small"])) == 11731404830899694292 and list_hash(list(PROFILES["large"])) == 418818369127468153
    assert [len(PROFILES[k]) for k in ("small", "large", "second_phase")] == [8, 105, 5]
    assert int(ordered_hash(seeds(spark, "large"), "url", "seq").first()["hash"]) == 418818369127468153
    assert string_hash("A") == string_hash("a") == 5381 * 33 + 97 and string_hash("a", 10) == (5381 * 33 + 97) % 10


def test_streams(spark, tmp_path):
    events = [("http://A", "PUSH", 0), ("http://a", "POP", 1), ("http://a", "OK", 2), ("b", "POP", 0), ("b", "PUSH", 1), ("c", "PUSH", 0), ("c", "POP", 1), ("c", "FAIL", 2), ("c", "PUSH", 3)]
    schema = "url string, event string, at long"
    spark.createDataFrame(events[:5], schema).coalesce(1).write.parquet(f"{tmp_path}/events/1")
    spark.createDataFrame(events[5:], schema).coalesce(1).write.parquet(f"{tmp_path}/events/2")
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    latest = frontier.drain(frontier.url_states(stream()), "update").groupBy("url_key").agg(F.max_by("state", F.struct("batch", "changes")).alias("s"))
    assert {r["url_key"]: r["s"] for r in latest.collect()} == {"http://a": "DONE", "b": "QUEUED", "c": "FAILED"}
    assert sorted(r["url_key"] for r in frontier.drain(frontier.unseen(stream())).collect()) == ["b", "c", "http://a"]


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        code, kind, body, extra = {
            "/ok": (200, "text/html; charset=utf-8", "é<a href=x>".encode(), {}), "/zip": (200, "text/html", gzip.compress(b"z" * 1000), {"Content-Encoding": "gzip"}),
            "/png": (200, "image/png", b"x", {}), "/move": (302, "text/html", b"", {"Location": "/ok"}), "/busy": (429, "text/html", b"", {}),
        }.get(self.path, (404, "text/html", b"", {}))
        self.send_response(code)
        for k, v in {"Content-Type": kind, "Content-Length": str(len(body)), **extra}.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_live_fetches(spark, server):
    urls = spark.createDataFrame([(server + p,) for p in ("/ok", "/zip", "/png", "/move", "/busy", "/none")] + [("http://127.0.0.1:1/",), ("nonsense",)], "url string")
    got = {r["url"].replace(server, ""): r for r in live.fetch_urls(urls, parallelism=2).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"/ok": "OK", "/zip": "OK", "/png": "CONTENT_SKIP", "/move": "REDIRECT", "/busy": "SERVER_ERROR", "/none": "NOT_FOUND", "http://127.0.0.1:1/": "TIMEOUT", "nonsense": "ERROR"}
    assert got["/ok"]["html"] == "é<a href=x>" and got["/zip"]["html"] == "z" * 1000 and got["/move"]["location"] == "/ok"
    assert len(live.fetch(server + "/zip", "x", 10)["html"]) == 10
