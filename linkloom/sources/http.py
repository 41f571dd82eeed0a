"""Fetching live pages, distributed over the rows of a URL table."""

from __future__ import annotations

import http.client
import socket
import ssl
import time
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from linkloom.schema import FETCHES

CONNECT_S, TOTAL_S, MAX_BYTES = 5.0, 15.0, 5 * 1024 * 1024
REDIRECTS = (301, 302, 303, 307, 308)


def outcome_of(code: int, content_type: str) -> str:
    if code == 200:
        return "OK" if "text/html" in content_type or "application/xhtml" in content_type else "CONTENT_SKIP"
    if code in REDIRECTS:
        return "REDIRECT"
    if code == 429 or code >= 500:
        return "SERVER_ERROR"
    return {403: "FORBIDDEN", 404: "NOT_FOUND", 410: "GONE", 0: "TIMEOUT"}.get(code, "ERROR")


def fetch(url: str, user_agent: str, max_bytes: int = MAX_BYTES) -> dict:
    """One GET: no redirects followed, verified TLS, gzip and deflate undone, the body cut at a size."""
    out = {"url": url, "html": None, "http_code": 0, "content_type": None, "outcome": "ERROR", "location": None}
    parts, deadline = urlsplit(url), time.monotonic() + TOTAL_S
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return out
    if parts.scheme == "https":
        connection = http.client.HTTPSConnection(parts.hostname, parts.port, timeout=CONNECT_S, context=ssl.create_default_context())
    else:
        connection = http.client.HTTPConnection(parts.hostname, parts.port, timeout=CONNECT_S)
    try:
        connection.connect()
        connection.sock.settimeout(max(0.1, deadline - time.monotonic()))
        target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        connection.request("GET", target, headers={"User-Agent": user_agent, "Accept-Encoding": "gzip, deflate"})
        answer = connection.getresponse()
        out["http_code"], out["content_type"], out["location"] = answer.status, answer.headers.get("Content-Type", ""), answer.headers.get("Location")
        squeezed = answer.headers.get("Content-Encoding", "") in ("gzip", "deflate")
        inflate = zlib.decompressobj(47) if squeezed else None
        body = bytearray()
        while len(body) < max_bytes and (chunk := answer.read(65536)):
            if time.monotonic() > deadline:
                raise TimeoutError
            body += inflate.decompress(chunk, max_bytes - len(body)) if inflate else chunk
        out["outcome"] = outcome_of(answer.status, out["content_type"])
        if out["outcome"] == "OK":
            out["html"] = bytes(body[:max_bytes]).decode("utf-8", "replace")
    except (TimeoutError, socket.timeout, ConnectionRefusedError):  # no connection counts as a timeout
        out["outcome"] = "TIMEOUT"
    except ssl.SSLError:
        out["outcome"] = "SSL_ERROR"
    except (OSError, http.client.HTTPException, zlib.error):
        out["outcome"] = "ERROR"
    finally:
        connection.close()
    return out


def fetch_urls(urls: DataFrame, user_agent: str = "linkloom/1.0", parallelism: int | None = None) -> DataFrame:
    """Fetch every URL of a table (url); parallelism is the number of tasks that fetch at the same time."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for url in pdf["url"]:
                yield pd.DataFrame([fetch(url, user_agent)]).astype({"http_code": "int32"})

    spread = urls.select("url").repartition(parallelism) if parallelism else urls.select("url")
    return spread.mapInPandas(run, FETCHES)
