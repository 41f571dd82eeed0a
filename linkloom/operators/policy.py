"""Crawl policy: which URLs may be fetched, and what a fetch came to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BODY = 5 * 1024 * 1024
MAX_DOMAIN_CHARS = 255


@dataclass(frozen=True)
class CrawlPolicy:
    """max_depth 0: seeds only. max_pages 0: no limit. same_domain: only the seeds' domains."""

    max_depth: int = 1
    max_pages: int = 0
    same_domain: bool = False
    links_per_page: int | None = 256
    resolve_links: bool = False


def url_key(url: Column) -> Column:
    """URLs are the same if they are but for letter case."""
    return F.lower(url)


def domain(url: Column) -> Column:
    """What stands between :// (or the start) and the next slash, port and user included."""
    return F.substring(F.regexp_extract(url, r"^(?:.*?://)?([^/]*)", 1), 1, MAX_DOMAIN_CHARS)


def on_seed_domains(urls: DataFrame, seeds: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL lies on a domain of the seeds."""
    domains = seeds.select(F.lower(domain(F.col("url"))).alias("_domain")).distinct()
    return urls.withColumn("_domain", F.lower(domain(F.col(url)))).join(domains, "_domain", "left_semi").drop("_domain")


@dataclass
class Budget:
    """How many pages a crawl has fetched, and whether it was told to stop."""

    fetched: int = 0
    stopped: bool = False

    def record(self, pages: int = 1) -> None:
        self.fetched += pages

    def may_continue(self, policy: CrawlPolicy) -> bool:
        return can_continue(self.fetched, policy, self.stopped)

    def reset(self) -> None:
        self.fetched, self.stopped = 0, False


def can_continue(fetched: int, policy: CrawlPolicy, stopped: bool = False) -> bool:
    return not stopped and (policy.max_pages == 0 or fetched < policy.max_pages)


def is_html(content_type: Column) -> Column:
    return F.coalesce(content_type.contains("text/html") | content_type.contains("application/xhtml"), F.lit(False))


def header_content_type(headers: Column) -> Column:
    return F.regexp_extract(headers, r"(?im)^content-type:\s*([^\r\n]*)", 1)


def capped_body(body: Column, limit: int = MAX_BODY) -> Column:
    """The first bytes of a body, so many at most; what is left of a cut character becomes a replacement character."""
    cut = F.make_valid_utf8(F.substring(body.cast("binary"), 1, limit).cast("string"))
    return F.when(F.octet_length(body) > limit, cut).otherwise(body)


def outcome_of_status(code: Column) -> Column:
    return (
        F.when(code == 200, "OK")
        .when(code.isin(301, 302, 303, 307, 308), "REDIRECT")
        .when(code == 403, "FORBIDDEN")
        .when(code == 404, "NOT_FOUND")
        .when(code == 410, "GONE")
        .when((code == 429) | (code >= 500), "SERVER_ERROR")
        .when(code == 0, "TIMEOUT")
        .otherwise("ERROR")
    )


def outcome(code: Column, content_type: Column, error: Column | None = None) -> Column:
    """Outcome of a fetch; a page that is no HTML is skipped.

    error, if any, goes before the status: "timeout" and "connect" are a TIMEOUT, "truncated" (the body was cut at its
    limit) is no error, and anything else is an ERROR.
    """
    status = outcome_of_status(code)
    by_status = F.when((status == "OK") & ~is_html(content_type), "CONTENT_SKIP").otherwise(status)
    if error is None:
        return by_status
    return F.when(error.isin("timeout", "connect"), "TIMEOUT").when(error.isNotNull() & (error != "truncated"), "ERROR").otherwise(by_status)


def state_after(outcome_: Column) -> Column:
    return F.when(outcome_.isin("OK", "REDIRECT"), "DONE").otherwise("FAILED")
