"""A crawl as a dataflow: one level of the frontier at a time, in a total order.

A level is one plan: drop URLs seen before, apply depth and budget, join the fetch table, extract
links. The order of the frontier is (depth, place of the parent, place of the link), so the budget
cuts exactly and a crawl is the same however many tasks run it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.lineage import cut, with_index
from linkloom.operators.links import crawlable_links, resolve
from linkloom.operators.policy import Budget, CrawlPolicy, capped_body, on_seed_domains, outcome, state_after, url_key

LINKS = 1 << 20  # more links than a body of MAX_BODY bytes can hold: places of one page's links stay together
Fetches = DataFrame | Callable[[DataFrame], DataFrame]


@dataclass
class Crawl:
    """states (url, url_key, depth, seq, state, outcome), links (seq, src_url, dst_url), and counters."""

    states: DataFrame
    links: DataFrame
    levels: int
    discovered: int
    fetched: int


def push(candidates: DataFrame, seen: DataFrame, policy: CrawlPolicy, discovered: int) -> DataFrame:
    """The candidates (url, depth, place) that enter the frontier, as url, url_key, depth, seq.

    Of one URL the first place counts; depth and what is left of the page budget are kept exactly.
    """
    fresh = candidates.filter((F.length("url") > 0) & (F.col("depth") <= policy.max_depth)).withColumn("url_key", url_key(F.col("url")))
    first = fresh.groupBy("url_key").agg(F.min(F.struct("place", "url", "depth")).alias("f")).join(seen, "url_key", "left_anti")
    numbered = with_index(cut(first.select("url_key", "f.place", "f.url", "f.depth")), ["place", "url_key"], "seq")
    if policy.max_pages:
        numbered = numbered.filter(F.col("seq") < max(0, policy.max_pages - discovered))
    return numbered.select("url", "url_key", "depth", (F.col("seq") + discovered).alias("seq"))


def fetch_from(frontier: DataFrame, fetches: DataFrame) -> DataFrame:
    """The frontier with html, outcome and state; a URL without a row in the fetch table is not found.

    A fetch table has url and html, and optionally http_code, content_type, location, error, or the outcome itself.
    """
    columns = fetches.columns
    error = F.col("error") if "error" in columns else None
    code = F.col("http_code") if "http_code" in columns else F.lit(200)
    kind = F.col("content_type") if "content_type" in columns else F.lit("text/html")
    location = F.col("location") if "location" in columns else F.lit(None).cast("string")
    known = fetches.select(url_key(F.col("url")).alias("url_key"), capped_body(F.col("html")).alias("html"), (F.col("outcome") if "outcome" in columns else outcome(code, kind, error)).alias("outcome"), location.alias("location")).dropDuplicates(["url_key"])
    got = frontier.join(known, "url_key", "left").withColumn("outcome", F.coalesce("outcome", F.lit("NOT_FOUND")))
    return got.withColumn("state", state_after(F.col("outcome")))


def crawl(seeds: DataFrame, fetches: Fetches, policy: CrawlPolicy = CrawlPolicy(), seen: DataFrame | None = None, budget: Budget | None = None) -> Crawl:
    """Crawl from seeds (url) over a table of fetches (see fetch_from), or with a function that fetches the URLs of a table.

    seen (url_key), what earlier crawls have met, is not met again. budget records the fetches; a level begins only while it
    may continue. Without one counts begin anew.
    """
    budget = budget or Budget()
    spark = seeds.sparkSession
    before = None if seen is None else cut(seen.select("url_key").distinct())
    candidates = with_index(seeds.select("url").distinct() if "seq" not in seeds.columns else seeds, ["seq"] if "seq" in seeds.columns else ["url"], "place").select(
        "url", F.lit(0).alias("depth"), "place"
    )
    states = spark.createDataFrame([], "url string, url_key string, depth int, seq long, outcome string, state string")
    links = spark.createDataFrame([], "seq long, pos int, src_url string, dst_url string")
    levels = discovered = 0
    before_crawl = budget.fetched
    while True:
        if policy.same_domain and levels:
            candidates = on_seed_domains(candidates, seeds)
        known = states.select("url_key") if before is None else states.select("url_key").unionByName(before)
        level = cut(push(candidates, known, policy, discovered))
        size = level.count()
        if not size or not budget.may_continue(policy):
            break
        got = cut(fetch_from(level, fetches(level.select("url")) if callable(fetches) else fetches))
        levels, discovered = levels + 1, discovered + size
        budget.record(size)
        states = states.unionByName(got.select("url", "url_key", "depth", "seq", "outcome", "state"))
        page = got.filter(F.col("outcome") == "OK").select("seq", "url", "depth", F.posexplode(crawlable_links(F.coalesce("html", F.lit("")), policy.links_per_page)).alias("pos", "link"))
        if policy.resolve_links:
            page = page.withColumn("link", resolve(F.col("url"), F.col("link")))
        found = cut(page)
        links = links.unionByName(found.select("seq", "pos", F.col("url").alias("src_url"), F.col("link").alias("dst_url")))
        again = got.filter((F.col("outcome") == "REDIRECT") & F.col("location").isNotNull()).select(F.col("location").alias("url"), "depth", (F.col("seq") * LINKS).alias("place"))
        candidates = found.select(F.col("link").alias("url"), (F.col("depth") + 1).alias("depth"), (F.col("seq") * LINKS + F.col("pos") + 1).alias("place")).unionByName(again)
    numbered = with_index(links, ["seq", "pos"], "n").select(F.col("n").alias("seq"), "src_url", "dst_url")
    return Crawl(states, numbered, levels, discovered, budget.fetched - before_crawl)


def push_links(urls: DataFrame, seen: DataFrame, policy: CrawlPolicy = CrawlPolicy(), discovered: int = 0) -> tuple[DataFrame, int]:
    """What candidates (url, depth, place) put on the frontier beside what was seen (url_key), and how many were accepted."""
    accepted = cut(push(urls, seen, policy, discovered))
    return accepted, accepted.count()


def queue_urls(candidates: DataFrame, policy: CrawlPolicy = CrawlPolicy()) -> DataFrame:
    """What a first batch of candidates (url, depth, place) puts on an empty frontier."""
    empty = candidates.sparkSession.createDataFrame([], "url_key string")
    return push(candidates, empty, policy, 0)
