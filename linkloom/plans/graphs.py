"""The graphs that the standard tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.lineage import with_index
from linkloom.operators.graph import edges_of, node_ids
from linkloom.operators.links import crawlable_links

SECOND_PHASE_SHARE = 0.02  # of the pages, by page_id, that arrive in the second phase


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, pos, link of all pages."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(crawlable_links(F.coalesce("html", F.lit("")))).alias("pos", "link"))


def url_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, src_url, dst_url in the order of page and place."""
    return page_links(spark, sf_dir).select((F.col("page_id") * 256 + F.col("pos")).alias("seq"), F.col("url").alias("src_url"), F.col("link").alias("dst_url"))


def web_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and distinct edges of pages and their links."""
    links = url_links(spark, sf_dir)
    nodes = node_ids(links)
    return nodes, edges_of(links, nodes)


def first_phase_pages(pages: DataFrame) -> DataFrame:
    """pages without the last share by page_id."""
    limit = pages.agg(F.floor((F.max("page_id") + 1) * (1 - SECOND_PHASE_SHARE)).alias("_limit"))
    return pages.crossJoin(F.broadcast(limit)).filter(F.col("page_id") < F.col("_limit")).drop("_limit")


def two_phases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of all pages' graph, edges of the first phase, edges of both; ids by first appearance, so the
    first phase's nodes come first."""
    nodes, edges = web_graph(spark, sf_dir)
    early = first_phase_pages(page_links(spark, sf_dir))
    links = early.select((F.col("page_id") * 256 + F.col("pos")).alias("seq"), F.col("url").alias("src_url"), F.col("link").alias("dst_url"))
    return nodes, edges_of(links, nodes), edges


def event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges from each event's user to the next event's, no self-loops."""
    numbered = with_index(table(spark, sf_dir, "events").select("ts", "event_id", "user_id"), ["ts", "event_id"], "i")
    after = numbered.select((F.col("i") - 1).alias("i"), F.col("user_id").alias("dst"))
    return numbered.select("i", F.col("user_id").alias("src")).join(after, "i").filter("src <> dst").select("src", "dst").distinct()


def order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges from customers to the suppliers of their orders; suppliers' ids follow the customers'."""
    offset = table(spark, sf_dir, "customer").agg((F.max("c_custkey") + 1).alias("offset"))
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pairs = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("src"), "l_suppkey").distinct()
    return pairs.crossJoin(F.broadcast(offset)).select("src", (F.col("l_suppkey") + F.col("offset")).alias("dst"))
