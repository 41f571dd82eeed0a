"""A graph that grows in phases: rank what there is, crawl on, join both, rank again where something changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.lineage import cut, with_index
from linkloom.operators.crawl import Crawl, crawl
from linkloom.operators.graph import adjacency, edges_of, node_ids, offset_ids
from linkloom.operators.incremental import compare_full_and_incremental
from linkloom.operators.pagerank import pagerank
from linkloom.operators.policy import CrawlPolicy, url_key
from linkloom.sources import readers, writers


@dataclass
class Graph:
    """nodes (node_id, url) and distinct edges (src, dst)."""

    nodes: DataFrame
    edges: DataFrame


def graph_of(links: DataFrame) -> Graph:
    """The graph of links (seq, src_url, dst_url)."""
    nodes = cut(node_ids(links))
    return Graph(nodes.select("node_id", "url"), edges_of(links, nodes))


def offset_nodes(nodes: DataFrame, offset: int) -> DataFrame:
    """A URL map whose ids begin at an offset."""
    return nodes.select((F.col("node_id") + offset).alias("node_id"), "url")


def join_by_offset(first: Graph, second: Graph, offset: int | None = None) -> Graph:
    """Both graphs side by side: the second one's ids follow the first one's, even where URLs are the same."""
    offset = first.nodes.count() if offset is None else offset
    nodes = first.nodes.select("node_id", "url").unionByName(offset_nodes(second.nodes, offset))
    return Graph(nodes, first.edges.select("src", "dst").unionAll(offset_ids(second.edges, offset).select("src", "dst")))


def join_by_url(first: Graph, second: Graph) -> Graph:
    """One graph of both: known URLs keep their ids, new ones get the next in the order of the second graph's ids."""
    known = first.nodes.select(url_key(F.col("url")).alias("key"), F.col("node_id").alias("old"))
    keyed = second.nodes.select("node_id", "url", url_key(F.col("url")).alias("key")).join(known, "key", "left")
    start = first.nodes.agg(F.coalesce(F.max("node_id") + 1, F.lit(0))).first()[0]
    fresh = with_index(keyed.filter(F.col("old").isNull()).select("node_id", "url"), ["node_id"], "place").withColumn("new", F.col("place") + start)
    ids = cut(keyed.filter(F.col("old").isNotNull()).select("node_id", F.col("old").alias("new")).unionByName(fresh.select("node_id", "new")))
    src, dst = (ids.select(F.col("node_id").alias(c), F.col("new").alias(f"new_{c}")) for c in ("src", "dst"))
    moved = second.edges.join(src, "src").join(dst, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))
    nodes = first.nodes.select("node_id", "url").unionByName(fresh.select(F.col("new").alias("node_id"), "url"))
    return Graph(nodes, first.edges.select("src", "dst").unionByName(moved).distinct())


@dataclass
class Growth:
    """Ranks of the first phase, the joined graph, the crawl between, and the counts of both phases."""

    ranks: DataFrame
    graph: Graph
    crawl: Crawl
    metadata: dict[str, int]


def grow(first: Graph, seeds: DataFrame, fetches, policy: CrawlPolicy = CrawlPolicy(), *, by: str = "offset", earlier: Crawl | None = None, **ranking) -> Growth:
    """Rank the first graph, crawl new seeds (not what an earlier crawl has seen) and join what was found by "offset" or by "url".

    fetches is a table, or a function that fetches a frontier; ranking holds options of pagerank.
    """
    if by not in ("offset", "url"):
        raise ValueError(f"unknown way to join graphs: {by}")
    ranks = pagerank(first.edges, nodes=first.nodes.select("node_id"), **ranking).ranks
    found = crawl(seeds, fetches, policy, seen=None if earlier is None else earlier.states)
    graph = (join_by_offset if by == "offset" else join_by_url)(first, graph_of(found.links))
    counts = {"phase1_node_count": first.nodes, "phase1_edge_count": first.edges, "phase2_total_nodes": graph.nodes, "phase2_total_edges": graph.edges}
    return Growth(ranks, graph, found, {k: v.count() for k, v in counts.items()})


def save_growth(growth: Growth, first: Graph, folder: str) -> None:
    """Both phases as text: adjacency lists, edges, URL map, the first phase's ranks and the counts."""
    for name, graph in (("phase1", first), ("phase2", growth.graph)):
        writers.save_graph(adjacency(graph.nodes, graph.edges), f"{folder}/{name}_graph.adj", "adjacency")
        writers.save_graph(graph.edges, f"{folder}/{name}_graph.edge", "edgelist")
        writers.save_lines(writers.url_map_lines(graph.nodes), f"{folder}/{name}_url_map")
    writers.save_lines(writers.rank_lines(growth.ranks), f"{folder}/phase1_ranks")
    writers.save_key_values(growth.ranks.sparkSession, f"{folder}/phase2_metadata", growth.metadata)


def compare_files(spark: SparkSession, old: str, new: str, **options) -> DataFrame:
    """compare_full_and_incremental of two graphs in adjacency files; options as there (dangling, tol, max_iter, hops)."""
    lists = [cut(readers.read_adjacency(spark, path)) for path in (old, new)]
    edges = [readers.adjacency_edges(x) for x in lists]
    dangling, tol = options.get("dangling", "redistribute"), options.get("tol", 1e-10)
    ranks = pagerank(edges[0], nodes=lists[0].select("node_id"), dangling=dangling, tol=tol, max_iter=options.get("max_iter", 100)).ranks
    got = compare_full_and_incremental(lists[0], lists[1], edges[1], ranks, **options)
    known = lists[0].select("node_id")
    fresh = lists[1].join(known, "node_id", "left_anti").count()
    return got.withColumn("nodes", F.lit(lists[1].count())).withColumn("new_nodes", F.lit(fresh))


def evaluation_report(result: DataFrame) -> DataFrame:
    """One row of compare_files as lines of text; only what was measured."""
    share = 100 * F.col("affected") / F.col("nodes")
    faster = F.when(F.col("speedup") > 1, F.format_string("incremental is %.2f times as fast", "speedup")).otherwise(F.lit("full recomputation is faster here"))
    lines = [
        F.format_string("full: %.2f ms, %d iterations", "full_ms", "full_iterations"),
        F.format_string("incremental: %.2f ms, %d iterations", "incremental_ms", "incremental_iterations"),
        F.format_string("affected: %d nodes (%.1f%%), active: %d, new: %d", "affected", share, "active", "new_nodes"),
        F.format_string("rank difference: avg %.6e, max %.6e", "avg_diff", "max_diff"),
        faster,
    ]
    return result.select(F.explode(F.array(*lines)).alias("value"))
