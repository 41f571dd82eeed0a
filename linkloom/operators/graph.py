"""Building graphs out of URLs, and what there is to know of a graph without iterating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.lineage import with_index, with_prefix_sum
from linkloom.operators.policy import url_key


def node_ids(links: DataFrame) -> DataFrame:
    """links (seq, src_url, dst_url) to nodes (node_id, url, url_key): ids from 0 by first appearance, the
    source of an edge before its target; the spelling met first stays."""
    ends = links.select(F.explode(F.array(F.struct((F.col("seq") * 2).alias("at"), F.col("src_url").alias("url")), F.struct((F.col("seq") * 2 + 1).alias("at"), F.col("dst_url").alias("url")))).alias("e"))
    first = ends.groupBy(url_key(F.col("e.url")).alias("url_key")).agg(F.min("e.at").alias("first"), F.min_by("e.url", "e.at").alias("url"))
    return with_index(first, ["first", "url_key"], "node_id").select("node_id", "url", "url_key")


def edges_of(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) of links between known URLs."""
    src = nodes.select(F.col("node_id").alias("src"), F.col("url_key").alias("src_key"))
    dst = nodes.select(F.col("node_id").alias("dst"), F.col("url_key").alias("dst_key"))
    keyed = links.select(url_key(F.col("src_url")).alias("src_key"), url_key(F.col("dst_url")).alias("dst_key")).distinct()
    return keyed.join(src, "src_key").join(dst, "dst_key").select("src", "dst")


def lookup_ids(urls: DataFrame, nodes: DataFrame) -> DataFrame:
    """urls (url) with node_id, null where unknown; letter case does not matter."""
    return urls.withColumn("url_key", url_key(F.col("url"))).join(nodes.select("url_key", "node_id"), "url_key", "left").drop("url_key")


def node_count(edges: DataFrame, nodes: DataFrame | None = None) -> int:
    """N of the dense domain 0..N-1: one more than the largest id."""
    ids = edges.select(F.greatest("src", "dst").alias("node_id"))
    if nodes is not None:
        ids = ids.unionByName(nodes.select("node_id"))
    top = ids.agg(F.max("node_id")).first()[0]
    return 0 if top is None else int(top) + 1


def dense_nodes(edges: DataFrame, n: int) -> DataFrame:
    return edges.sparkSession.range(n).withColumnRenamed("id", "node_id")


def observed_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()


def valid_edges(edges: DataFrame, n: int, strict_dst: bool = True) -> DataFrame:
    ok = F.col("src").between(0, n - 1)
    return edges.filter(ok & F.col("dst").between(0, n - 1) if strict_dst else ok)


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree"))


def dangling_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("node_id")), "node_id", "left_anti").select("node_id")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_self_loops, n_dangling, max_out_degree."""
    degrees = nodes.select("node_id").join(out_degree(edges), "node_id", "left")
    loops = edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("n_self_loops"))
    return degrees.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.coalesce(F.sum("out_degree"), F.lit(0)).alias("n_edges"),
        F.count_if(F.col("out_degree").isNull()).alias("n_dangling"),
        F.coalesce(F.max("out_degree"), F.lit(0)).alias("max_out_degree"),
    ).crossJoin(F.broadcast(loops))


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst"])


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways, as a bag: a self-loop counts twice."""
    return edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def adjacency(nodes: DataFrame, edges: DataFrame, order: str | None = None) -> DataFrame:
    """node_id, outlinks in the order of a column (or of the ids), empty for nodes without edges."""
    item = F.struct(F.col(order), F.col("dst")) if order else F.struct(F.col("dst"))
    lists = edges.groupBy(F.col("src").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["dst"]).alias("outlinks"))
    return nodes.select("node_id").join(lists, "node_id", "left").withColumn("outlinks", F.coalesce("outlinks", F.array().cast("array<bigint>")))


def reverse_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return adjacency(nodes, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("outlinks", "inlinks")


def explode_adjacency(lists: DataFrame) -> DataFrame:
    """src, pos, dst of adjacency lists."""
    return lists.select(F.col("node_id").alias("src"), F.posexplode("outlinks").alias("pos", "dst"))


def csr_row_ptr(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, row_start, row_end: where each node's targets lie when edges are laid out by source."""
    degrees = nodes.select("node_id").join(out_degree(edges), "node_id", "left").fillna(0, ["out_degree"])
    return with_prefix_sum(degrees, ["node_id"], "out_degree", "row_start").select("node_id", "row_start", (F.col("row_start") + F.col("out_degree")).alias("row_end"))


def offset_ids(edges: DataFrame, offset: int) -> DataFrame:
    return edges.withColumns({"src": F.col("src") + offset, "dst": F.col("dst") + offset})


def offset_adjacency(lists: DataFrame, offset: int) -> DataFrame:
    return lists.select((F.col("node_id") + offset).alias("node_id"), F.transform("outlinks", lambda x: x + offset).alias("outlinks"))


def union_graphs(first: DataFrame, second: DataFrame, offset: int | None = None) -> DataFrame:
    """Edges of both graphs; offset moves the second one's ids, else ids mean the same in both."""
    return first.select("src", "dst").unionAll((second if offset is None else offset_ids(second, offset)).select("src", "dst"))


def neighbours(frontier: DataFrame, edges: DataFrame, visited: DataFrame) -> DataFrame:
    """Nodes not visited yet that an edge of a bag that holds each both ways (see undirected) joins to the frontier."""
    return edges.join(frontier.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("node_id")).distinct().join(visited, "node_id", "left_anti")
