"""Readers of text graphs. Lines may be of any length and end in CR LF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import leading_int


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", r"\s+$", "").alias("value"))


def read_adjacency(spark: SparkSession, path: str, repeated: str = "append", n: int | None = None) -> DataFrame:
    """node_id, outlinks of ``id:a,b`` lines; others (comments, blank) are skipped.

    repeated lines of an id: "append" their lists in file order, or the last one ("overwrite"). With n,
    targets outside 0..n-1 are dropped.
    """
    rows = _lines(spark, path).withColumn("at", F.monotonically_increasing_id()).filter(~F.col("value").startswith("#") & F.col("value").contains(":"))
    parts = F.split("value", ":", 2)
    targets = F.transform(F.filter(F.split(F.get(parts, 1), ","), lambda t: F.trim(t) != ""), leading_int)
    if n is not None:
        targets = F.filter(targets, lambda t: t.between(0, n - 1))
    lists = rows.select(leading_int(F.get(parts, 0)).alias("node_id"), "at", targets.alias("outlinks"))
    if repeated == "overwrite":
        return lists.groupBy("node_id").agg(F.max_by("outlinks", "at").alias("outlinks"))
    return lists.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("at", "outlinks"))).alias("all")).select("node_id", F.flatten(F.transform("all", lambda x: x["outlinks"])).alias("outlinks"))


def adjacency_edges(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("node_id").alias("src"), F.explode("outlinks").alias("dst"))


def read_edges(spark: SparkSession, path: str, undirected: bool = False) -> DataFrame:
    """src, dst of ``src dst`` lines; undirected gives each both ways."""
    pair = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).filter(F.col("value").rlike(r"^\s*-?\d+\s+-?\d+"))
    edges = rows.select(F.get(pair, 0).cast("long").alias("src"), F.get(pair, 1).cast("long").alias("dst"))
    return edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if undirected else edges


def read_vertex_edge(spark: SparkSession, vertices: str, edges: str, strict_dst: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a vertex file and an edge file; edges with an end outside 0..N-1 are dropped."""
    nodes = _lines(spark, vertices).filter(F.col("value").rlike(r"^\s*-?\d+")).select(leading_int(F.col("value")).alias("node_id"))
    pairs = read_edges(spark, edges)
    n = nodes.agg((F.max("node_id") + 1).alias("n"))
    inside = F.col("src").between(0, F.col("n") - 1)
    inside = inside & F.col("dst").between(0, F.col("n") - 1) if strict_dst else inside
    return nodes, pairs.crossJoin(F.broadcast(n)).filter(inside).select("src", "dst")


def read_url_map(spark: SparkSession, path: str) -> DataFrame:
    """node_id, url of ``id: url`` lines (a missing colon is accepted); the URL ends at white space."""
    pattern = r"^\s*(-?\d+):?\s+(\S+)"
    rows = _lines(spark, path).filter(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).cast("long").alias("node_id"), F.regexp_extract("value", pattern, 2).alias("url"))


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """node_id, rank of raw (``id rank``) or table (``id | rank | percent``) files."""
    pattern = r"^\s*(\d+)\s*\|?\s*([-+0-9.eE]+)"
    rows = _lines(spark, path).filter(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).cast("long").alias("node_id"), F.regexp_extract("value", pattern, 2).cast("double").alias("rank"))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """key, value of ``key: value`` or ``key=value`` lines."""
    pattern = r"^([A-Za-z0-9_]+)\s*[:=]\s*(.*)$"
    rows = _lines(spark, path).filter(F.col("value").rlike(pattern))
    return rows.select(F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).alias("value"))


def read_metadata(spark: SparkSession, path: str) -> dict[str, int]:
    """Counts of the phases; a handful of lines."""
    return {r["key"]: int(r["value"]) for r in read_key_values(spark, path).filter(F.col("value").rlike(r"^\d+$")).collect()}
