"""Writers of text graphs, rank tables and reports, one part file per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adjacency_lines(lists: DataFrame) -> DataFrame:
    return lists.select(F.concat(F.col("node_id").cast("string"), F.lit(":"), F.array_join(F.transform("outlinks", lambda x: x.cast("string")), ",")).alias("value"))


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))


def url_map_lines(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.concat(F.col("node_id").cast("string"), F.lit(": "), F.col("url")).alias("value"))


def converted(spark, vertices: str, edges: str, folder: str) -> tuple[int, int]:
    """A vertex file and an edge file as adjacency lists, edge list and URL map in a folder; the numbers of nodes and edges."""
    from linkloom.operators.graph import adjacency as lists_of
    from linkloom.sources.readers import read_vertex_edge

    nodes, pairs = read_vertex_edge(spark, vertices, edges)
    top = nodes.agg(F.max("node_id")).first()[0]
    n = 0 if top is None else top + 1
    pairs = pairs.cache()
    count = pairs.count()
    save_graph(lists_of(spark.range(n).withColumnRenamed("id", "node_id"), pairs), f"{folder}/graph.adj", "adjacency", ["Graph for PageRank (Adjacency List Format)", f"Nodes: {n}", f"Edges: {count}", "Format: node_id: outlink_id1,outlink_id2,...", ""])
    save_graph(pairs, f"{folder}/graph.edge", "edgelist", ["Edge list format: src dst", f"Total edges: {count}", ""])
    save_lines(url_map_lines(synthetic_urls(n, spark)), f"{folder}/url_map")
    pairs.unpersist()
    return n, count


def offset_url_map_lines(nodes: DataFrame, offset: int) -> DataFrame:
    return url_map_lines(nodes.withColumn("node_id", F.col("node_id") + offset))


def synthetic_urls(n: int, spark) -> DataFrame:
    """node_id, url for graphs that come without URLs."""
    return spark.range(n).select(F.col("id").alias("node_id"), F.format_string("http://graph500-node-%d.synthetic/", F.col("id")).alias("url"))


def rank_table_lines(ranks: DataFrame) -> DataFrame:
    """``id | rank | percent of the highest``."""
    top = ranks.agg(F.max("rank").alias("_top"))
    percent = F.when(F.col("_top") > 0, 100 * F.col("rank") / F.col("_top")).otherwise(0.0)
    return ranks.crossJoin(F.broadcast(top)).select(F.format_string("%d | %.12f | %.6f%%", "node_id", "rank", percent).alias("value"))


def rank_lines(ranks: DataFrame) -> DataFrame:
    return ranks.select(F.format_string("%d %.15e", "node_id", "rank").alias("value"))


def comment_lines(df: DataFrame, comments: list[str]) -> DataFrame:
    """Header lines in front of others."""
    return df.sparkSession.createDataFrame([(f"# {c}" if c else "",) for c in comments], "value string").unionAll(df)


FORMATS = {"adjacency": adjacency_lines, "edgelist": edge_lines}


def save_graph(df: DataFrame, path: str, fmt: str, comments: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write adjacency lists or edges as text; another format is an error."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown graph format: {fmt}")
    lines = FORMATS[fmt](df)
    save_lines(comment_lines(lines, comments) if comments else lines, path, mode)


def save_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.write.mode(mode).text(path)


def copy_lines(spark, source: str, target: str, mode: str = "overwrite") -> None:
    """Copy a text file or folder, or append it to another (mode append)."""
    save_lines(spark.read.text(source), target, mode)


def show_ranks(ranks: DataFrame, most: int = 20) -> str:
    """The first rows of a rank table, by rank, as text; printed as well."""
    top = ranks.agg(F.max("rank").alias("_top"))
    first = ranks.crossJoin(F.broadcast(top)).orderBy(F.desc("rank"), "node_id").limit(most)
    percent = F.when(F.col("_top") > 0, 100 * F.col("rank") / F.col("_top")).otherwise(0.0)
    said = "\n".join(r[0] for r in first.select(F.format_string("node_%d | %.12f | %.6f%%", "node_id", "rank", percent)).collect())
    print(said)
    return said


def save_key_values(spark, path: str, values: dict[str, object], mode: str = "overwrite", sign: str = ": ") -> None:
    """Phase metadata, or a run's block of a manifest (mode append, sign =)."""
    save_lines(spark.createDataFrame([(f"{k}{sign}{v}",) for k, v in values.items()], "value string").coalesce(1), path, mode)


def strategy_report(results: DataFrame) -> DataFrame:
    """The comparison as text lines, with the first nodes by rank where results have them (column top: node_id, rank); a skipped
    strategy says so."""
    ran = F.format_string("%s | %.2f | %d | %s | %.2fx", "strategy", "time_ms", "iterations", F.coalesce(F.format_string("%.4e", "final_diff"), F.lit("-")), "speedup")
    line = F.when(F.col("time_ms").isNull(), F.concat("strategy", F.lit(" | SKIPPED"))).otherwise(ran)
    if "top" not in results.columns:
        return results.select(line.alias("value"))
    top = F.transform(F.coalesce("top", F.array()), lambda x: F.format_string("    node_%d: %.12f", x["node_id"], x["rank"]))
    return results.select(F.explode(F.concat(F.array(line), top)).alias("value"))
