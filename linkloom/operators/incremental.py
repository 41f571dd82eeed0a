"""Ranking again after a graph has grown, from the old ranks and only where something changed."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.lineage import cut
from linkloom.operators.graph import neighbours, undirected
from linkloom.operators.pagerank import DAMPING, MAX_ITERATIONS, Ranking, pagerank

HOPS = 3
TOLERANCE = 1e-10


def changed_nodes(old: DataFrame, new: DataFrame, ordered: bool = True) -> DataFrame:
    """node_id of nodes of the new graph that are new or whose outlinks differ; both are adjacency lists."""
    shape = (lambda c: F.col(c)) if ordered else (lambda c: F.array_sort(F.array_distinct(F.col(c))))
    before = old.select("node_id", shape("outlinks").alias("was"), F.lit(True).alias("known"))
    both = new.select("node_id", shape("outlinks").alias("now")).join(before, "node_id", "left")
    return both.filter(F.col("known").isNull() | ~F.col("was").eqNullSafe(F.col("now"))).select("node_id")


def active_region(seeds: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """node_id, hop: the seeds and all nodes within so many edges of them, either way."""
    found = cut(seeds.select("node_id", F.lit(0).alias("hop")))
    frontier = found
    ways = undirected(edges).repartition("src").persist(StorageLevel.MEMORY_AND_DISK)  # each hop joins the frontier to it where it is
    for hop in range(1, hops + 1):
        frontier = cut(neighbours(frontier, ways, found.select("node_id")).withColumn("hop", F.lit(hop)))
        found = found.unionByName(frontier)
    ways.unpersist()
    return found


def warm_start(old_ranks: DataFrame, nodes: DataFrame, n: int, damping: float = DAMPING) -> DataFrame:
    """Ranks to start from: new nodes at the teleport value, old ones scaled so that all sum to 1."""
    teleport = (1 - damping) / n
    joined = nodes.select("node_id").join(old_ranks.select("node_id", F.col("rank").alias("old")), "node_id", "left")
    sum_old, n_new = joined.agg(F.coalesce(F.sum("old"), F.lit(0.0)), F.count_if(F.col("old").isNull())).first()
    if sum_old <= 0:
        return nodes.select("node_id", F.lit(1.0 / n).alias("rank"))
    scale = (1 - n_new * teleport) / sum_old
    return joined.select("node_id", F.coalesce(F.col("old") * scale, F.lit(teleport)).alias("rank"))


@dataclass
class Recomputation:
    """An incremental ranking and what it touched."""

    ranking: Ranking
    affected: int
    active: int
    elapsed_ms: float


def incremental_pagerank(
    old_lists: DataFrame, new_lists: DataFrame, new_edges: DataFrame, old_ranks: DataFrame, *, n: int | None = None,
    dangling: str = "redistribute", tol: float | None = TOLERANCE, max_iter: int = MAX_ITERATIONS, hops: int = HOPS, damping: float = DAMPING,
) -> Recomputation:
    """Ranks of the new graph: only nodes within some hops of a change move, the others keep their scaled old rank."""
    began = time.perf_counter()
    seeds = cut(changed_nodes(old_lists, new_lists))
    got = rank_around(seeds, new_lists.select("node_id"), new_edges, old_ranks, n=n, dangling=dangling, tol=tol, max_iter=max_iter, hops=hops, damping=damping)
    return replace(got, elapsed_ms=1000 * (time.perf_counter() - began))


def rank_around(
    seeds: DataFrame, nodes: DataFrame, new_edges: DataFrame, old_ranks: DataFrame, *, n: int | None = None,
    dangling: str = "redistribute", tol: float | None = TOLERANCE, max_iter: int = MAX_ITERATIONS, hops: int = HOPS, damping: float = DAMPING,
) -> Recomputation:
    """incremental_pagerank where the changed nodes (seeds) are known."""
    began = time.perf_counter()
    n = nodes.count() if n is None else n
    region = active_region(seeds, new_edges, hops)
    start = warm_start(old_ranks, nodes, n, damping)
    ranking = pagerank(new_edges, n=n, nodes=nodes, damping=damping, dangling=dangling, tol=tol, max_iter=max_iter, init=start, active=region.select("node_id"))
    return Recomputation(ranking, seeds.count(), region.count(), 1000 * (time.perf_counter() - began))


def rank_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: n, avg_diff and max_diff of two rankings by node."""
    both = left.select("node_id", F.col("rank").alias("a")).join(right.select("node_id", F.col("rank").alias("b")), "node_id")
    diff = F.abs(F.col("a") - F.col("b"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(diff).alias("avg_diff"), F.max(diff).alias("max_diff"))


def compare_full_and_incremental(old_lists: DataFrame, new_lists: DataFrame, new_edges: DataFrame, old_ranks: DataFrame, **options) -> DataFrame:
    """One row: times and iterations of both ways, the speedup full/incremental (null if unmeasurable) and the ranks' difference."""
    dangling = options.get("dangling", "redistribute")
    began = time.perf_counter()
    full = pagerank(new_edges, nodes=new_lists.select("node_id"), dangling=dangling, tol=options.get("tol", TOLERANCE), max_iter=options.get("max_iter", MAX_ITERATIONS))
    full_ms = 1000 * (time.perf_counter() - began)
    part = incremental_pagerank(old_lists, new_lists, new_edges, old_ranks, **options)
    return rank_diff(full.ranks, part.ranking.ranks).withColumns(
        {
            "full_ms": F.lit(full_ms), "incremental_ms": F.lit(part.elapsed_ms), "speedup": F.lit(full_ms / part.elapsed_ms if part.elapsed_ms else None).cast("double"),
            "full_iterations": F.lit(full.iterations), "incremental_iterations": F.lit(part.ranking.iterations),
            "affected": F.lit(part.affected).cast("long"), "active": F.lit(part.active).cast("long"),
        }
    )
