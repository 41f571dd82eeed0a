"""Strategies side by side, and thread-scaling arithmetic."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.pagerank import run_preset, top_k

FOUR = ("centralized_fixed", "centralized_convergence", "distributed_fixed", "distributed_convergence")
CENTRALIZED_LIMIT = 500_000
TOP = 5


def compare_strategies(edges: DataFrame, *, n: int | None = None, iterations: int = 10, threshold: float = 1e-4, strategies: tuple[str, ...] = FOUR, limit: int = CENTRALIZED_LIMIT) -> DataFrame:
    """strategy, time_ms, iterations, final_diff, top_node, top (the TOP first nodes and their ranks), speedup, agrees: one row each.

    Centralized strategies are skipped (nulls) beyond a number of nodes. speedup is against the slowest;
    agrees tells whether the top node is that of the first strategy that ran.
    """
    rows = []
    for name in strategies:
        if name.startswith("centralized") and n is not None and n > limit:
            rows.append((name, None, None, None, None, None))
            continue
        began = time.perf_counter()
        got = run_preset(name, edges, n=n, **({"iterations": iterations, "tol": 0.0} if name.endswith("fixed") else {"threshold": threshold}))
        best = [tuple(r) for r in top_k(got.ranks.select("node_id", "rank"), TOP).collect()]
        rows.append((name, 1000 * (time.perf_counter() - began), got.iterations, got.deltas[-1] if got.deltas else None, best[0][0] if best else None, best))
    table = edges.sparkSession.createDataFrame(rows, "strategy string, time_ms double, iterations int, final_diff double, top_node long, top array<struct<node_id:long,rank:double>>")
    everything = Window.partitionBy()
    return table.withColumn("speedup", F.max("time_ms").over(everything) / F.col("time_ms")).withColumn("agrees", F.col("top_node") == F.first("top_node", ignorenulls=True).over(everything))


def scaling(timings: DataFrame) -> DataFrame:
    """timings (threads, time_ms) with speedup against the fewest threads, and efficiency in percent."""
    first = F.first("time_ms").over(Window.orderBy("threads").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return timings.withColumn("speedup", first / F.col("time_ms")).withColumn("efficiency", 100 * F.col("speedup") / F.col("threads"))


def data_moved_mb(edges: Column) -> Column:
    """An estimate: eight bytes an edge."""
    return edges * 8 / (1 << 20)


def shared_memory_mb(edges: Column) -> Column:
    """An estimate: four bytes an edge."""
    return edges * 4 / (1 << 20)


def rank_array_mb(nodes: Column) -> Column:
    return nodes * 8 / (1 << 20)


def buffers_mb(nodes: Column, threads: Column) -> Column:
    return rank_array_mb(nodes) * threads


def lock_overhead_percent(centralized_ms: Column, distributed_ms: Column) -> Column:
    return F.greatest(F.lit(0.0), 100 * (centralized_ms - distributed_ms) / distributed_ms)
