"""Ranks that follow a growing graph: each batch of new edges ranks again only what it touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.lineage import cut, release
from linkloom.operators.graph import node_count
from linkloom.operators.incremental import rank_around
from linkloom.operators.pagerank import pagerank

MERGE_AFTER = 16  # batches that are kept as parts of the edge table before they are merged


class RankFollower:
    """Holds edges and ranks; add() takes a batch of edges (src, dst). Use add in foreachBatch.

    A batch is written as one more part of the edge table. Edges only come, so the nodes whose outlinks changed are the sources
    of new edges and the new ids; no lists are built or compared. Ranks of an earlier batch are deleted once a later one is in.
    """

    def __init__(self, edges: DataFrame, **options):
        self.options = {"dangling": "redistribute", "tol": 1e-10} | options
        self.parts = [cut(edges.select("src", "dst").distinct())]
        self.n = node_count(self.edges)
        full = {k: v for k, v in self.options.items() if k != "hops"}
        self.ranks = pagerank(self.edges, n=self.n, **full).ranks
        self.batches = 0

    @property
    def edges(self) -> DataFrame:
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionAll(part)
        return out

    def add(self, batch: DataFrame, number: int = -1) -> None:
        fresh = cut(batch.select("src", "dst").distinct().join(self.edges, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return
        n = max(self.n, node_count(fresh))
        self.parts.append(fresh)
        if len(self.parts) > MERGE_AFTER:
            merged = cut(self.edges)
            release(*self.parts)
            self.parts = [merged]
        spark = fresh.sparkSession
        seeds = cut(fresh.select(F.col("src").alias("node_id")).unionAll(spark.range(self.n, n).withColumnRenamed("id", "node_id")).distinct())
        nodes = spark.range(n).withColumnRenamed("id", "node_id")
        before, self.ranks = self.ranks, cut(rank_around(seeds, nodes, self.edges, self.ranks, n=n, **self.options).ranking.ranks)
        release(before)
        self.n, self.batches = n, self.batches + 1

    def top(self, k: int = 5) -> DataFrame:
        return self.ranks.orderBy(F.desc("rank"), "node_id").limit(k)
