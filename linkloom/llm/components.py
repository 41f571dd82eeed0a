"""Connected components of a link table by alternating stars, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import cut, release

SALTS = 16  # tasks that the links of one node are dealt to


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").distinct()


def _with_least(rows: DataFrame, least: Column) -> DataFrame:
    """rows (a, b) with m: least over the least b of each a. A star's links are dealt by salt, so its centre is no hot key."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("a", "salt").agg(F.min("b").alias("m")).groupBy("a").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))
    return salted.join(parts.select("a", least.alias("m"), F.explode("salts").alias("salt")), ["a", "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to node, label: the smallest node that a node is linked to, directly or not. Nodes without links are absent."""
    edges = cut(_distinct(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _distinct(_with_least(both, F.least("a", "m")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        small = _with_least(large, F.col("m")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        spent, edges = edges, cut(_distinct(small.select(F.col("e.a").alias("a"), F.col("e.b").alias("b"))))
        release(spent)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        seen = now
