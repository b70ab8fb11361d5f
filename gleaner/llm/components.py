"""Connected components of a table of links, by alternating large and small stars.

Every step is a grouped minimum and a join, so a node with very many links costs partial minima and
a join that Spark can split; nothing is gathered per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut


def _state(e: DataFrame) -> tuple:
    got = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return got["n"], got["h"]


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest reachable node) for every node of ``links(a, b)``."""
    e = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = cut(e)
    before = _state(e)
    while before[0]:
        # Large star: each node's larger neighbours go to the smallest node of its neighbourhood.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node's smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = cut(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = _state(e)
        if now == before:
            break
        before = now
    top = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(top.select("node", F.col("node").alias("component")))
