"""Connected components of an edge table, by alternating large and small stars.

Each star step replaces edges by edges to a neighbourhood's minimum: one grouped minimum (partial
aggregation, so a hub arrives as one row per map task) and one join, which adaptive execution
splits at hubs. Nothing is collected; steps are written tables. It ends when every node that isn't a
root has one edge, to a root: as steps keep components connected and edges lead to smaller nodes, that
is each component's smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, scratch: Scratch, name: str, large: bool) -> DataFrame:
    both = edges.select("a", "b")
    if large:
        both = both.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    joined = both.join(low, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(low.select("a", F.col("low").alias("b")))
    return scratch.save(out.where("a > b").distinct(), name)


def _is_done(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node but the roots, the smallest node of each component. edges: (a, b) longs, a > b."""
    edges, step = scratch.save(edges.where("a > b").distinct(), "edges"), 0
    before = "edges"
    while not _is_done(edges):
        mid = _star(edges, scratch, f"large{step}", True)
        edges = _star(mid, scratch, f"small{step}", False)
        for name in (before, f"large{step}"):
            scratch.drop(name)
        before, step = f"small{step}", step + 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
