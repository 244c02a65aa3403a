"""Connected components by alternating large and small stars, on edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.shared import discard, stored

MAX_ROUNDS = 60


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: each node has one edge downwards, or stands at the lower end alone."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionAll(edges.select("v", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
    return nodes.where("up > 1 or (up = 1 and low = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge; label is the smallest node reachable.

    ``edges`` has columns u, v. Each round joins the edges to the smallest neighbour of each node and writes the new edges
    to the shared folder; no neighbour list is ever gathered, so a node with very many edges is one more hot join key.
    """
    edges = stored(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges"
    )
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(before, large)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
