"""Connected components by alternating large and small stars.

Every step is a minimum by node, which combines on the map side, and an equi-join
back, which adaptive execution may split on a hot node.  The number of steps grows
with the logarithm of the longest path.  Nothing is collected but a step's count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges from each node's neighbours to the least of them and the node."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges  # a > b: only smaller neighbours
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = near.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to (node, component): the least node reachable, for
    every node with a link to another.  No links give an empty result."""
    edges = materialise(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _sum(edges)
    while before[0]:
        edges = materialise(_star(_star(edges, True), False), "edges")
        now = _sum(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
