"""Connected components over an edge table, by alternating large and small stars.

Every round is two shuffles of the edges; a hub's edges are pre-aggregated by
the engine, and adaptive execution divides a hot hub's join.  Lineage is cut
once a round through a table in the shared folder.  Rounds end as soon as the
edges are stars, which one pre-aggregated shuffle of their ends tells.  Nothing
but that answer reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def _star(directed: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large star) or smaller neighbours, and itself,
    to the least of its neighbourhood."""
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = directed.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each edge leads from a node to its component: the edges lead to
    smaller nodes, so none may start twice from a node, or from another's end."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    per_node = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return per_node.where(F.col("out") + F.col("in") > 1).where("out > 0").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least member) of every node that has an edge.

    Null ends and loops are ignored; repeated edges count once; an empty table
    gives an empty result.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True)
        # After the large star every edge leads from a node to a smaller one.
        edges = materialize(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False), "components")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
