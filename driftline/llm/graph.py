"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _rewire(neighbours: DataFrame, keep_self: bool) -> DataFrame:
    """For every node, its neighbours (column b) and itself linked to the smallest of them all.

    The smallest is found by an aggregation with map-side sums; the join back may meet a node
    with very many neighbours, which adaptive execution splits.
    """
    neighbours = materialise(neighbours, "neighbours")
    # Written, so that the join reads both sides from a shuffle and a hot side can be split.
    smallest = materialise(neighbours.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "smallest")
    linked = neighbours.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if keep_self:
        linked = linked.unionByName(smallest.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that can be reached.

    edges: columns a and b of one type, no nulls. Large and small stars alternate until every
    node hangs directly below its root; each round is written, so no lineage builds up.
    """
    edges = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        around = _both_ways(edges)
        # Large star: the larger neighbours of a node move to its smallest neighbour.
        small = materialise(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "smallest")
        large = around.join(small, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of these.
        new = materialise(_rewire(large, keep_self=True), "edges")
        change = new.select("a", "b").exceptAll(edges.select("a", "b")).isEmpty() and new.count() == edges.count()
        edges = new
        if change:
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.join(edges, roots.node == edges.a, "left_anti").select("node", F.col("node").alias("root"))
    )
