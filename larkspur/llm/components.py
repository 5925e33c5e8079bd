"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: longs): the least node of its component.

    Each round gives every node the least node around it, then that one's own least node, and joins the nodes with equal
    labels into one. Edges within such a node go, so that each round works on a smaller graph; what rounds gave is put
    together at the end. With node numbers in no order along paths (hashes) a round takes a fixed share of the nodes away.
    Every round is a stored table.
    """
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "component-edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("near")), "component-near")
        up = near.select(F.col("node").alias("near"), F.col("near").alias("label"))
        rounds.append(stored(near.join(up, "near").select("node", "label"), "component-labels"))
        for end in ("a", "b"):
            edges = edges.join(rounds[-1].withColumnRenamed("node", end), end).drop(end).withColumnRenamed("label", end)
        edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "component-edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("node").alias("label"), F.col("label").alias("last"))
        found = rounds.pop().join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return stored(found, "component-labels")
