"""Connected components of an edge table by repeated contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; ``component`` is the smallest node reachable.

    Each round sends every node to its smallest neighbour's smallest neighbour and moves the edges there, which at least
    halves the nodes left.  Every table is written, so that joins see two plain shuffles whose hot keys Spark can split.
    Null ends and loops count for nothing; an empty table gives an empty table.
    """
    e = materialise(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    steps: list[DataFrame] = []
    while not e.isEmpty():
        ends = e.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
            e.select(F.col("b").alias("node"), F.col("a").alias("to"))
        )
        near = materialise(ends.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("up")))
        top = materialise(
            near.join(near.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "top")
        )
        steps.append(top)
        moved = (
            e.join(top.select(F.col("node").alias("a"), F.col("top").alias("x")), "a")
            .join(top.select(F.col("node").alias("b"), F.col("top").alias("y")), "b")
            .select("x", "y")
        )
        # A node that others were sent to, but that was itself sent on, stays tied to where it went.
        used = top.select(F.col("top").alias("node")).distinct()
        tied = top.join(used, "node").select(F.col("node").alias("x"), F.col("top").alias("y"))
        e = materialise(
            moved.unionByName(tied).filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
    if not steps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = steps[-1].select("node", F.col("top").alias("component"))
    for top in reversed(steps[:-1]):
        later = label.select(F.col("node").alias("top"), F.col("component").alias("c"))
        label = materialise(top.join(later, "top", "left").select("node", F.coalesce("c", "top").alias("component")))
    return label
