"""Connected components of an edge table by contraction with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _flattened(parents: DataFrame) -> DataFrame:
    """``(node, to)`` with every node at the root of its tree: each jump halves the trees' depth."""
    while True:
        up = parents.select(F.col("node").alias("to"), F.col("to").alias("far"))
        jumped = materialise(parents.join(up, "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "jump")
        discard(parents)
        parents = jumped
        if jumped.filter("moved").isEmpty():
            return jumped


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a long, b long)``; root is the smallest node reached.

    Each round every node points to its smallest neighbour if that is smaller than itself.  The trees
    that come of it are flattened by pointer jumping, in as many jumps as their depth has bits, and all
    edges move to the roots; repeated edges and loops go.  A root that is left with an edge has a smaller
    neighbour by the next round, so two rounds halve the nodes that still have edges, at least, and the
    number of jobs grows with the logarithm of the longest path, not with its length.  Tables of past
    rounds are deleted; only flags of emptiness reach the driver.  Joins are between written tables, so
    that adaptive execution can split a root to which very many nodes point.
    """
    current = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    chain = None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = _flattened(materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "node"), "step"))
        if chain is None:
            chain = materialise(step.select("node", F.col("to").alias("root")), "chain")
        else:
            nxt = step.select(F.col("node").alias("root"), "to")
            longer = materialise(chain.join(nxt, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "chain")
            discard(chain)
            chain = longer
        left = step.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = current.join(left, "a").join(right, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        shorter = materialise(moved.filter("a <> b").distinct(), "edges")
        discard(current, step)
        current = shorter
        if current.isEmpty():
            discard(current)
            return chain
