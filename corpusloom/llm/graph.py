"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.session import staged


def _towards_least(edges: DataFrame) -> DataFrame:
    """Each (u, v) with ``m``, the least of u and its neighbours.

    The minima are combined before the shuffle and joined back, so that a node
    with very many neighbours is no group in one task.
    """
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node that can reach a lesser one; root is the least node reachable.

    Large stars hang a node's greater neighbours under its least neighbour,
    small stars do so with the lesser ones (Kiveris and others, 2014). The
    number of rounds grows with the logarithm of the longest path. Each round is
    written to shared storage, which cuts the lineage.
    """
    current = staged(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges"
    )
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _towards_least(large)
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        own = large.groupBy("u").agg(F.min("v").alias("v"))
        current = staged(linked.unionByName(own).distinct(), "edges")
        state = current.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.col("v").cast("decimal(38,0)"))
        ).first()
        if before == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
