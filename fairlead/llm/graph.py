"""Connected components of a graph that is too large for one machine, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.functions.stages import discard, durable

__all__ = ["components", "durable"]


def _state(edges: DataFrame) -> tuple:
    """What tells one set of edges from another."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b) of longs; root is a component's least node.

    A large star hangs a node's greater neighbours on its least one, a small star the lesser ones; what remains in the
    end are stars around the roots. Rows never exceed the edges', a few rounds do, and each is kept durably. A node
    with very many neighbours is one key of a join, whose large partitions adaptive execution splits, and of a
    minimum, which is aggregated before it is shuffled.
    """
    now = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # now a > b in every row
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        last, now = now, durable(hung.select("e.*").filter("a <> b").distinct())
        discard(last)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
