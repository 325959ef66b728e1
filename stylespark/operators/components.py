"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylespark.runtime import looked_up, release, settled

#: Rounds are logarithmic in the length of the longest path; more than this means a fault.
MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """Each u with its least neighbour and its number of edges."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many"))


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): every node but the roots, with the smallest node of its component. edges: u, v of one type; self-loops and repeats are dropped.

    A hub's edges are never gathered: its least neighbour comes from partial aggregates and goes back by broadcast."""
    now = settled(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(now)
    if not before[0]:
        return now
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both).select("u", F.least("u", "m").alias("m"), "many")
        large = looked_up(both, "u", low, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = looked_up(large, "u", _least(large), 2 * before[0])
        small = near.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = settled(small, "edges")
        after = _state(new)
        release(now)
        now = new
        if after == before:
            return now
        before = after
    raise RuntimeError("components did not settle")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for all nodes with an edge to another. edges: two columns of one type."""
    a, b = edges.columns[:2]
    forest = stars(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
    return forest.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(forest.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
