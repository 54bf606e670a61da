"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, settled


@settled
def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node that can be reached) for every node of edges (a, b: long).

    Every round moves each node's larger neighbours to the smallest neighbour (large star), then
    its smaller ones (small star), until all edges point at their component's smallest node. The
    number of rounds grows with the logarithm of the longest path. Neighbour lists are never
    gathered: a round is two minima and two joins on them, and a node with very many neighbours
    is split by adaptive execution. Loops (a = b) and repeated edges are allowed, nulls dropped;
    no edges: no rows.
    """
    both = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")
    )
    edges = materialize(both.distinct(), "edges")
    state = _state(edges)
    while state[0]:
        new = materialize(_small_star(_large_star(edges)), "edges")
        now = _state(new)
        if now == state:
            break
        edges, state = new, now
    roots = edges.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("component"))
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Count and checksums of the edges: three numbers, however many they are."""
    sums = [F.sum(F.xxhash64(*c).cast("decimal(20,0)")) for c in (("u", "v"), ("v", "u"))]
    return tuple(edges.agg(F.count("*"), *sums).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
