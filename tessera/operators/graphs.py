"""Recursion over edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import write_shared


def reached(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, steps: every node that edges (src, dst) lead to from the nodes of starts (node), with the fewest steps; after
    most steps no further. Starts themselves have 0.

    Semi-naive: a round follows the edges of the nodes that the round before has found, drops what is known, and ends when nothing
    is new, so each edge is followed once. Each round's new nodes are a table; a node with very many edges is split by
    adaptive execution, for the join is all that is done with them before targets are counted once. Nulls are dropped,
    loops and repeated edges harmless. No starts: no rows.
    """
    edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    new = write_shared(starts.select("node").where("node IS NOT NULL").distinct().withColumn("steps", F.lit(0)), "reached")
    found, steps = [new], 0
    while (most is None or steps < most) and new.limit(1).count():
        steps += 1
        ahead = new.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        known = reduce(DataFrame.unionByName, found).select("node")
        new = write_shared(ahead.join(known, "node", "left_anti").withColumn("steps", F.lit(steps)), "reached")
        found.append(new)
    return reduce(DataFrame.unionByName, found)
