"""Exact ranks of any number of rows, without a task that sees a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize

_PART = 2**33  # monotonically_increasing_id counts partitions in steps of this


def ranked(rows: DataFrame, order: list[Column], groups: list[str] | None = None, numbered: bool = False) -> DataFrame:
    """rows with rank (0, 1, ... within equal values of groups, in that order) and n (rows of the group);
    numbered: and group, a number for each group, in ascending order, nulls first.

    Rows are dealt to tasks by ranges of groups and order and sorted there, so a group of any share of the
    rows is as many tasks as it needs. A count for each task and group, and the sum of those before it, put
    the tasks together. order should end with a column that is different in each row: else rows alike in all
    of it meet in one task. rows should be a table, for they are read twice. Null is one group.
    """
    groups = groups or []
    keys = [F.asc_nulls_first(g) for g in groups] + order
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows, "ranges").withColumn("_part", F.floor(F.col("_at") / _PART))
    names = {g: f"_group{k}" for k, g in enumerate(groups)}
    sizes = rows.groupBy("_part", *groups).agg(F.count("*").alias("_count"), F.min("_at").alias("_first")).withColumnsRenamed(names)
    of = W.partitionBy(*(names.values() or [F.lit(0)]))
    before = F.sum("_count").over(of.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("_part", *names.values(), "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_count").over(of).alias("n"))
    more = []
    if numbered:
        sizes = materialize(sizes, "sizes")
        distinct = materialize(sizes.select(*names.values()).distinct(), "groups")
        number = ranked(distinct, [F.asc_nulls_first(g) for g in names.values()])
        number = number.select(F.col("rank").alias("group"), *[F.col(g).alias(f"{g}_") for g in names.values()])
        same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in names.values()])
        sizes, more = sizes.join(number, same).drop(*[f"{g}_" for g in names.values()]), ["group"]
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(name)) for g, name in names.items()], F.col("_part") == F.col("_of"))
    found = rows.join(sizes.withColumnRenamed("_part", "_of"), same)
    rank = F.col("_before") + F.col("_at") - F.col("_first")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("_at", "_part")], rank.alias("rank"), "n", *more)
