"""Aggregates and scalar functions of one's own, on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessera.session import ship_package

Partial = Callable[[dict[str, np.ndarray], np.ndarray, int], dict[str, np.ndarray]]


def summed_by_batch(df: DataFrame, by: str, inputs: list[str], partial: Partial, sums: list[str]) -> DataFrame:
    """by and sums: what partial computes of each group, added up. An aggregate of one's own whose state adds up.

    partial gets a batch's inputs (doubles), each row's group number and the count of groups, and returns an array for each
    of sums, with a value for each group. So a batch of any number of groups is a few numpy calls, a group of any number of rows
    is one row of each batch, and only these rows are shuffled: no group ever meets in one task. Rows with a null input do
    not count; a null group is a group. Empty table: no rows.
    """
    kind = df.schema[by]
    ship_package(df.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(by).dictionary_encode(null_encoding="encode")
            values = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in inputs}
            found = partial(values, groups.indices.to_numpy(), len(groups.dictionary))
            yield pa.RecordBatch.from_arrays([groups.dictionary, *(pa.array(found[c], pa.float64()) for c in sums)], [by, *sums])

    rows = df.select(F.col(by), *[F.col(c).cast("double").alias(c) for c in inputs]).dropna(subset=inputs)
    schema = StructType([StructField(by, kind.dataType), *[StructField(c, DoubleType()) for c in sums]])
    return rows.mapInArrow(add, schema).groupBy(by).agg(*[F.sum(c).alias(c) for c in sums])


def log_moments(values: dict[str, np.ndarray], group: np.ndarray, groups: int) -> dict[str, np.ndarray]:
    """Of positive x and weights w: what a weighted geometric mean is made of."""
    w = np.where(values["x"] > 0, values["w"], 0)
    logs = np.log(np.where(values["x"] > 0, values["x"], 1))
    return {"logs": np.bincount(group, w * logs, groups), "weights": np.bincount(group, w, groups)}


def geometric_mean(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """by and mean: the weighted geometric mean of each group's positive values; null where there is none."""
    rows = df.select(F.col(by), F.col(value).alias("x"), F.col(weight).alias("w"))
    sums = summed_by_batch(rows, by, ["x", "w"], log_moments, ["logs", "weights"])
    return sums.select(by, F.when(F.col("weights") > 0, F.exp(F.col("logs") / F.col("weights"))).alias("mean"))


@F.pandas_udf(LongType())
def check_digits(number: pd.Series) -> pd.Series:
    """The two digits that make a number with them appended 1 modulo 97; null of null and of negative ones."""
    whole = number.astype("Int64")
    return (98 - (whole % 97) * 100 % 97).where(whole >= 0)
