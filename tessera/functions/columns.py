"""Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(column: str) -> Column:
    """A double as a decimal: sums don't depend on the order of rows."""
    return F.col(column).cast("decimal(18,4)")


def dot(x: Column, y: Column) -> Column:
    """Inner product of two arrays of equal length, added from the first component on."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column) -> Column:
    """Null for a zero vector."""
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)


def sample_skewness(column: str) -> Column:
    """Skewness with the sample correction; Spark's own is the population's."""
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def variant_path(json: str, path: str, kind: str) -> Column:
    """What is at a path of a JSON text, as a type; null where the text is none, or nothing of that type is there."""
    return F.try_variant_get(F.try_parse_json(json), path, kind)


def gathered_schema(df: DataFrame, json: str) -> str:
    """The schema that all JSON texts of a column have in common: one row, merged from partitions' schemas."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(json)).alias("kind")).first()["kind"]
