"""Small inputs that every operator must bear."""

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and blank texts, repeated rows, ties.
ODD = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, " \n\t ", "en", None, 4),
    (None, "token = abcdef and so on and on", "en", "b", 31),
    (5, "the same words here again", "en", "b", 25),
    (5, "the same words here again", "en", "b", 25),
    (6, "the same words here again", "de", "b", 25),
    (7, "*** 123 ###", "de", "c", 11),
]


def frame(spark, rows, schema=DOCUMENT):
    return spark.createDataFrame(rows, schema)


def clashing(docs):
    """docs with more columns, named like those that operators make."""
    from pyspark.sql import functions as F

    more = ("node", "component", "key", "row", "draw", "rank", "class", "tokens", "anchor", "bucket", "_found", "pass", "a", "b", "label")
    return docs.select("*", *[F.lit(f"x{k}").alias(c) for k, c in enumerate(more)])
