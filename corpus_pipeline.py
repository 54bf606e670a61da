"""Documents to training sequences: language, near duplicates, secrets, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.langid import keep_identified
from tessera.llm.minhash import keep_distinct
from tessera.llm.mixing import mix_sources
from tessera.llm.packing import pack_documents
from tessera.llm.scratch import materialize, settled
from tessera.llm.secrets import redact_secrets
from tessera.session import ship_package, table

LEAST_SCORE = 0.3  # of the language; a text in a learned language scores higher even if it is a few words
MAX_REPEATS = 1.5  # of a source, while the least repeated one is used once


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null and empty texts, texts without letters, doubtful
    ones. Null ids and repeated rows are judged by their texts; an empty table stays one."""
    ship_package(spark)
    return keep_identified(docs, LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id, nulls last.
    Decisions are on id and text, so an id's other text stays; of rows alike in both, one stays. Texts
    without words all stay; an empty table stays one."""
    ship_package(spark)
    return keep_distinct(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, those with null or empty texts or null ids too.
    Repeated rows change alike; an empty table stays one."""
    ship_package(spark)
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, MAX_REPEATS times at most; every document is used at least once. Null
    sources are one source; rows under one id (null is one) within a source are used alike; an empty table stays one."""
    ship_package(spark)
    return mix_sources(docs, max_repeats=MAX_REPEATS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences, each row packed by itself, whatever its id; null
    and empty texts are one id. An empty table gives no rows."""
    ship_package(spark)
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix", mix), ("pack", pack)]

#: Neither the language stage's network nor the packing stage's tokenizer can be written as SQL.
ORACLE_SQL = None


@settled
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written as a table and read again. When the last one's rows
    are written, the tables before them go."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
