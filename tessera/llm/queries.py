"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.session import ship_package, table

from . import embeddings, licenses, media, merkle, mixing, resampling, secrets, suffixdedup, urlfilter
from .langid import identify_languages
from .minhash import near_duplicates
from .neighbours import nearest
from .packing import pack_documents


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.near_media(media.draw_embeddings(table(spark, sf_dir, "embeddings")))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_embeddings(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=0.8)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_schedule(table(spark, sf_dir, "documents"), max_repeats=2.0)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"), merkle.without_newlines_where_even())


_QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_language_id": op2_language_id,
    "op3_url_filters": op3_url_filters,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_media_columns": op5_media_columns,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_license_scans": op10_license_scans,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _shipped(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(query) for name, query in _QUERIES.items()}

ORACLE_SQL = {
    "op1_secret_scans": secrets.ORACLE_SQL,
    "op3_url_filters": urlfilter.ORACLE_SQL,
    "op4_suffix_array_dedup": suffixdedup.ORACLE_SQL,
    "op6_embedding_near_dedup": embeddings.ORACLE_SQL,
    "op9_mixing": mixing.ORACLE_SQL,
    "op10_license_scans": licenses.ORACLE_SQL,
    "op12_importance_resampling": resampling.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
    "op7_minhash_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s
            FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
            FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
            WHERE 100 * c >= 80 * (p.n + q.n - c)),
        reach AS (
            SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = r)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id, min(r) = d.doc_id AS kept
        FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.doc_id = d.doc_id
        GROUP BY d.doc_id, n""",
}
