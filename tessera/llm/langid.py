"""Language identification by a recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .gru import PAD, probabilities, train
from .scratch import materialize

SAMPLE_DOCS = 240  # labelled documents of a language that training sees, at most
SAMPLE_TOTAL = 48_000  # of all languages, at most: very many languages share it
SNIPPETS, SNIPPET = 4, 64  # pieces of each, and their bytes
HIDDEN, EPOCHS, BATCH, SEED = 8, 8, 64, 11
MOST_LANGUAGES = 5_000  # with more distinct values, lang is hardly a language
CHUNK, CHUNKS = 256, 1024  # bytes whose states are kept, and chunks computed together, at most
WIDTH = 8_192  # chunks times languages computed together, at most
LEAD = 64  # bytes before a chunk (behind it, for the backward state) that a state runs over first
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame) -> DataFrame:
    """lang, h, at, piece (text) of at most SAMPLE_DOCS documents of each language, SAMPLE_TOTAL in all, none
    held out: those whose texts have the smallest hashes. Every language is learned. A language's share
    of rows that can be among them is cut off by its count first, so no task orders more than a few
    times the sample."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    usable = usable.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    h = F.xxhash64("text")
    # texts, not rows: of a language that is mostly copies of a few texts, those few must be found
    counts = materialize(usable.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")), "languages")
    languages = counts.count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"lang has {languages} values; at most {MOST_LANGUAGES} languages can be told apart")
    each = max(1, min(SAMPLE_DOCS, SAMPLE_TOTAL // max(1, languages)))
    share = (h.cast("double") / float(2**64)) + 0.5
    few = usable.join(counts, "lang").where(share <= F.lit(4.0 * each) / F.col("n"))
    # equal texts have one hash: one of them is enough, and copies cannot crowd out the rest
    picked = few.groupBy("lang", h.alias("h")).agg(F.first("text").alias("text"))
    picked = picked.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each)
    starts = F.array(*[F.pmod(F.xxhash64("h", F.lit(i)), F.greatest(F.length("text") - SNIPPET // 2, F.lit(1))) for i in range(SNIPPETS)])
    pieces = picked.withColumn("at", F.explode(starts))
    return pieces.select("lang", "h", "at", F.substring("text", (F.col("at") + 1).cast("int"), F.lit(SNIPPET)).alias("piece"))


def fit_languages(docs: DataFrame) -> tuple[list[str], dict[str, np.ndarray]]:
    """The languages learned and the network's weights. The sample is bounded by the parameters above,
    so it is fitted in one place; the weights, some tens of kilobytes, go to the tasks."""
    rows = sorted(training_sample(docs).collect(), key=lambda r: (r["lang"], r["h"], r["at"]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return [], {}
    data = np.full((len(rows), SNIPPET), PAD, dtype=np.int64)
    for row, r in zip(data, rows, strict=True):
        raw = np.frombuffer(r["piece"].encode("utf-8", "replace")[:SNIPPET], dtype=np.uint8)
        row[: len(raw)] = raw
    number = {x: k for k, x in enumerate(languages)}
    labels = np.array([number[r["lang"]] for r in rows])
    return languages, train(np.ascontiguousarray(data.T), labels, len(languages), HIDDEN, EPOCHS, BATCH, SEED)


def _pooled(weights: dict, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text: the mean of its positions' probabilities, and the share of positions that each
    language labels. Texts are cut into chunks, each with LEAD bytes of the text on both sides, over which
    the states of either direction run before they count; chunks of many texts are computed side by side."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    chunks = -(-lengths // CHUNK)
    owner = np.repeat(np.arange(len(texts)), chunks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    classes = len(weights["c"])
    pooled, labelled = np.zeros((len(texts), classes)), np.zeros((len(texts), classes))
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int16)
    first = (np.cumsum(lengths) - lengths)[owner]
    last = first + lengths[owner]
    width = np.arange(-LEAD, CHUNK + LEAD)[:, None]
    order = np.argsort(np.minimum(lengths[owner] - number * CHUNK, CHUNK + LEAD), kind="stable")  # short ones together
    together = max(1, min(CHUNKS, WIDTH // classes))
    for low in range(0, len(owner), together):
        some = order[low : low + together]
        at = first[some] + number[some] * CHUNK + width
        real = (at >= first[some]) & (at < last[some])
        used = np.flatnonzero(real.any(axis=1))  # a batch of short texts is not run to the chunk's end
        at, real = at[used[0] : used[-1] + 1], real[used[0] : used[-1] + 1]
        data = np.where(real, flat[np.clip(at, 0, len(flat) - 1)], PAD)
        p = probabilities(weights, data)
        inside = real & (width[used[0] : used[-1] + 1] >= 0) & (width[used[0] : used[-1] + 1] < CHUNK)
        top = p.argmax(axis=0)
        for k in range(classes):
            pooled[:, k] += np.bincount(owner[some], (p[k] * inside).sum(axis=0), len(texts))
            labelled[:, k] += np.bincount(owner[some], ((top == k) & inside).sum(axis=0), len(texts))
    n = np.maximum(lengths, 1)[:, None]
    return pooled / n, labelled / n


def _predicted(docs: DataFrame, carried: Column) -> DataFrame:
    """row (what is carried along), lang_pred, score, agreeing for each row of docs."""
    languages, weights = fit_languages(docs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [(t.as_py() or "").encode("utf-8", "replace") if u.as_py() and languages else b"" for t, u in zip(part[1], part[2], strict=True)]
                names, scores, shares = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
                if languages:
                    pooled, labelled = _pooled(weights, texts)
                    for i, t in enumerate(texts):
                        if t:
                            k = int(pooled[i].argmax())
                            names[i], scores[i], shares[i] = languages[k], min(1.0, float(pooled[i][k])), float(labelled[i][k])
                yield pa.RecordBatch.from_arrays([part[0], pa.array(names), pa.array(scores), pa.array(shares)], ["row", "lang_pred", "score", "agreeing"])

    text = F.col("text").cast("string")
    rows = docs.select(carried.alias("row"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("usable"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(predict, f"row {kind}, lang_pred string, score double, agreeing double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text, lang; other columns are ignored): doc_id, held_out
    (crc32 of the id as text, modulo 4, is 2), lang_pred, score (0 to 1), agreeing (the share of
    positions labelled lang_pred).

    Learned from text and lang of rows that are not held out (training_sample); predicted from every
    byte of the text alone. Each position is labelled with the languages' probabilities from the
    states of both directions; the document's are their mean. States run over chunks of CHUNK bytes and
    LEAD more before them, for a state forgets what is further off (the tests hold that against states
    that run over whole texts), so a text's length is no matter. Null texts
    and texts without a letter are und with score 0, as is every text if nothing could be learned.
    More than MOST_LANGUAGES values of lang are an error, for the driver learns from a sample of each. Chunks computed
    together are fewer the more languages there are, so a task's memory does not grow with them.
    A null doc_id counts as not held out. Repeated rows get equal results. Empty table: no rows.
    """
    carried = F.struct(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"))
    return _predicted(docs, carried).select("row.doc_id", "row.held_out", "lang_pred", "score", "agreeing")


def keep_identified(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows of docs, all columns, whose language is determined with at least that score: null and
    empty texts and those without a letter go. Null ids are like any, repeated rows share a fate, a
    table without rows gives none. Rows travel along with their text, so nothing is joined or shuffled."""
    return _predicted(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns])).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)).select("row.*")
