"""Packing documents into sequences by cutting stock over the histogram of piece lengths."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cutting import whole_patterns
from .scratch import materialize, settled

CAPACITY = 1024
#: (length, step): lengths up to that one are rounded up to multiples of the step in the linear program, short ones not at all.
CLASSES = ((64, 1), (128, 2), (256, 4), (CAPACITY, 8))
BUCKET_PIECES = 1024
END = 0

#: Texts for which the rank file's encoder gives the tokenizer file's ids: no character beyond Latin, no
#: control or space that engines classify differently, no added token's name. The tests hold both against
#: each other on all of documents and on random texts.
_SIMPLE = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*")


@cache
def _encoders(vocabulary: str, ranks: str | None):
    """The tokenizer of a file and, if its ranks are given, a faster encoder with the same ids, and the names
    of the file's added tokens. Kept for as long as the worker lives."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    if ranks is None:
        return tokenizer, None, added
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tokenizer, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}), added


def token_ids(text: str, vocabulary: str, ranks: str | None = None) -> np.ndarray:
    """The ids of a whole text by the tokenizer of the file vocabulary, without special tokens added."""
    tokenizer, fast, added = _encoders(vocabulary, ranks)
    if fast is not None and _SIMPLE.fullmatch(text) and not any(name in text for name in added):
        return np.array(fast.encode_ordinary(text), dtype="<u4")
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut_pieces(docs: DataFrame, capacity: int, vocabulary: str, ranks: str | None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens for each piece: whole sequences from the
    document's beginning, then the rest. Texts are tokenized where they are read."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                ids = np.append(token_ids(text.as_py() or "", vocabulary, ranks), np.uint32(END)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    for column, value in zip(out, (i, start, len(piece), zlib.crc32(piece), len(ids)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, ", ".join(f"{n} long" for n in names))


def _class(length: Column) -> Column:
    """A piece's length as the linear program counts it."""
    out = F.lit(None).cast("long")
    for most, step in reversed(CLASSES):
        out = F.when(length <= most, F.ceil(length / step) * step).otherwise(out)
    return out


def _places(histogram: dict[int, int], capacity: int) -> list[tuple]:
    """Intervals of ranks within a class of lengths and where they go: (class, low, high, first
    sequence, how many side by side, pieces before them in the sequence's order)."""
    whole = {k: n for k, n in histogram.items() if k == capacity}
    patterns = whole_patterns({k: n for k, n in histogram.items() if k not in whole}, capacity)
    patterns += [(((k, 1),), n) for k, n in whole.items()]
    out, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, often in patterns:
        slot = 0
        for k, count in pattern:
            out.append((k, taken[k], taken[k] + often * count, sequence, count, slot))
            taken[k] += often * count
            slot += count
        sequence += often
    return out


@settled
def pack_documents(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of the rows of
    docs (doc_id, text; other columns are ignored), in sequences of CAPACITY tokens.

    Documents are tokenized (vocabulary: a tokenizer's file, by default the public byte-level one of
    50k ids, with ranks as a faster equal) and end with id 0. Pieces are counted by length, rounded
    up to CLASSES (short ones are exact); the histogram, of 224 counts whatever the corpus, is
    all that the driver sees. Column generation finds patterns of classes that fill a sequence, which
    become intervals of ranks: the piece of that rank among its class goes to that place. The
    intervals, some for each pattern and class, are bounded like the histogram and are broadcast.
    Ranks come from counts of buckets and positions in a bucket, so a common length, such as that of
    whole sequences or of a much copied document, is many tasks.

    Null and empty texts are the one id 0. Repeated rows and rows under one id are packed like any others,
    however many; a null doc_id stays null. Texts of any length are cut whole. Empty table: no rows.
    """
    if vocabulary is None:
        vocabulary, ranks = default_paths()
    pieces = cut_pieces(docs, CAPACITY, vocabulary, ranks).withColumn("class", _class(F.col("length")))
    # a number for each row, written with it: rows that are alike in all else are dealt to many buckets too
    pieces = materialize(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    counts = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}  # at most 224 rows
    places = docs.sparkSession.createDataFrame(
        _places(counts, CAPACITY) or [(0, 0, 0, 0, 1, 0)], "class long, low long, high long, first long, side long, slot long"
    )

    total = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in (counts or {0: 0}).items() for x in kv]), F.col("class"))
    spread = F.pmod(F.xxhash64("number"), F.floor(total / BUCKET_PIECES) + 1)
    dealt = pieces.withColumn("bucket", spread)
    ahead = W.partitionBy("class").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("class", "bucket").count().withColumn("ahead", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
    within = W.partitionBy("class", "bucket").orderBy("number")
    ranked = dealt.join(sizes.drop("count"), ["class", "bucket"]).withColumn("rank", F.col("ahead") + F.row_number().over(within) - 1)

    at = F.col("rank") - F.col("low")
    placed = (
        ranked.alias("r")
        .join(F.broadcast(places).alias("p"), (F.col("r.class") == F.col("p.class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .withColumn("sequence_id", F.col("first") + F.floor(at / F.col("side")))
        .withColumn("slot", F.col("slot") + at % F.col("side"))
    )
    row = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(row), F.lit(0))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
