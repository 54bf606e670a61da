"""Importance resampling: documents drawn by how much more their n-grams are a target's than the corpus's."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import ranked
from .scratch import materialize, settled

BLOCK_BYTES = 32 << 20  # of the texts that are numbered together
SLICE_BYTES = 1 << 20  # of a text that is in words at a time

#: Of a word: digits, letters of a to z (A to Z are lower-cased) and every byte of a character beyond ASCII. Others become blanks.
_WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


class _Numbers(dict):
    """Numbers for keys in the order in which they come."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _word_ids(text: bytes, words: _Numbers) -> np.ndarray:
    """The numbers of a text's words, in order; the text is cut between words, so its list of words is never whole."""
    text = text.translate(_WORD_BYTES)
    out, low = [], 0
    while low < len(text):
        high = text.find(b" ", low + SLICE_BYTES)
        high = len(text) if high < 0 else high
        out.append(np.fromiter(map(words.__getitem__, text[low:high].split()), dtype=np.int64))
        low = high
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


class _Block:
    """The words and n-grams of some documents: words by numbers, longer ones by the number of what comes before
    their last word, and the last word's."""

    def __init__(self, number: int):
        self.number = number
        self.words, self.longer = _Numbers(), _Numbers()
        self.totals: dict[int, int] = {}
        self.bytes = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, row, text: bytes, most: int) -> None:
        ids = _word_ids(text, self.words)
        numbers, counts = np.unique(ids, return_counts=True)
        found, prefix = [(numbers, counts)], ids
        for _ in range(1, most):
            # an n-gram's own number is below 0, so that words' are not among them
            pairs = np.stack([prefix[:-1], ids[len(ids) - len(prefix) + 1 :]]) if len(prefix) else np.empty((2, 0), dtype=np.int64)
            distinct, where, counts = np.unique(pairs, axis=1, return_inverse=True, return_counts=True)
            numbers = -1 - np.fromiter(map(self.longer.__getitem__, zip(*distinct.tolist(), strict=True)), dtype=np.int64, count=distinct.shape[1])
            found.append((numbers, counts))
            prefix = numbers[where.reshape(-1)] if len(numbers) else numbers
        numbers, counts = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
        for k, n in zip(numbers.tolist(), counts.tolist(), strict=True):
            self.totals[k] = self.totals.get(k, 0) + n
        self.bytes += len(text)
        self.rows.append((doc_id, row, len(ids), int(counts.sum()), numbers.astype("<i4").tobytes(), counts.astype("<i4").tobytes()))

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        def of(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            columns["block"] = [self.number] * n
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

        names = ("doc_id", "row", "n_words", "n_features", "numbers", "counts")
        for low in range(0, len(self.rows), 1000):
            yield of(**dict(zip(names, zip(*self.rows[low : low + 1000], strict=True), strict=True)))
        words = list(self.words)
        for low in range(0, len(words), 20_000):
            some = range(low, min(low + 20_000, len(words)))
            yield of(number=list(some), word=[words[k] for k in some], n=[self.totals[k] for k in some])
        longer = list(self.longer)
        for low in range(0, len(longer), 20_000):
            some = range(low, min(low + 20_000, len(longer)))
            yield of(number=[-1 - k for k in some], parts=[self._parts(longer, k) for k in some], n=[self.totals[-1 - k] for k in some])

    def _parts(self, longer: list, k: int) -> list[int]:
        prefix, last = longer[k]
        return [*([prefix] if prefix >= 0 else self._parts(longer, -1 - prefix)), last]


_ENCODED = "target boolean, block long, doc_id long, row {row}, n_words long, n_features long, numbers binary, counts binary, number int, word binary, parts array<int>, n long"


def _encoded(texts: DataFrame, most: int, target: bool) -> DataFrame:
    """Of texts (doc_id, text, row), three kinds of rows. A document: block, doc_id, row, n_words, n_features, and the numbers and
    counts of its distinct n-grams. A word of a block: number, word, n. A longer n-gram of a block: number, parts, n."""
    kind = texts.schema["row"].dataType.simpleString()
    schema = _ENCODED.format(row=kind).removeprefix("target boolean, ")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, names = TaskContext.get().partitionId() << 33, None, None
        for batch in batches:
            names = names or pa.schema([
                ("block", pa.int64()), ("doc_id", pa.int64()), ("row", batch.schema.field("row").type), ("n_words", pa.int64()), ("n_features", pa.int64()),
                ("numbers", pa.binary()), ("counts", pa.binary()), ("number", pa.int32()), ("word", pa.binary()), ("parts", pa.list_(pa.int32())), ("n", pa.int64()),
            ])
            for doc_id, text, row in zip(*(batch.column(c) for c in ("doc_id", "text", "row")), strict=True):
                block = block or _Block(number)
                block.add(doc_id.as_py(), row.as_py(), text.as_py() or b"", most)
                if block.bytes >= BLOCK_BYTES:
                    yield from block.batches(names)
                    number, block = number + 1, None
        if block:
            yield from block.batches(names)

    return texts.mapInArrow(encode, schema).select(F.lit(target).alias("target"), "*")


def _texts(df: DataFrame, doc_id: Column, row: Column) -> DataFrame:
    return df.select(doc_id.cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), row.alias("row"))


def _longer(encoded: DataFrame, known: DataFrame, of_block: list[str]) -> DataFrame:
    """The n-grams of all blocks as tuples of their words' ids."""
    parts = encoded.where("parts IS NOT NULL").select(*of_block, "n", F.posexplode("parts").alias("at", "part"))
    parts = parts.join(known.select("target", "block", F.col("number").alias("part"), "id"), ["target", "block", "part"])
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"])
    return known.select(*of_block, "n", F.array("id").alias("ids")).unionByName(parts.groupBy(*of_block, "n").agg(in_order.alias("ids")))


def _gains(encoded: DataFrame, most: int, buckets: int) -> DataFrame:
    """block, number, gain for each n-gram of each block of the corpus."""
    of_block = ["target", "block", "number"]
    words = encoded.where("word IS NOT NULL").select(*of_block, "word", "n")
    dictionary = materialize(words.select("word").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    known = words.join(dictionary, "word").select(*of_block, "id", "n")
    tuples = _longer(encoded, materialize(known, "known"), of_block) if most > 1 else known.select(*of_block, "n", F.array("id").alias("ids"))
    tuples = materialize(tuples, "tuples")

    of = lambda target: F.sum(F.when(F.col("target") == target, F.col("n")).otherwise(0))
    distinct = materialize(tuples.groupBy("ids").agg(of(False).alias("s"), of(True).alias("t")), "distinct")
    spelled = distinct.select("ids", "s", "t", F.posexplode("ids").alias("at", "id")).join(dictionary, "id")
    blank = F.lit(" ").cast("binary")
    text = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "word"))), F.lit(None).cast("binary"), lambda acc, x: F.coalesce(F.concat(acc, blank, x["word"]), x["word"]))
    hashed = spelled.groupBy("ids", "s", "t").agg(text.alias("text")).select("ids", "s", "t", (F.crc32("text") % buckets).alias("bucket"))
    hashed = materialize(hashed, "hashed")

    counts = materialize(hashed.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")  # as many rows as buckets at most
    whole = counts.agg(F.sum("s"), F.sum("t")).first()
    s, t = (F.col(c).cast("double") + 1 for c in "st")
    all_s, all_t = (F.lit(float((x or 0) + buckets)) for x in whole)
    gain = F.floor(1000 * F.log(t * all_s / (s * all_t)))
    gains = hashed.select("ids", "bucket").join(F.broadcast(counts.select("bucket", gain.alias("gain"))), "bucket")
    return tuples.where("NOT target").join(gains, "ids").select("block", "number", "gain")


def _weighted(kind: str):
    def weigh(docs: pa.Table, gains: pa.Table) -> pa.Table:
        number, gain = gains["number"].to_numpy(), gains["gain"].to_numpy()
        order = np.argsort(number)
        number, gain = number[order], gain[order]
        weights = []
        for n, numbers, counts in zip(*(docs[c].to_pylist() for c in ("n_features", "numbers", "counts")), strict=True):
            at = np.searchsorted(number, np.frombuffer(numbers, dtype="<i4"))
            weights.append(int(gain[at] @ np.frombuffer(counts, dtype="<i4").astype(np.int64)) // n if n else 0)
        return docs.select(["doc_id", "row", "n_words", "n_features"]).append_column("weight", pa.array(weights, pa.int64()))

    return weigh, f"doc_id long, row {kind}, n_words long, n_features long, weight long"


def _noise(seed: str) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a digest of seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


@settled
def importance_ranks(
    docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024", keep: bool = False
) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_features, weight, score, rank, and with keep the row itself (row).

    Features are a text's n-grams of 1 to most words, counted as often as they come, hashed to buckets by crc32. A
    bucket's gain is the log ratio of its shares in target (text) and docs, smoothed by one, in floored thousandths.
    weight is the floored mean gain of a document's features, score adds Gumbel noise from the id. Of the documents with
    least_words words, the percent with the highest scores are drawn and ranked from 1, ties by smaller doc_id.

    Texts are read once: a task numbers the words of some megabytes of texts (a block) and writes documents as numbers
    and counts. A block's words, once each, meet the corpus's dictionary and get ids; an n-gram is a tuple of ids, and
    each distinct tuple is spelled from the dictionary and hashed once. Counts join back to it, and gains to blocks, whose
    documents then add them up. A common word is one row a block, wherever it stands, so none is hot. Ranks come
    from ranges of scores (ranks.ranked). Only two totals reach the driver.

    Null, empty and wordless texts: no features, weight 0, not drawn. A null doc_id has noise of its own, from the seed alone,
    and comes after others in ties. Repeated rows, and rows under one id, are each a document; equal ones have any order.
    No target texts: gains follow from the corpus alone. Texts of any length are whole. Empty table: no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.lit(None).cast("boolean")
    encoded = _encoded(_texts(docs, F.col("doc_id"), row), most, False)
    others = _encoded(_texts(target, F.lit(None), F.lit(None).cast("boolean")), most, True)
    encoded = materialize(encoded, "encoded")
    both = encoded.drop("row").unionByName(materialize(others, "target").drop("row"))
    gains = _gains(both, most, buckets)
    weigh, schema = _weighted(encoded.schema["row"].dataType.simpleString())
    rows = encoded.where("numbers IS NOT NULL").select("block", "doc_id", "row", "n_words", "n_features", "numbers", "counts")
    scored = rows.groupBy("block").cogroup(gains.groupBy("block")).applyInArrow(weigh, schema)
    # a number for each row, written with it
    scored = materialize(scored.withColumn("score", F.col("weight") + _noise(seed)).withColumn("number", F.monotonically_increasing_id()), "scored")
    enough = F.col("n_words") >= least_words
    placed = ranked(scored.where(enough), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("number")])
    drawn = F.when(F.col("rank") < F.floor(percent * F.col("n") / 100), F.col("rank") + 1)
    out = placed.withColumn("rank", drawn).drop("n").unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank", *["row"] * keep)


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that importance_ranks draws, with all their columns."""
    return importance_ranks(docs, target, keep=True, **options).where("rank IS NOT NULL").select("row.*")


ORACLE_SQL = r"""
    WITH crc AS (
        SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), i)) AS t),
    texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark),
    words AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
    counted AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM words GROUP BY ALL),
    spelled AS (
        SELECT word, hex(encode(word)) AS h, list_transform(range(len(hex(encode(word))) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b
        FROM (SELECT DISTINCT word FROM counted)),
    hashed AS MATERIALIZED (
        SELECT word, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM spelled, crc),
    buckets AS (
        SELECT bucket, coalesce(sum(n) FILTER (doc_id IS NOT NULL), 0) AS s, coalesce(sum(n) FILTER (doc_id IS NULL), 0) AS t
        FROM counted JOIN hashed USING (word) GROUP BY bucket),
    gains AS (
        SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM buckets),
    sums AS (
        SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight
        FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE doc_id IS NOT NULL GROUP BY doc_id),
    scored AS (
        SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
        FROM documents LEFT JOIN sums USING (doc_id)),
    placed AS (
        SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
    SELECT scored.doc_id, n_features, weight, score, rank FROM scored LEFT JOIN (SELECT * FROM placed WHERE rank <= 10 * n // 100) p USING (doc_id)"""
