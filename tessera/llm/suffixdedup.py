"""Removing passages that occur more than once, byte for byte, anywhere in a corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import PrefixHasher, splitmix
from .scratch import materialize, settled
from .suffixsort import sort_rows

PASSAGE = 200  # bytes
GRAM = 32  # bytes of an anchor
BLOCK = 1 << 18  # bytes hashed together, about
HOT = 20_000  # an anchor with more different surroundings is counted passage by passage, in all tasks
SORTED = 4_000  # runs sorted together, about
TASK_RUNS = 50_000
SLICES = 1 << 22  # bytes of slices, or passages times their length, in one batch

_U = np.uint64
_MASK = _U((1 << 24) - 1)
_HASHER = PrefixHasher(21)
_RUN = "anchor long, run_a long, run_b long, doc_id long, text_hash long, start long, n int, lead int"


def find_runs(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of passage starts with one anchor: first and last start, the anchor's place, its hash,
    and a digest of all bytes that the run's passages cover, in two halves.

    A passage's anchor is the least-hashed of its GRAM-byte substrings, the leftmost of equals, so
    equal passages have equal anchors at equal places; about one position in 85 is an anchor.
    owner: the document of each byte, for passages must not cross documents.
    """
    n = len(data) - PASSAGE + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, none
    grams = splitmix(_HASHER.windows(_HASHER.prefixes(data), GRAM))
    least = (grams & ~_MASK) | np.arange(len(grams), dtype=_U)
    span, reach = PASSAGE - GRAM + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: reach - span], least[span - reach :])
    anchor = (least & _MASK).astype(np.int64)
    doc = owner[:n]
    valid = doc == owner[PASSAGE - 1 :]
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change - 1, [n - 1]])
    real = valid[first]
    first, last = first[real], last[real]
    at = anchor[first]
    one, two = digests(data.tobytes(), first, last + PASSAGE)
    return first, last, at, grams[at].view(np.int64), one, two


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b of each [start, end), 128 bits in two halves. Polynomial hashes would do for chance, but
    some texts are made so that these collide; equality that no bytes confirm rests on a digest."""
    joined = b"".join(hashlib.blake2b(data[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True))
    halves = np.frombuffer(joined, dtype=np.int64).reshape(-1, 2)
    return np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def _blocks(rows: Iterator[tuple]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Documents joined to blocks of about BLOCK bytes; longer ones are cut, each part beginning
    PASSAGE - 1 bytes before the last one's end. Yields (row, offset) of each part, bytes, owner."""
    parts, size = [], 0
    for row, raw in rows:
        for at in range(0, max(1, len(raw) - PASSAGE + 1), BLOCK):
            piece = raw[at : at + BLOCK + PASSAGE - 1]
            parts.append((row, at, piece))
            size += len(piece)
            if size >= BLOCK:
                yield _joined(parts)
                parts, size = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts):
    data = np.frombuffer(b"".join(p for *_, p in parts), dtype=np.uint8)
    return [(row, at) for row, at, _ in parts], data, np.repeat(np.arange(len(parts)), [len(p) for *_, p in parts])


def _document_runs(rows: DataFrame) -> DataFrame:
    """All runs of rows (doc_id, text_hash, raw)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch[0], batch[1]
            raws = ((i, x.as_py()) for i, x in enumerate(batch[2]))
            for parts, data, owner in _blocks((i, raw) for i, raw in raws if raw is not None and len(raw) >= PASSAGE):
                first, last, at, anchor, one, two = find_runs(data, owner)
                part = owner[first]
                begin = np.searchsorted(owner, np.arange(len(parts)))
                row = pa.array(np.array([r for r, _ in parts])[part])
                start = first - begin[part] + np.array([o for _, o in parts])[part]
                arrays = [pa.array(anchor), pa.array(one), pa.array(two), ids.take(row), hashes.take(row), pa.array(start)]
                arrays += [pa.array((last - first + 1).astype(np.int32)), pa.array((at - first).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["anchor", "run_a", "run_b", "doc_id", "text_hash", "start", "n", "lead"])

    return rows.mapInArrow(runs, _RUN)


def _slices(rows: DataFrame) -> DataFrame:
    """The bytes that each run covers; rows: doc_id, text_hash, raw and runs (anchor, kinds, start, n,
    lead), so a text comes once, however many runs it has. Equal rows that follow each other are cut once."""
    names = ["anchor", "kinds", "doc_id", "text_hash", "start", "n", "lead"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for k in range(batch.num_rows):
                ids = [batch.column(c)[k].as_py() for c in ("doc_id", "text_hash")]
                if ids == before:
                    continue
                before = ids
                raw, runs = batch.column("raw")[k].as_py(), batch.column("runs")[k].values
                starts, counts = (runs.field(c).to_numpy() for c in ("start", "n"))
                ends = starts + counts + PASSAGE - 1
                parts = np.flatnonzero(np.diff(np.cumsum(ends - starts) // SLICES)) + 1
                for low, high in zip([0, *parts.tolist()], [*parts.tolist(), len(starts)], strict=True):
                    columns = {c: runs.field(c).slice(low, high - low) for c in ("anchor", "kinds", "start", "n", "lead")}
                    columns |= {c: pa.array([i] * (high - low), pa.int64()) for c, i in zip(("doc_id", "text_hash"), ids, strict=True)}
                    out = [raw[s:e] for s, e in zip(starts[low:high].tolist(), ends[low:high].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(columns[c] for c in names), pa.array(out, pa.binary())], [*names, "bytes"])

    return rows.mapInArrow(cut, "anchor long, kinds long, doc_id long, text_hash long, start long, n int, lead int, bytes binary")


def repeated_starts(anchor: np.ndarray, lead: np.ndarray, count: np.ndarray, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which passages of these runs occur in another of them: run numbers, and starts within the run.
    The runs of an anchor stand together.

    The suffixes at the anchors are sorted, and so are the reversed prefixes before them. Passages
    that begin d bytes before the anchor are equal if and only if their runs agree in d bytes to
    the left and in PASSAGE - d to the right, that is, fall into one class of both orders, where
    classes are cut at neighbours with a shorter common extension.
    """
    m = len(raws)
    edge = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    group = np.cumsum(edge) - 1
    begins = np.flatnonzero(edge)
    ends = np.concatenate([begins[1:], [m]])
    group_start, group_end = begins[group], ends[group]
    total = count.astype(np.int64) + PASSAGE - 1
    lead = lead.astype(np.int64)
    flat = np.frombuffer(b"".join(raws), dtype=np.uint8)
    base = np.concatenate([[0], np.cumsum(total)[:-1]])

    def side(lengths: np.ndarray, origin: np.ndarray, step: int):
        width = np.arange(int(lengths.max()) if m else 0)
        inside = width[None, :] < lengths[:, None]
        rows = np.where(inside, flat[np.where(inside, origin[:, None] + step * width[None, :], 0)], 0).astype(np.uint8)
        return sort_rows(rows, lengths, group_start, group_end)

    right, right_common = side(total - lead, base + lead, 1)
    left, left_common = side(lead, base + lead - 1, -1)
    first_right, first_left = edge, edge  # groups keep their places in both orders
    found_run, found_start = [], []
    for d in range(PASSAGE - GRAM + 1):
        active = np.flatnonzero((lead >= d) & (d > lead - count))
        if len(active) < 2:
            continue
        x, y = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
        x[left] = np.cumsum(first_left | (left_common < d))
        y[right] = np.cumsum(first_right | (right_common < PASSAGE - d))
        _, which, n = np.unique(x[active] * (m + 1) + y[active], return_inverse=True, return_counts=True)
        hit = active[n[which] > 1]
        found_run.append(hit)
        found_start.append(lead[hit] - d)
    if not found_run:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found_run), np.concatenate(found_start)


def _spans(run: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts: run number, first start, how many."""
    order = np.lexsort((start, run))
    run, start = run[order], start[order]
    cut = np.flatnonzero((run[1:] != run[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first = np.concatenate([[0], cut]).astype(np.int64)
    return run[first], start[first], np.diff(np.concatenate([first, [len(run)]]))


def _sorted_out(rows: DataFrame) -> DataFrame:
    """Repeated passages among runs that share an anchor: doc_id, text_hash, start, n."""
    names = ["doc_id", "text_hash", "start", "n"]

    def settle(table: pa.Table) -> pa.RecordBatch:
        anchor, lead, count = (table[c].to_numpy() for c in ("anchor", "lead", "n"))
        run, start = repeated_starts(anchor, lead, count, table["bytes"].to_pylist())
        if len(run):
            run, start, n = _spans(run, start)
        else:
            n = run
        arrays = [pa.array(table[c].to_numpy()[run] if table[c].null_count == 0 else np.array(table[c].to_pylist(), dtype=object)[run], pa.int64()) for c in names[:2]]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(table["start"].to_numpy()[run] + start, pa.int64()), pa.array(n, pa.int64())], names)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SORTED:
                table = pa.Table.from_batches(held)
                anchor = table["anchor"].to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
                low = 0
                while low < cut:
                    high = min(cut, low + SORTED)
                    high = int(np.searchsorted(anchor, anchor[high - 1], side="right"))
                    yield settle(table.slice(low, high - low).combine_chunks())
                    low = high
                held = table.slice(cut).combine_chunks().to_batches()
                size = len(table) - cut
        if size:
            yield settle(pa.Table.from_batches(held))

    return rows.mapInArrow(sort, ", ".join(f"{n} long" for n in names))


def _counted_out(rows: DataFrame) -> DataFrame:
    """The same for anchors with very many runs, whose passages are counted one by one by a digest of
    their bytes: such a group is spread over all tasks."""
    names = ["hash_a", "hash_b", "doc_id", "text_hash", "start"]

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, SLICES // (PASSAGE * PASSAGE))
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                n = part.column("n").to_numpy()
                halves = [digests(raw, np.arange(k), np.arange(k) + PASSAGE) for raw, k in zip(part.column("bytes").to_pylist(), n.tolist(), strict=True)]
                row = pa.array(np.repeat(np.arange(len(n)), n))
                within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = pa.array(np.repeat(part.column("start").to_numpy(), n) + within)
                ids = [part.column(c).take(row) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in zip(*halves, strict=True)), *ids, start], names)

    every = materialize(rows.mapInArrow(passages, ", ".join(f"{n} long" for n in names)), "passages")
    twice = every.groupBy("hash_a", "hash_b").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    return every.join(twice, ["hash_a", "hash_b"], "left_semi").select("doc_id", "text_hash", "start", F.lit(1).cast("long").alias("n"))


def repeated_passages(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, text_hash, start, n: from start, n passages in a row of PASSAGE bytes each occur
    elsewhere too. See remove_repeats. docs: doc_id, text_hash, raw (bytes)."""
    runs = _document_runs(docs)
    key = ["anchor", "run_a", "run_b"]
    # the first row's columns: one occurrence, whichever, and no sort as a minimum of structs would need
    one = [F.first(c).alias(c) for c in ("doc_id", "text_hash", "start", "n", "lead")]
    distinct = runs.groupBy(*key).agg(F.count("*").alias("times"), *one)
    kinds = distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    known = distinct.join(kinds, "anchor", "left").where("times > 1 OR kinds > 1")
    known = materialize(known, "runs")

    whole = runs.join(known.where("times > 1").select(*key), key, "left_semi").select("doc_id", "text_hash", "start", F.col("n").cast("long").alias("n"))
    whole = materialize(whole, "whole")

    partly = known.where("kinds > 1")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), partly.count() // TASK_RUNS + 1)
    # one row a document, whose runs are bounded by its own length
    partly = partly.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "kinds", "start", "n", "lead")).alias("runs"))
    same = partly.doc_id.eqNullSafe(docs.doc_id) & (partly.text_hash == docs.text_hash)
    rows = _slices(docs.join(partly, same).select(docs.doc_id, docs.text_hash, docs.raw, "runs"))
    few, many = F.col("kinds") <= hot, F.col("kinds") > hot
    some_hot = known.where(many).limit(1).count() > 0
    if some_hot:
        rows = materialize(rows, "slices")
    found = whole.unionByName(materialize(_sorted_out(rows.where(few).repartition(tasks, "anchor").sortWithinPartitions("anchor")), "settled"))
    if some_hot:
        found = found.unionByName(materialize(_counted_out(rows.where(many)), "counted"))
    return found


@settled
def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """A row for each row of docs (doc_id, text; other columns are ignored): doc_id, n_bytes,
    n_removed, n_spans, kept_sha256, after removing every byte of the UTF-8 text that is covered by a
    string of PASSAGE bytes which also starts anywhere else, the same document included.

    Exact. Every passage has an anchor (find_runs); passages in a row with one anchor are a run, about
    one for 85 bytes. Runs are fingerprinted with 128 bits: one that occurs twice is repeated from
    end to end, which settles the inside of every long copy without its bytes. What is left are runs
    at the edges of copies: those whose anchor has other surroundings too. Each document cuts their
    bytes from its one text, they are brought together by anchor, and a suffix sort by hashed prefixes
    (suffixsort) finds how far they agree to either side, verified byte by byte. An anchor with more
    than hot different surroundings is not sorted in one task but counted passage by passage. Digests
    are of BLAKE2b, so equal ones stand for equal bytes.

    Null and empty texts have 0 bytes. Repeated rows are copies of each other, with one id or several;
    null ids are like any. No length of text is special. Empty table: no rows.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(raw).alias("text_hash"), raw.alias("raw"))
    found = repeated_passages(rows, hot)
    # a start and its count (at most PASSAGE) as one number; a set, for rows that are alike in id and text find the same
    spans = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.col("start") * 256 + F.col("n")).alias("found"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                data = batch[1][k].as_py()
                removed, n, digest = 0, 0, hashlib.sha256()
                at = 0
                if batch[2][k].is_valid:
                    pairs = np.sort(batch[2][k].values.to_numpy())
                    starts = pairs >> 8
                    ends = np.maximum.accumulate(starts + (pairs & 255) + PASSAGE - 1)
                    cut = np.flatnonzero(starts[1:] > ends[:-1])
                    for s, e in zip(starts[np.concatenate([[0], cut + 1])].tolist(), ends[np.concatenate([cut, [len(ends) - 1]])].tolist(), strict=True):
                        digest.update(data[at:s])
                        at, removed, n = e, removed + e - s, n + 1
                digest.update(data[at:])
                out.append((len(data), removed, n, digest.hexdigest()))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            arrays = [batch[0], *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    same = rows.doc_id.eqNullSafe(spans.doc_id) & (rows.text_hash == spans.text_hash)
    joined = rows.join(spans, same, "left").select(rows.doc_id, rows.raw, spans.found)
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE_SQL = """
    WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
    w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM b WHERE n >= 200)),
    twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
    starts AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w SEMI JOIN twice USING (k)),
    numbered AS (SELECT *, sum(CASE WHEN i <= p + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM starts),
    spans AS (SELECT doc_id, s, min(i) AS a, max(i) + 200 AS e FROM numbered GROUP BY doc_id, s),
    gaps AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS z FROM spans),
    kept AS (
        SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS z,
               string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY s) AS k
        FROM gaps JOIN b USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
    FROM b LEFT JOIN kept USING (doc_id)"""
