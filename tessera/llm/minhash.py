"""Near duplicates among texts: one-permutation MinHash, banded buckets, star-shaped candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import splitmix
from .scratch import materialize, packed, settled

ROWS, BANDS = 5, 38  # a pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**38 = 2.8e-7
BINS = ROWS * BANDS
PAIRS = 5_000  # a unit of more pairs is compared whole, in blocks
BLOCK_SHINGLES = 2_000_000  # of a group that is compared in one task, about
SKETCH_SIGMAS = 6  # a pair at the threshold has fewer equal sketch bits with probability 1e-9

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SALTS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))  # of two independent hashes
_FACTORS = (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F))
_LANES = 4  # of 8 bytes; longer words are hashed by BLAKE2b
_BLOCK = 1 << 20


def word_hashes(text: str | None) -> np.ndarray:
    """Two hashes for each word [^\\x20\\x09-\\x0D]+ of the text, A-Z lower-cased: an array [2, words].

    Words are mixed 8 bytes at a time, so no arithmetic relation between words carries over to hashes."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    every = np.frombuffer(data, dtype=np.uint8)
    found = [np.zeros((2, 0), dtype=_U)]
    at = 0
    while at < len(data):  # blocks end at white space, so memory doesn't grow with the text
        end = min(len(data), at + _BLOCK)
        while end < len(data) and not _SPACE[every[end]]:
            end += 1
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[every[at:end]], [True]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        sizes = ends - starts
        eights = np.ndarray((end - at,), dtype="<u8", buffer=data[at:end] + bytes(8), strides=(1,))
        h = np.stack([splitmix(sizes.astype(_U) + salt) for salt in _SALTS])
        for k in range(_LANES):
            longer = np.flatnonzero(sizes > 8 * k)
            lane = eights[starts[longer] + 8 * k]
            rest = np.minimum(sizes[longer] - 8 * k, 8).astype(_U)
            lane &= ~_U(0) >> (_U(64) - _U(8) * rest)
            for row, salt in zip(h, _SALTS, strict=True):
                row[longer] = splitmix((row[longer] ^ lane) + salt)
        for w in np.flatnonzero(sizes > 8 * _LANES).tolist():
            digest = hashlib.blake2b(data[at + starts[w] : at + ends[w]], digest_size=16).digest()
            h[:, w] = np.frombuffer(digest, dtype=_U)
        found.append(h)
        at = end
    return np.concatenate(found, axis=1)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Two hashes for each distinct run of so many words of the text, sorted by the first: [2, runs];
    fewer words: one run of all. Sets are compared by both, 128 bits."""
    w = word_hashes(text)
    n = w.shape[1]
    if not n:
        return w
    k = min(words, n)
    h = np.full((2, n - k + 1), k, dtype=_U)
    for row, of, factor in zip(h, w, _FACTORS, strict=True):
        for j in range(k):
            row *= factor
            row += of[j : n - k + 1 + j]
    first, at = np.unique(splitmix(h[0]), return_index=True)
    return np.stack([first, splitmix(h[1, at])])


class _Signer:
    """Signatures of sets of hashes."""

    def __init__(self):
        rng = np.random.default_rng(20240229)
        # the order in which an empty bin looks for one to copy: independent of the other bins' orders
        self.order = np.argsort(rng.random((BINS, BINS)), axis=1)

    def bins(self, hashes: np.ndarray) -> np.ndarray:
        """The least hash in each of BINS equal ranges; an empty bin copies the first full one
        in its own random order (optimal densification)."""
        at = (((hashes >> _U(32)) * _U(BINS)) >> _U(32)).astype(np.intp)
        full, first = np.unique(at, return_index=True)
        out = np.zeros(BINS, dtype=_U)
        out[full] = hashes[first]
        if len(full) < BINS:
            has = np.zeros(BINS, dtype=bool)
            has[full] = True
            empty = np.flatnonzero(~has)
            order = self.order[empty]
            out[empty] = out[order[np.arange(len(empty)), has[order].argmax(axis=1)]]
        return out

    def sign(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys, and a sketch of one bit for each bin in whole 64-bit words."""
        sig = splitmix(self.bins(hashes) + np.arange(BINS, dtype=_U))
        h = np.arange(BANDS, dtype=_U) + _U(1)
        for column in sig.reshape(BANDS, ROWS).T:
            h = h * _U(0xD6E8FEB86659FD93) + column
        bits = np.zeros(-(-BINS // 64) * 64, dtype=np.uint8)
        bits[:BINS] = (sig >> _U(17)) & _U(1)
        return splitmix(h).view(np.int64), np.packbits(bits).view(np.int64)


_KEY = ["doc_id", "t_a", "t_b"]  # of a row: its id and its text's hash, for ids need not be unique
_SIGNED = "doc_id long, t_a long, t_b long, n_shingles long, set_a long, set_b long, s0 long, s1 long, s2 long, bands array<long>"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(text), text.alias("text"))


def text_key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), text).alias("t_a"), F.xxhash64(F.lit(2), text).alias("t_b")


def _same_row(x: DataFrame, y: DataFrame) -> Column:
    return x.doc_id.eqNullSafe(y.doc_id) & (x.t_a == y.t_a) & (x.t_b == y.t_b)


def _signatures(texts: DataFrame, words: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer()
        for batch in batches:
            rows = []
            for text in batch[3]:
                hashes = shingle_hashes(text.as_py(), words)
                if hashes.shape[1]:
                    bands, sketch = signer.sign(hashes[0])
                    a, b = np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), dtype=np.int64)
                    rows.append((hashes.shape[1], int(a), int(b), *sketch.tolist(), bands.tolist()))
                else:
                    rows.append((0, None, None, None, None, None, None))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 6 + [pa.list_(pa.int64())]
            arrays = [*batch.columns[:3], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _SIGNED.split(", ")])

    return texts.mapInArrow(sign, _SIGNED)


def _sketch_bound(similarity: float) -> int:
    """Equal bits of BINS that a pair at the threshold has, less SKETCH_SIGMAS deviations."""
    p = (1 + similarity) / 2
    return int(BINS * p - SKETCH_SIGMAS * (BINS * p * (1 - p)) ** 0.5)


def _plausible(x: str, y: str, similarity: float):
    """A condition on two rows with n_shingles and sketches: the pair can reach the threshold."""
    differ = sum(F.bit_count(F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))) for k in range(3))
    n, m = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * int(similarity * 100)
    return sizes & (differ <= BINS - _sketch_bound(similarity))


def _blocks(shingles: Column) -> Column:
    return F.ceil(shingles / BLOCK_SHINGLES)


def _block(node: str, shingles: Column) -> Column:
    return F.pmod(F.xxhash64(node), _blocks(shingles))


_GROUP = ["unit", "i", "j", "node", "component", "outside"]


def _star_groups(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Groups in which each node b of pairs (a, b) is held against its a: the nodes b of one a are dealt to
    blocks of bounded size, each with a once."""
    sized = pairs.join(nodes.select(F.col("node").alias("b"), "n_shingles"), "b")
    blocks = sized.groupBy("a").agg(_blocks(F.sum("n_shingles")).alias("blocks"))
    every = blocks.select(F.col("a").alias("unit"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"), "a", F.lit(False).alias("outside"))
    members = pairs.join(blocks, "a").select(F.col("a").alias("unit"), F.pmod(F.xxhash64("b"), F.col("blocks")).alias("i"), F.col("b").alias("a"), F.lit(True).alias("outside"))
    return every.unionByName(members).select("unit", "i", F.lit(-1).cast("long").alias("j"), F.col("a").alias("node"), F.col("a").alias("component"), "outside")


def _unit_groups(units: DataFrame, large: DataFrame) -> DataFrame:
    """Groups in which the nodes of large units that are outside the unit's component are held against all:
    all nodes are dealt to blocks (i), those outside to blocks of their own (j), and every pair of one block of each kind is a
    group, so a group's size has a bound (a single text aside) and a hot unit becomes many groups. A text goes to as many
    groups as there are blocks of the other kind: where few are outside, all others go to one."""
    dealt = units.join(large, "unit")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), _blocks(F.col(c)) - 1))
    columns = ["unit", "node", "component"]
    every = dealt.select(*columns, F.lit(False).alias("outside"), _block("node", F.col("n_all")).alias("i"), upto("n_out").alias("j"))
    outside = dealt.where("component != unit").select(*columns, F.lit(True).alias("outside"), upto("n_all").alias("i"), _block("node", F.col("n_out")).alias("j"))
    return every.unionByName(outside).select(*_GROUP)


def _unit_pairs(units: DataFrame, small: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of small units that can be links: one node outside the unit's component."""
    few = units.join(small.select("unit"), "unit")
    return (
        few.where("component != unit")
        .alias("x")
        .join(
            few.alias("y"),
            (F.col("x.unit") == F.col("y.unit"))
            & (F.col("x.component") != F.col("y.component"))
            & ((F.col("y.component") == F.col("y.unit")) | (F.col("x.node") < F.col("y.node")))
            & _plausible("x", "y", similarity),
        )
        .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
        .distinct()
    )


class _Sets:
    """The shingle sets of some nodes, searched for those that are similar to another set; and which of
    the components that they are of have been joined by what was found."""

    def __init__(self):
        self.nodes, self.components, self.sets, self.index = [], [], [], None

    def add(self, node, component, hashes: np.ndarray) -> None:
        self.nodes.append(node)
        self.components.append(component)
        self.sets.append(hashes)

    def _indexed(self) -> tuple:
        if self.index is None:
            hashes = np.concatenate(self.sets, axis=1)
            owner = np.repeat(np.arange(len(self.sets)), [x.shape[1] for x in self.sets])
            order = np.argsort(hashes[0], kind="stable")
            self.index = hashes[:, order], owner[order], np.array([x.shape[1] for x in self.sets])
            self.sets = []
            distinct, self.label = np.unique(self.components, return_inverse=True)  # of each node, the label of what is joined
            self.of = {c: k for k, c in enumerate(distinct.tolist())}  # and of each component
            self.members = {k: [c] for c, k in self.of.items()}
        return self.index

    def join(self, own: np.ndarray, component, percent: int) -> list[int]:
        """Numbers of nodes whose sets reach the similarity, one for each component, or components joined so far, that this
        joins with the given one. So a group finds no more links than it has components."""
        if not self.nodes:
            return []
        hashes, owner, sizes = self._indexed()
        low, high = np.searchsorted(hashes[0], own[0], "left"), np.searchsorted(hashes[0], own[0], "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = at[hashes[1, at] == np.repeat(own[1], n)]
        both = np.bincount(owner[at], minlength=len(sizes))
        mine = self.of.get(component, -1)
        hits = np.flatnonzero((both > 0) & (100 * both >= percent * (sizes + own.shape[1] - both)) & (self.label != mine))
        if not len(hits):
            return []
        labels, first = np.unique(self.label[hits], return_index=True)
        if mine < 0:
            mine = self.of[component] = len(self.of)
            self.members[mine] = [component]
        for label in labels.tolist():
            for c in self.members[label]:
                self.of[c] = mine
            self.members[mine] += self.members.pop(label)
        self.label[np.isin(self.label, labels)] = mine
        return hits[first].tolist()


def _links(groups: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) between nodes outside (a) and not outside (b) of a group, of different components: those
    that connect within the group what is connected there. Confirmed on the full sets. Each group's rows follow each
    other, those outside first, so a task holds one group's sets and returns links alone."""
    percent = round(similarity * 100)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, before, sets = None, None, _Sets()
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in _GROUP]
            for k, (unit, i, j, node, component, outside) in enumerate(zip(*columns, strict=True)):
                if (unit, i, j) != group:
                    group, before, sets = (unit, i, j), None, _Sets()
                if (node, outside) == before:  # rows that are alike in id and text
                    continue
                before = node, outside
                own = shingle_hashes(batch.column("text")[k].as_py(), words)
                if outside:
                    sets.add(node, component, own)
                    continue
                out += [(sets.nodes[at], node) for at in sets.join(own, component, percent)]
            pairs = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in pairs], ["a", "b"])

    wanted = groups.join(nodes.select("node", *_KEY), "node")
    rows = wanted.join(texts, _same_row(wanted, texts)).select(*[wanted[c] for c in _GROUP], texts.text)
    rows = rows.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", F.desc("outside"), "node")
    return rows.mapInArrow(link, "a long, b long")


def assign_groups(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """For each row of docs: doc_id, t_a, t_b (text_key), n_shingles, and, for texts with words, component_id
    (smallest doc_id that links reach) and first (doc_id and text key of the row that stands for the group:
    the one with the smallest id, nulls last, then the smallest key). See near_duplicates."""
    texts = _keyed(docs)
    signed = materialize(_signatures(texts, words), "signatures")
    full = signed.where("n_shingles > 0")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), *_KEY, "n_shingles", "s0", "s1", "s2", "bands")
    classes = full.groupBy("set_a", "set_b").agg(F.min(row).alias("r"))
    # a class's number; written with it, so it stays
    nodes = materialize(classes.select("set_a", "set_b", "r.*", F.monotonically_increasing_id().alias("node")), "nodes")
    sketches = nodes.select("node", "n_shingles", "s0", "s1", "s2")

    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1")
    members = materialize(banded.join(shared.drop("n"), "band"), "members")
    star = members.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    star = (
        star.join(sketches.alias("x"), F.col("a") == F.col("x.node"))
        .join(sketches.alias("y"), F.col("b") == F.col("y.node"))
        .where(_plausible("x", "y", similarity))
        .select("a", "b")
    )
    star = materialize(star, "star")
    links = materialize(_links(_star_groups(star, nodes), nodes, texts, words, similarity), "links")
    first = materialize(connected_components(links), "components")

    of = members.join(first, "node", "left").withColumn("component", F.coalesce("component", "node")).select("band", "node", "component")
    mixed = (
        of.groupBy("band")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("component", "node").alias("main"))
        .where("lo != hi")
        .select("band", "main")
    )
    of = of.join(mixed, "band").select(F.col("main").alias("unit"), "node", "component").distinct()
    units = materialize(of.join(sketches, "node"), "units")
    rest = F.col("component") != F.col("unit")
    sizes = units.groupBy("unit").agg(F.count("*").alias("n"), F.sum(rest.cast("long")).alias("n_rest"), F.sum("n_shingles").alias("n_all"), F.sum(F.when(rest, F.col("n_shingles"))).alias("n_out"))
    small = F.col("n").cast("double") * F.col("n_rest") <= PAIRS
    pairs = _unit_pairs(units, sizes.where(small), similarity).join(star, ["a", "b"], "left_anti")
    groups = _star_groups(materialize(pairs, "pairs"), nodes).unionByName(_unit_groups(units, sizes.where(~small)))
    more = materialize(_links(groups, nodes, texts, words, similarity), "links")
    reach = connected_components(links.unionByName(more))

    numbered = nodes.join(reach, "node", "left").withColumn("component", F.coalesce("component", "node"))
    numbered = materialize(numbered.select("set_a", "set_b", "component", F.struct("no_id", *_KEY).alias("first")), "numbered")
    least = numbered.groupBy("component").agg(F.min("first").alias("first"))
    known = numbered.drop("first").join(least, "component").drop("component")
    return signed.select(*_KEY, "n_shingles", "set_a", "set_b").join(known, ["set_a", "set_b"], "left").select(
        *_KEY, "n_shingles", F.col("first.doc_id").alias("component_id"), F.when(F.col("first").isNotNull(), F.struct(*[f"first.{c}" for c in _KEY])).alias("first")
    )


@settled
def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; others ignored).

    Documents are linked if their sets of word shingles have that Jaccard similarity, confirmed
    on the full sets; component_id is the smallest doc_id that links reach, kept whether that is the row's.

    Equal sets are one node from the start, so copies cost one row each. A signature of BINS
    one-permutation minima with optimal densification is cut into BANDS keys. In each bucket, every
    node is paired with the bucket's first only (a star). That leaves buckets whose nodes are not
    all linked. Those with the same component at their centre form a unit, in which each node outside
    that component is held against all nodes of other components, so the star loses no link, and
    pairs within a component, which could not change the result, are never made. A unit of few pairs
    makes them; sizes and one-bit sketches rule out most before any text is joined. In a larger one,
    and in stars, blocks of bounded size meet in tasks that count common shingles and return links alone.

    No words (null, empty, white space): n_shingles 0, linked with nothing, its own component. Repeated
    rows get equal results, one row each. Rows that share an id but not the text are documents of their
    own. A null doc_id links like any but names no component: component_id is null and kept true where
    all ids of the group are null, kept false where one isn't. Empty table: no rows.
    """
    found = assign_groups(docs, words, similarity)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


@settled
def decisions(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, t_a, t_b and stays, for the documents that go and for those of which there are equal rows."""
    found = assign_groups(docs, words, similarity).where("n_shingles > 0")
    is_first = F.col("first").eqNullSafe(F.struct(*_KEY))
    return found.groupBy(*_KEY).agg(F.count("*").alias("n"), F.bool_or(is_first).alias("stays")).where("NOT stays OR n > 1").drop("n")


def keep_distinct(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, without near duplicates: one row of each group stays, the one with
    the smallest doc_id (nulls last; of several texts under one id, any one of them, always the same), and
    of rows alike in id and text one, whichever. Rows without words are linked with nothing and all stay.
    Decisions are carried by id and text, so a text whose id also stands on another's copy is judged on
    its own. Empty table: no rows."""
    marked = decisions(docs, words, similarity)
    rows = packed(docs).withColumns(dict(zip(_KEY, (F.col("row.doc_id").cast("long"), *text_key(F.col("row.text").cast("string"))), strict=True)))
    looked = rows.join(marked, _same_row(rows, marked), "left").select(*[rows[c] for c in _KEY], "row", "stays")
    once = looked.where("stays IS NULL").select("row.*")
    several = looked.where("stays").groupBy(*_KEY).agg(F.first("row").alias("row")).select("row.*")
    return once.unionByName(several)
