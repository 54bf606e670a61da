"""A Merkle manifest of a table: a digest for each row, a tree of them for each source, one root, and proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import RDD
from pyspark.rdd import portable_hash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .scratch import materialize, settled

# The columns of a leaf, in order, and how many nodes have one parent.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3

LEVELS = 8  # that one shuffle of nodes climbs: a block has ARITY ** LEVELS nodes at most
PART_NODES = 50_000  # of a task, about

#: What leads from a node to a root: for each level, the node's place among its parent's children, and the others.
PATH = "array<struct<slot: int, siblings: array<string>>>"
_CLIMBED = f"tree long, n long, idx long, top long, digest string, path {PATH}"


def digest_of(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(text: Column | None = None) -> Column:
    """The digest of a row's COLUMNS, with another text if given: each is its length in bytes, a colon
    and its value, or - for null."""
    values = [text if c == "text" and text is not None else F.col(c) for c in COLUMNS]
    values = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def _count(n: int, level: int) -> int:
    """Nodes at a level of a tree of n leaves."""
    return -(-n // ARITY**level)


def _begin(child: tuple[int, str]) -> dict[int, str]:
    return dict([child])


def _add(partial: dict[int, str], child: tuple[int, str]) -> dict[int, str]:
    partial[child[0]] = child[1]
    return partial


def _merge(partial: dict[int, str], other: dict[int, str]) -> dict[int, str]:
    partial.update(other)
    return partial


def _resolve(partials: Iterable[tuple[tuple, dict[int, str]]], cap: int, paths: bool) -> Iterator[tuple]:
    """From partial parents by key (tree, n, level, idx): the ancestors that no parent within cap has (with a
    digest), and if wanted the nodes below the partial parents (with a path to such an ancestor).

    A partial parent whose children are all there, as many as the tree's size tells, becomes a digest,
    which is a child for the next one; the runs of digests that made one lead back down to its children.
    """
    pending = dict(partials)
    full = lambda key, partial: len(partial) == min(ARITY, _count(key[1], key[2] - 1) - ARITY * key[3])
    ready = [key for key, partial in pending.items() if full(key, partial)]
    base = min((key[2] for key in pending), default=0)
    runs, above = [], {}
    while ready:
        key = ready.pop()
        tree, n, level, idx = key
        partial = pending.pop(key)
        run = [partial[slot] for slot in range(len(partial))]
        digest = digest_of(run)
        if paths:
            runs.append((key, run))
        if level == cap or _count(n, level) == 1:
            above[key] = (), idx
            yield tree, n, idx, None, digest, None
            continue
        parent = tree, n, level + 1, idx // ARITY
        partial = pending.setdefault(parent, {})
        partial[idx % ARITY] = digest
        if full(parent, partial):
            ready.append(parent)
    if pending:
        raise ValueError(f"nodes are missing or have come twice: {next(iter(pending))}")
    for (tree, n, level, idx), run in reversed(runs):  # a parent comes before its children
        path, top = above.pop((tree, n, level, idx))
        for slot in range(len(run)):
            step = ((slot, run[:slot] + run[slot + 1 :]), *path)
            if level == base:
                yield tree, n, ARITY * idx + slot, top, None, list(step)
            else:
                above[tree, n, level - 1, ARITY * idx + slot] = step, top


def _climb(nodes: DataFrame, base: int, paths: bool, rows: int) -> DataFrame:
    """What _resolve makes of nodes (tree, n, idx, digest), all at level base, as a table. All below one node at the next
    multiple of LEVELS meet in one task, so each climbs as far, and no task gets more for a larger tree."""
    cap = base + LEVELS
    spark = nodes.sparkSession
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 2000)
    children = nodes.select("tree", "n", "idx", "digest").rdd.map(lambda r: ((r[0], r[1], base + 1, r[2] // ARITY), (r[2] % ARITY, r[3])))
    partials: RDD = children.combineByKey(
        _begin, _add, _merge, max(1, few, -(-rows // PART_NODES)), lambda key: portable_hash((key[0], key[3] // ARITY ** (cap - key[2])))
    )
    return materialize(spark.createDataFrame(partials.mapPartitions(lambda part: _resolve(part, cap, paths)), _CLIMBED, verifySchema=False), "climbed")


def _tops(climbed: DataFrame) -> DataFrame:
    return climbed.where("digest IS NOT NULL").select("tree", "n", "idx", "digest")


def _paths(nodes: DataFrame, base: int = 0) -> DataFrame:
    """tree, idx, path, root of nodes (tree, n, idx, digest), all at level base: the path to their tree's root.
    What is no root yet after LEVELS levels is a node of the next round."""
    single = F.ceil(F.col("n") / ARITY**base) == 1
    none = F.array().cast(PATH)
    roots = nodes.where(single).select("tree", "idx", none.alias("path"), F.col("digest").alias("root"))
    rows = nodes.where(~single).count()
    if not rows:
        return roots
    climbed = _climb(nodes.where(~single), base, True, rows)
    above = _paths(_tops(climbed), base + LEVELS).select("tree", F.col("idx").alias("top"), F.col("path").alias("more"), "root")
    below = climbed.where("path IS NOT NULL").select("tree", "idx", "path", "top").join(above, ["tree", "top"])
    return below.select("tree", "idx", F.concat("path", "more").alias("path"), "root").unionByName(roots)


def _proved(levels: int, proofs: bool):
    """For the leaves of some blocks and the paths above these blocks: a row for each leaf."""

    def prove(leaves: pa.Table, above: pa.Table) -> pa.Table:
        size = ARITY**levels
        rows = leaves.to_pylist()
        partials: dict[tuple, dict[int, str]] = {}
        for r in rows:
            if r["n"] > 1:
                partials.setdefault((r["tree"], r["n"], 1, r["idx"] // ARITY), {})[r["idx"] % ARITY] = r["leaf"]
        paths = {(tree, idx): path for tree, _, idx, _, digest, path in _resolve(partials.items(), levels, True) if digest is None}
        uppers = {(r["tree"], r["block"]): r for r in above.to_pylist()}
        out: dict[str, list] = {c: [] for c in _proved_names(proofs)}
        for r in rows:
            upper = uppers[r["tree"], r["idx"] // size]
            path = [*paths.get((r["tree"], r["idx"]), ()), *((x["slot"], x["siblings"]) for x in upper["path"])]
            folded = r["altered"] or r["leaf"]
            for slot, siblings in path:
                folded = digest_of([*siblings[:slot], folded, *siblings[slot:]])
            values = [r["doc_id"], r["leaf"], upper["subroot"], upper["root"], digest_of(d for _, run in path for d in run), folded, folded == upper["root"]]
            if proofs:
                values.append([{"slot": slot, "siblings": siblings} for slot, siblings in path])
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
        return pa.table(out, schema=_proved_schema(proofs))

    return prove


def _proved_names(proofs: bool) -> list[str]:
    return ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * proofs


def _proved_schema(proofs: bool) -> pa.Schema:
    path = pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.list_(pa.string()))]))
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()] + [path] * proofs
    return pa.schema(list(zip(_proved_names(proofs), kinds, strict=True)))


@settled
def merkle_manifest(docs: DataFrame, altered: Column | None = None, proofs: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and with
    proofs the path itself (proof). altered: an expression for the text that a copy to be verified has.

    A row's digest is its leaf (leaf_digest; other columns than COLUMNS are ignored). The leaves of a source, in ascending
    doc_id, are a tree: every ARITY consecutive nodes of a level have one parent, the last parent fewer, until one node
    is left, the subroot. The subroots, in the order of sources, make one more tree, whose node is the root.

    Texts are read once; from there on only digests move. Leaves get their places from ranges
    (ranks.ranked), so that a source with a third of all rows is many tasks. Then nodes climb: a combineByKey gathers
    indexed child digests in partial parents, keyed so that a block of ARITY ** LEVELS leaves meets; whenever a
    parent has the children that its tree's size says, it becomes a digest and an event for its own parent. What
    is no root at the block's top goes to the next shuffle, three of which suffice for 280 billion leaves. The runs of
    digests that made each parent lead back down and give the paths: first those above blocks, few rows, then each
    block's own, in the task that also folds them, so that no proof of a leaf is stored unless it is wanted.

    verified: whether the leaf of the altered text (of the text itself where it is null or nothing is altered) and the
    original siblings lead to the root. Null ids come first in their source. Rows alike in id are ordered by leaf, and equal
    rows have places of their own. A null source is a source, the first. Null and empty texts differ. A single
    leaf is its subroot, a single subroot the root, with the digest of nothing as proof_sha256. Empty table: no rows.
    """
    changed = F.lit(None).cast("string") if altered is None else F.when(~altered.eqNullSafe(F.col("text")), leaf_digest(altered))
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_digest().alias("leaf"), changed.alias("altered")
    )
    # a number for each row, written with it: equal rows can be dealt to several tasks
    leaves = materialize(leaves.withColumn("number", F.monotonically_increasing_id()), "leaves")
    placed = ranked(leaves, [F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("number")], ["source"], numbered=True)
    placed = materialize(placed.select("doc_id", "leaf", "altered", F.col("group").alias("tree"), "n", F.col("rank").alias("idx")), "placed")
    rows = placed.count()

    several = placed.where("n > 1").withColumn("digest", F.col("leaf"))
    blocks = _tops(_climb(several, 0, False, rows)).unionByName(placed.where("n = 1").select("tree", "n", "idx", F.col("leaf").alias("digest")))
    above = materialize(_paths(blocks, LEVELS), "above")
    subroots = above.groupBy("tree").agg(F.first("root").alias("digest"))
    sources = subroots.count()
    top = _paths(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(sources).cast("long").alias("n"), F.col("tree").alias("idx"), "digest"))
    top = top.select(F.col("idx").alias("tree"), F.col("path").alias("more"), F.col("root").alias("whole"))
    above = above.join(top, "tree").select("tree", F.col("idx").alias("block"), F.concat("path", "more").alias("path"), F.col("root").alias("subroot"), F.col("whole").alias("root"))

    bucket = F.pmod(F.xxhash64("tree", "block"), F.lit(rows // PART_NODES + 1)).alias("bucket")
    dealt = placed.withColumn("block", F.floor(F.col("idx") / ARITY**LEVELS)).select("*", bucket)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", proof {PATH}" * proofs
    return dealt.groupBy("bucket").cogroup(above.select("*", bucket).groupBy("bucket")).applyInArrow(_proved(LEVELS, proofs), schema)


def without_newlines_where_even() -> Column:
    """The query's altered text: without its newlines where the crc32 of the decimal doc_id is even. Null stays null."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def _oracle() -> str:
    """The same rows in DuckDB's SQL: levels by recursion, then each leaf's siblings, folded level by level."""
    value = lambda x: f"coalesce(octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in COLUMNS) + ")"
    up = f"""
            SELECT tree, level + 1, idx // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(d, '' ORDER BY idx))
            FROM nodes WHERE n > 1 GROUP BY tree, level, n, idx // {ARITY}"""
    steps = lambda nodes, start, tree, place: f"""
            SELECT l.number, {start} + s.level AS level, coalesce(string_agg(s.d, '' ORDER BY s.idx) FILTER (s.idx < {place} // p), '') AS pre,
                   coalesce(string_agg(s.d, '' ORDER BY s.idx) FILTER (s.idx > {place} // p), '') AS post
            FROM leaves l JOIN (SELECT *, CAST(pow({ARITY}, level) AS BIGINT) AS p FROM {nodes}) s
            ON s.tree = {tree} AND s.n > 1 AND s.idx // {ARITY} = {place} // (p * {ARITY}) GROUP BY ALL"""  # noqa: E731
    return f"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), i)) AS t),
        marked AS (
            SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                          lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 2 = 0 AS even FROM documents, crc),
        hashed AS (
            SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN even THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS altered FROM marked),
        leaves AS MATERIALIZED (
            SELECT *, row_number() OVER () AS number, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM hashed),
        nodes(tree, level, idx, n, d) AS (SELECT tree, 0, idx, n, leaf FROM leaves UNION ALL {up}),
        subroots AS MATERIALIZED (SELECT tree, d AS subroot, count(*) OVER () AS n FROM nodes WHERE n = 1),
        more(tree, level, idx, n, d) AS (SELECT 0, 0, tree, n, subroot FROM subroots UNION ALL {up.replace("FROM nodes", "FROM more")}),
        steps AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY number ORDER BY level) AS k FROM ({steps("nodes", 0, "l.tree", "l.idx")} UNION ALL {steps("more", 1000, "0", "l.tree")})),
        proofs AS (SELECT number, max(k) AS last, sha256(string_agg(pre || post, '' ORDER BY k)) AS proof FROM steps GROUP BY number),
        folds(number, k, d) AS (
            SELECT number, 0, altered FROM leaves UNION ALL
            SELECT number, folds.k + 1, sha256(pre || d || post) FROM folds JOIN steps USING (number) WHERE steps.k = folds.k + 1),
        whole AS (SELECT d AS root FROM more WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folds.d AS folded_root, folds.d = root AS verified
        FROM leaves JOIN subroots USING (tree) CROSS JOIN whole LEFT JOIN proofs USING (number) JOIN folds ON folds.number = leaves.number AND folds.k = coalesce(last, 0)"""


ORACLE_SQL = _oracle()
