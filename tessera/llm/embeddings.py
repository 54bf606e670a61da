"""Near duplicates among embeddings: rotated binary codes with error bounds, exact where those leave doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import materialize, settled

CELL_ROWS = 1_000  # vectors of a cell, about, in a corpus of fewer than MAX_CELLS times as many
MAX_CELLS = 4_096  # in all; larger corpora have larger cells
CENTRE_BYTES = 1 << 26  # of all centres, about; longer vectors have fewer and larger cells
PART_ROWS = 8_192  # vectors of one side of a group, at most
PART_BYTES = 1 << 24  # of their doubles
PROBES = 256  # centres of a label from which the visitors of its cells are estimated
DEVIATIONS = 6.0  # of an estimate; a pair that would have to be further off is rejected by it
SEED = 31


class RotatedCodes:
    """Signs of randomly rotated unit vectors, and what corrects an estimate made from them.

    For a unit vector o with rotated signs s, the code is c = s / sqrt(n) and its correction is
    f = <c, o>. For any unit vector q, <c, q> / f estimates <o, q> without bias over the rotation, and
    the part of q off o disturbs it by at most about sqrt((1 - f*f) / (f*f) / (n - 1)) a deviation.
    q is kept as whole numbers of 8 bits times a step; what that rounds off has a known length, which
    bounds what it adds to an estimate.
    """

    def __init__(self, dimension: int):
        rng = np.random.default_rng(SEED)
        q, r = np.linalg.qr(rng.normal(size=(dimension, dimension)))
        self.rotation = q * np.sign(np.diag(r))
        self.dimension = dimension

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes (a bit each, packed to bytes), corrections, rounded rotated vectors (int8), their steps
        and the lengths of what was rounded off."""
        rotated = unit @ self.rotation.T
        code = np.packbits(rotated >= 0, axis=1)
        factor = np.abs(rotated).sum(axis=1) / np.sqrt(self.dimension)
        step = np.abs(rotated).max(axis=1) / 127
        rounded = np.rint(rotated / step[:, None])
        off = np.linalg.norm(rotated - rounded * step[:, None], axis=1)
        return code, factor.astype(np.float32), rounded.astype(np.int8), step.astype(np.float32), off.astype(np.float32)

    def estimates(self, code: np.ndarray, factor: np.ndarray, rounded: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Of the inner products of coded vectors (rows) and rounded ones (columns)."""
        signs = np.unpackbits(code, axis=1, count=self.dimension).astype(np.float32) * 2 - 1
        return (signs @ (rounded.T * step[None, :])) / (np.float32(np.sqrt(self.dimension)) * factor)[:, None]

    def plausible(self, code, factor, rounded, step, off, threshold: float) -> np.ndarray:
        """Which coded vectors (rows) and rounded ones (columns) can have that inner product: their estimate,
        with all that rounding can take away, is not more than DEVIATIONS below it."""
        spread = np.sqrt(np.maximum(1 - factor**2, 0)) / factor
        reach = min(1.0, DEVIATIONS / np.sqrt(max(self.dimension - 1, 1)))
        least = threshold - 1e-4 - reach * spread * np.sqrt(1 - threshold**2)
        return self.estimates(code, factor, rounded, step) + off[None, :] / factor[:, None] >= least[:, None]


def _unit(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, v (unit, doubles) of the rows that can have links."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    rows = rows.withColumn("most", F.aggregate("v", F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x)))).where("most > 0")
    rows = rows.withColumn("v", F.transform("v", lambda x: x / F.col("most")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    return rows.withColumn("norm", norm).select("id", "label", F.transform("v", lambda x: x / F.col("norm")).alias("v"), F.size("v").cast("long").alias("n"))


_CODED = "label {kind}, n long, node long, times long, cell long, home boolean, code binary, factor float, rounded binary, step float, off float"


def _centres(classes: DataFrame, threshold: float) -> dict:
    """The centres of each (label, n) whose cells save work: vectors of the corpus drawn by hash, of bounded
    number and bytes. A label spread evenly would send each vector to so many cells that dealing the
    label in blocks costs less; that is estimated from some of its centres, each placed among the others."""
    sizes = classes.groupBy("label", "n").agg(F.count("*").alias("rows"))
    rows, numbers = sizes.agg(F.sum("rows"), F.sum(F.col("rows") * F.col("n"))).first()
    each = max(CELL_ROWS, (rows or 0) // MAX_CELLS, 8 * (numbers or 0) // CENTRE_BYTES)
    share = F.xxhash64("node", F.lit(SEED)).cast("double") / float(2**64) + 0.5
    drawn = classes.join(sizes.where(F.col("rows") > each), ["label", "n"]).where(share <= 1.0 / each)
    by_group: dict = {}
    for r in drawn.select("label", "n", "rows", "v").limit(4 * MAX_CELLS).collect():
        by_group.setdefault((r["label"], r["n"]), (r["rows"], []))[1].append(r["v"])
    out, slack = {}, _slack(threshold)
    for key, (count, vectors) in by_group.items():
        table = np.array(sorted(vectors))
        angle = np.arccos(np.clip(table[:PROBES] @ table.T, -1, 1))
        angle[np.arange(len(angle)), np.arange(len(angle))] = np.pi
        visits = (angle <= angle.min(axis=1)[:, None] + slack).sum(axis=1).mean() / 2
        if visits < 2 * count / _part_rows(key[1]):
            out[key] = table
    return out


def _slack(threshold: float) -> float:
    return 2 * float(np.arccos(threshold)) + 1e-6


def _part_rows(n: int) -> int:
    return max(1, min(PART_ROWS, PART_BYTES // (8 * n)))


def _cells(classes: DataFrame, threshold: float) -> DataFrame:
    """classes (label, n, node, times, v) without vectors, with codes, cell and home: once in the cell of
    the nearest centre of their label, and once, as visitors, in each earlier cell that can hold a
    neighbour. A visitor brings its code and correction only.

    Let d be the angle of the threshold. If y is x's neighbour and its nearest centre is c, then y is
    at most d further from x's nearest centre than x is, so x is at most 2 d further from c. A
    visitor goes where that holds: no link is lost, and what is far apart never meets.
    """
    shared = classes.sparkSession.sparkContext.broadcast(_centres(classes, threshold))
    slack = _slack(threshold)
    kind = classes.schema["label"].dataType.simpleString()
    names = ["label", "n", "node", "times", "cell", "home", "code", "factor", "rounded", "step", "off"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {}
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("n").to_pylist(), strict=True))
            for key in sorted(set(keys), key=str):
                mine = np.array([i for i, k in enumerate(keys) if k == key])
                x = batch.column("v").take(pa.array(mine)).flatten().to_numpy().reshape(-1, key[1])
                if key[1] not in codes:
                    codes[key[1]] = RotatedCodes(key[1])
                coded = codes[key[1]].encode(x)
                table = shared.value.get(key)
                if table is None:
                    row, cell, home = np.arange(len(mine)), np.zeros(len(mine), dtype=np.int64), np.ones(len(mine), dtype=bool)
                else:
                    angle = np.arccos(np.clip(x @ table.T, -1, 1))
                    nearest = angle.argmin(axis=1)
                    near = angle <= angle.min(axis=1)[:, None] + slack
                    row, cell = np.nonzero(near & (np.arange(len(table)) <= nearest[:, None]))
                    home = cell == nearest[row]
                for low in range(0, len(row), 50_000):
                    at = slice(low, low + 50_000)
                    yield placed(batch, mine[row[at]], row[at], cell[at], home[at], coded)

    def placed(batch, of, row, cell, home, coded):
        code, factor, rounded, step, off = coded
        alone = pa.array(~home)
        blank = lambda x: pa.compute.if_else(alone, pa.scalar(None, x.type), x)
        taken = batch.select(["label", "n", "node", "times"]).take(pa.array(of))
        columns = [
            pa.array([code[k].tobytes() for k in row.tolist()], pa.binary()),
            pa.array(factor[row]),
            pa.array([rounded[k].tobytes() if h else None for k, h in zip(row.tolist(), home.tolist(), strict=True)], pa.binary()),
            blank(pa.array(step[row])),
            blank(pa.array(off[row])),
        ]
        return pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int64)), pa.array(home), *columns], names)

    return classes.select("label", "n", "node", "times", "v").mapInArrow(place, _CODED.format(kind=kind))


_GROUP = ["label", "n", "cell", "i", "j"]


def _dealt(cells: DataFrame) -> DataFrame:
    """The rows of cells dealt to groups of bounded size: those at home as left sides, all as right sides."""
    key = ["label", "n", "cell"]
    part = F.greatest(F.lit(1), F.least(F.lit(PART_ROWS), F.floor(F.lit(PART_BYTES) / (8 * F.col("n")))))
    parts = lambda c: F.ceil(c / part)
    sizes = cells.groupBy(*key).agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("all"))
    dealt = cells.join(sizes.where("homes > 0"), key).withColumns({"lefts": parts(F.col("homes")), "rights": parts(F.col("all"))})
    h = F.xxhash64("node")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    base = [*key, "node", "times", "home"]
    lefts = dealt.where("home").select(*base, F.lit(True).alias("left"), F.pmod(h, F.col("lefts")).alias("i"), upto("rights").alias("j"), "rounded", "step", "off")
    rights = dealt.select(*base, F.lit(False).alias("left"), upto("lefts").alias("i"), F.pmod(h, F.col("rights")).alias("j"), "code", "factor")
    return lefts.unionByName(rights, allowMissingColumns=True)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    left = group["left"].to_numpy(zero_copy_only=False)
    return np.flatnonzero(left), np.flatnonzero(~left)


def _undecided(cells: DataFrame, threshold: float) -> DataFrame:
    """The rows of groups in which codes leave a pair open, with their group and side: only those need vectors.
    A visitor's code meets the rounded vectors at home."""
    dealt = _dealt(cells)
    names = [*_GROUP, "node", "times", "home", "left"]
    kind = cells.schema["label"].dataType.simpleString()

    def estimate(group: pa.Table) -> pa.Table:
        dimension = group["n"][0].as_py()
        left, right = _sides(group)
        wanted = np.zeros(group.num_rows, dtype=bool)
        if len(left) and len(right):
            codes = RotatedCodes(dimension)
            bytes_of = lambda c, rows, kind: np.frombuffer(b"".join(group[c].take(pa.array(rows)).to_pylist()), dtype=kind).reshape(len(rows), -1)
            number = lambda c, rows: group[c].take(pa.array(rows)).to_numpy()
            rounded, step, off = bytes_of("rounded", left, np.int8), number("step", left), number("off", left)
            code, factor = bytes_of("code", right, np.uint8), number("factor", right)
            node, visits = group["node"].to_numpy(), ~group["home"].to_numpy(zero_copy_only=False)
            for low in range(0, len(right), 512):
                some = slice(low, low + 512)
                open_ = codes.plausible(code[some], factor[some], rounded, step, off, threshold)
                # of two at home, both are on either side: once is enough
                open_ &= visits[right[some]][:, None] | (node[left][None, :] < node[right[some]][:, None])
                wanted[right[some]] |= open_.any(axis=1)
                wanted[left] |= open_.any(axis=0)
        return group.select(names).filter(pa.array(wanted))

    schema = f"label {kind}, n long, cell long, i long, j long, node long, times long, home boolean, left boolean"
    return dealt.groupBy(*_GROUP).applyInArrow(estimate, schema)


def _links(undecided: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """From the undecided rows: a, b, times. With b null: times more links of a. Else: a and b are connected.
    Vectors come by node; a group computes its open pairs in double precision and returns sums, not pairs."""
    names = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("times", pa.int64())])

    def link(group: pa.Table) -> pa.Table:
        dimension = group["n"][0].as_py()
        left, right = _sides(group)
        node, times = group["node"].to_numpy(), group["times"].to_numpy()
        x = group["v"].combine_chunks().flatten().to_numpy().reshape(-1, dimension)
        visits = ~group["home"].to_numpy(zero_copy_only=False)
        codes = RotatedCodes(dimension)
        _, _, *rounded = codes.encode(x[left])
        code, factor, *_ = codes.encode(x[right])
        found_i, found_j = [], []
        for low in range(0, len(right), 512):
            some = slice(low, low + 512)
            open_ = codes.plausible(code[some], factor[some], *rounded, threshold)
            open_ &= visits[right[some]][:, None] | (node[left][None, :] < node[right[some]][:, None])
            j, i = np.nonzero(open_)
            i, j = left[i], right[j + low]
            for at in range(0, len(i), 100_000):
                p, q = i[at : at + 100_000], j[at : at + 100_000]
                exact = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                found_i.append(p[exact])
                found_j.append(q[exact])
        i, j = np.concatenate(found_i or [[]]).astype(np.int64), np.concatenate(found_j or [[]]).astype(np.int64)
        if not len(i):
            return names.empty_table()
        more: dict[int, int] = {}
        for a, b in ((i, j), (j, i)):
            sums = np.bincount(a, times[b], len(node)).astype(np.int64)
            for k in np.flatnonzero(sums):
                more[int(node[k])] = more.get(int(node[k]), 0) + int(sums[k])
        root = np.arange(len(node))
        while True:  # the smallest row number that links reach within the group
            least = root.copy()
            np.minimum.at(least, i, root[j])
            np.minimum.at(least, j, root[i])
            least = np.minimum(least, least[least])
            if (least == root).all():
                break
            root = least
        tied = np.flatnonzero(node[root] != node)
        return pa.table(
            {
                "a": np.concatenate([np.array(list(more)), node[tied]]).astype(np.int64),
                "b": pa.array([None] * len(more) + node[root[tied]].tolist(), pa.int64()),
                "times": np.concatenate([np.array(list(more.values())), np.zeros(len(tied))]).astype(np.int64),
            },
            schema=names,
        )

    rows = undecided.join(classes.select("node", "v"), "node")
    return rows.groupBy(*_GROUP).applyInArrow(link, "a long, b long, times long")


@settled
def near_embeddings(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """A row for each row of vectors: vec_id, n_links, component_id, kept. Vectors are linked if
    their labels are equal and not null and their cosine, in double precision, reaches the threshold.

    Equal unit vectors of a label are one node from the start, with the number of its rows. Nodes get a
    packed code, its correction and a rounded vector, stored once, and are placed in cells of their
    label, and in others where the triangle inequality allows a neighbour (_cells), or where that would
    be nearly all, the label is one cell. Cells are dealt to groups of bounded size, part against part.
    In a group, codes estimate every inner product; only rows of pairs that the error bound leaves open
    get their vectors, and those pairs are computed exactly. A group returns counts and what is
    connected, not pairs.

    Linked with nothing (n_links 0, its own component): vectors that are null, empty, zero, or hold
    null or non-finite components; null labels; a vector of another length than the other. A null
    id: component_id null, kept true. Rows that share an id are one vector if they are equal; if not,
    the larger count stands and the smallest component. Other columns are ignored. Empty table: no rows.
    """
    unit = materialize(_unit(vectors, id_col, vector_col, label_col), "unit")
    classes = unit.groupBy("label", "n", "v").agg(F.min("id").alias("least"), F.countDistinct("id").alias("times"))
    # a class's number; written with it, so it stays
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    cells = materialize(_cells(classes, threshold), "cells")
    links = materialize(_links(materialize(_undecided(cells, threshold), "undecided"), classes, threshold), "links")
    more = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("times").alias("more"))
    reach = connected_components(links.where("b IS NOT NULL").select("a", "b"))
    nodes = classes.select("node", "least", "times").join(more, "node", "left").join(reach, "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = materialize(nodes, "nodes")
    first = nodes.groupBy("component").agg(F.min("least").alias("first"))
    nodes = nodes.join(first, "component").select("node", (F.col("times") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "first")
    nodes = nodes.join(classes.select("node", "label", "n", "v"), "node")
    found = unit.join(nodes, ["label", "n", "v"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("first").alias("component"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    component = F.coalesce("component", "vec_id")
    return rows.join(found, F.col("vec_id") == F.col("id"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id").isNull() | (component == F.col("vec_id"))).alias("kept"),
    )


ORACLE_SQL = """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
        WHERE label IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
    links AS (
        SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
        WHERE list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.98),
    reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, b FROM reach JOIN links ON a = r),
    degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
    SELECT vec_id, coalesce(max(n_links), 0) AS n_links, min(r) AS component_id, min(r) = vec_id AS kept
    FROM reach LEFT JOIN degree ON a = vec_id GROUP BY vec_id"""
