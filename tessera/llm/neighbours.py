"""Nearest neighbours by inner product: low-dimensional stable projections in kd-trees, read in the order of projected
distance until a chi-square test says that no more are to come."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialize, settled

DIMENSIONS = 16  # of projections; even, for which the chi-square distribution has a closed form
CERTAINTY = 0.97  # that a neighbour isn't beyond where the search stops
SAMPLE_ROWS = 32_768  # of the corpus, about, that cells are fitted on
SAMPLE_BYTES = 1 << 26  # of their components, about
CELL_ROWS = 16_384  # vectors of a cell, about, in a corpus of fewer than MAX_CELLS times as many
MAX_CELLS = 4_096
PART_BYTES = 1 << 25  # of the vectors of a cell that one task holds
QUERY_ROWS = 8_192  # queries that meet one part in one task
LEAF_ROWS = 48
SEED = 17


def chi_square(x: float, degrees: int) -> float:
    """Its distribution function, for an even number of degrees."""
    term, total = 1.0, 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 100.0 * degrees
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < share else (low, middle)
    return high


class Projection:
    """Vectors with one more component, so that the largest inner product is the smallest distance, and Gaussian
    (2-stable) projections of these: a squared projected distance is the squared distance times a chi-square."""

    def __init__(self, length: int, longest: float, dimensions: int):
        self.matrix = np.random.default_rng([SEED, length]).normal(size=(length + 1, dimensions))
        self.longest = longest

    def __call__(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Of vectors scaled to lengths of at most 1; a query's own additional component is 0."""
        x = x / self.longest
        out = x @ self.matrix[:-1]
        return out if query else out + np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))[:, None] * self.matrix[-1]

    def squared_distance(self, scores: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Between a query and vectors with such inner products, both with their additional components."""
        q = query / self.longest
        return np.maximum(1 + q @ q - 2 * (scores / self.longest / self.longest), 0)


class KdTree:
    """Points split at medians along the widest dimension, until a leaf has few."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        self.order = np.arange(len(points))
        self.splits: list[tuple[int, float, int, int]] = []  # dimension, value, nodes below and from it; leaves are ~number
        self.leaves: list[tuple[int, int]] = []
        todo = [(0, len(points), None)]
        while todo:
            low, high, above = todo.pop()
            mine = points[self.order[low:high]]
            if high - low <= leaf_rows:
                self.leaves.append((low, high))
                node = ~(len(self.leaves) - 1)
            else:
                d = int(np.argmax(mine.max(axis=0) - mine.min(axis=0)))
                middle = (high - low) // 2
                by = np.argpartition(mine[:, d], middle)
                self.order[low:high] = self.order[low:high][by]
                self.splits.append((d, float(mine[by[middle], d]), 0, 0))
                node = len(self.splits) - 1
                todo += [(low, low + middle, (node, 2)), (low + middle, high, (node, 3))]
            if above:
                parent, side = above
                self.splits[parent] = tuple(node if k == side else x for k, x in enumerate(self.splits[parent]))

    def route(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each of any points."""
        at = np.zeros(len(points), dtype=np.int64) if self.splits else np.full(len(points), -1)
        dimension, value, below, above = (np.array(x) for x in zip(*self.splits, strict=True)) if self.splits else [None] * 4
        while (inner := np.flatnonzero(at >= 0)).size:
            k = at[inner]
            at[inner] = np.where(points[inner, dimension[k]] < value[k], below[k], above[k])
        return ~at


def _gaps(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of boxes from a point."""
    off = np.maximum(np.maximum(low - point, point - high), 0)
    return np.einsum("ij,ij->i", off, off)


class Index:
    """A kd-tree over the projections of some vectors, which its search reads leaf by leaf."""

    def __init__(self, projection: Projection, x: np.ndarray, z: np.ndarray, times: np.ndarray, least: np.ndarray):
        tree = KdTree(z, LEAF_ROWS)
        self.projection, self.at = projection, tree.order
        self.x, self.z, self.times, self.least = x[tree.order], z[tree.order], times[tree.order], least[tree.order]
        self.first, self.last = np.array(tree.leaves).T
        self.low = np.array([self.z[a:b].min(axis=0) for a, b in tree.leaves])
        self.high = np.array([self.z[a:b].max(axis=0) for a, b in tree.leaves])

    def search(self, query: np.ndarray, z: np.ndarray, k: int, known: float, quantile: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and inner products of the k best vectors by (product, least id), of those that are read.

        Leaves come by projected distance, some at a time, more each time. In them, vectors within the projected radius
        of the k-th distance so far (known or found, copies counted) are verified. The search stops when the next
        leaf is so far that a vector as near as the k-th would have been projected nearer with the certainty of quantile.
        """
        gaps = _gaps(self.low, self.high, z)
        leaves = np.argsort(gaps, kind="stable")
        gaps = gaps[leaves]
        best, scores = np.empty(0, dtype=np.int64), np.empty(0)
        at, step, kth = 0, 4, known
        while at < len(leaves):
            radius = self._radius(kth, query, quantile)
            if gaps[at] > radius:
                break
            some = leaves[at : at + step][gaps[at : at + step] <= radius]
            rows = np.concatenate([np.arange(a, b) for a, b in zip(self.first[some], self.last[some], strict=True)])
            off = self.z[rows] - z
            rows = rows[np.einsum("ij,ij->i", off, off) <= radius]
            best, scores = np.concatenate([best, rows]), np.concatenate([scores, np.einsum("ij,j->i", self.x[rows], query)])
            order = np.lexsort((self.least[best], -scores))[:k]
            best, scores = best[order], scores[order]
            enough = np.flatnonzero(np.cumsum(self.times[best]) >= k)
            if len(enough):
                kth = max(known, scores[enough[0]])
            at, step = at + step, min(2 * step, 256)
        return self.at[best], scores

    def _radius(self, kth: float, query: np.ndarray, quantile: float) -> float:
        if kth == -np.inf:
            return np.inf
        return float(self.projection.squared_distance(np.float64(kth), query)) * quantile * (1 + 1e-9) + 1e-9


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, n, v (doubles) of the rows that take part, and a number for each, written with it."""
    v = F.transform(F.col(vector_col), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    return materialize(rows.select("id", F.size("v").cast("long").alias("n"), "v").withColumn("number", F.monotonically_increasing_id()), "usable")


def _classes(rows: DataFrame, k: int, every: int) -> DataFrame:
    """Equal vectors as one node: n, v, node, ids (its first k + 1 by id; no result has use for more), times (of these), least, asks."""
    first = W.partitionBy("n", "v").orderBy("id", "number")
    few = rows.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= k + 1)
    asks = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("n", "v").agg(F.lit(True).alias("asks"))
    classes = few.groupBy("n", "v").agg(F.array_sort(F.collect_list(F.struct("id", "number"))).alias("ids")).join(asks, ["n", "v"], "left")
    classes = classes.select("n", "v", "ids", F.size("ids").cast("long").alias("times"), F.col("ids")[0]["id"].alias("least"), F.coalesce("asks", F.lit(False)).alias("asks"))
    return materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")


def _fitted(classes: DataFrame, dimensions: int) -> dict:
    """For each length of vectors its projection and the tree of its cells. Lengths are fewer than the longest vector has
    components; the sample is of bounded rows and bytes."""
    # squares of components as shares of the largest, so that they neither overflow nor vanish
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    norm = most * F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + (x / most) * (x / most)))
    sizes = classes.groupBy("n").agg(F.max(norm).alias("longest"), F.count("*").alias("rows")).collect()
    rows, numbers = sum(r["rows"] for r in sizes), sum(r["rows"] * r["n"] for r in sizes)
    share = min(1.0, SAMPLE_ROWS / max(rows, 1), SAMPLE_BYTES / 8 / max(numbers, 1))
    drawn = classes.where(F.xxhash64("node", F.lit(SEED)).cast("double") / float(2**64) + 0.5 <= share).select("n", "v")
    sample: dict[int, list] = {}
    for r in drawn.limit(2 * SAMPLE_ROWS).collect():
        sample.setdefault(r["n"], []).append(r["v"])
    each, out = max(CELL_ROWS, rows // MAX_CELLS), {}
    for r in sizes:
        projection = Projection(r["n"], r["longest"], dimensions)
        points = projection(np.array(sample.get(r["n"], [])).reshape(-1, r["n"]))
        out[r["n"]] = projection, KdTree(points, max(1, math.ceil(len(points) * each / r["rows"])))
    return out


def _rows(table, name: str, width: int) -> np.ndarray:
    column = table[name]
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=float).reshape(-1, width)


def _placed(classes: DataFrame, shared) -> DataFrame:
    """classes with z (projection) and cell."""
    names = ["n", "node", "times", "least", "asks", "v"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("n").to_numpy()
            for n in np.unique(lengths):
                some = batch.take(pa.array(np.flatnonzero(lengths == n)))
                projection, tree = shared.value[int(n)]
                z = projection(_rows(some, "v", int(n)))
                columns = [pa.array(z.tolist(), pa.list_(pa.float64())), pa.array(tree.route(z))]
                yield pa.RecordBatch.from_arrays([*some.select(names).columns, *columns], [*names, "z", "cell"])

    schema = "n long, node long, times long, least long, asks boolean, v array<double>, z array<double>, cell long"
    return materialize(classes.select(*names).mapInArrow(place, schema), "placed")


_FOUND = "query long, node long, score double, times long, least long"
_GROUP = ["n", "cell", "part", "block"]


def _searched(placed: DataFrame, asked: DataFrame, shared, k: int, quantile: float) -> DataFrame:
    """What queries (n, cell, query, v, known) find in their cells: cells are dealt to parts and queries to blocks of bounded size."""
    part = F.greatest(F.lit(1), F.floor(F.lit(PART_BYTES) / (8 * (F.col("n") + DIMENSIONS))))
    sizes = placed.groupBy("n", "cell").agg(F.count("*").alias("_rows")).withColumn("parts", F.ceil(F.col("_rows") / part))
    asked_sizes = asked.groupBy("n", "cell").agg(F.count("*").alias("_asked")).withColumn("blocks", F.ceil(F.col("_asked") / QUERY_ROWS))
    # as many rows as cells
    dealt = F.broadcast(sizes.join(asked_sizes, ["n", "cell"]).drop("_rows", "_asked"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    mine = placed.join(dealt, ["n", "cell"]).select("n", "cell", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), upto("blocks").alias("block"), "node", "times", "least", "v", "z")
    theirs = asked.join(dealt, ["n", "cell"]).select("n", "cell", upto("parts").alias("part"), F.pmod(F.xxhash64("query"), F.col("blocks")).alias("block"), "query", "v", "known")
    theirs = theirs.select(*[F.col(c).alias(f"q_{c}") for c in theirs.columns])  # else the two sides' columns may be the same
    kinds = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("score", pa.float64()), ("times", pa.int64()), ("least", pa.int64())])

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return kinds.empty_table()
        n = rows["n"][0].as_py()
        projection, _ = shared.value[n]
        node, times, least = (rows[c].to_numpy() for c in ("node", "times", "least"))
        z = _rows(rows, "z", projection.matrix.shape[1])
        index = Index(projection, _rows(rows, "v", n), z, times, least)
        asked = _rows(queries, "q_v", n)
        places = projection(asked, query=True)
        known = queries["q_known"].to_numpy()
        out = [index.search(q, p, k, kth, quantile) for q, p, kth in zip(asked, places, known, strict=True)]
        at = np.concatenate([a for a, _ in out])
        query = np.repeat(queries["q_query"].to_numpy(), [len(a) for a, _ in out])
        return pa.table({"query": query, "node": node[at], "score": np.concatenate([s for _, s in out]), "times": times[at], "least": least[at]}, schema=kinds)

    return mine.groupBy(*_GROUP).cogroup(theirs.groupBy(*[f"q_{c}" for c in _GROUP])).applyInArrow(search, _FOUND)


def _visits(asked: DataFrame, boxes, shared, quantile: float) -> DataFrame:
    """The queries (n, home, query, v, known), once for each other cell in which the test leaves a neighbour possible."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = [], []
            for i, (n, home, v, known) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "home", "v", "known")), strict=True)):
                projection, _ = shared.value[n]
                cell, low, high = boxes.value[n]
                v = np.array(v)
                radius = np.inf if known == -np.inf else float(projection.squared_distance(np.float64(known), v)) * quantile * (1 + 1e-9) + 1e-9
                near = cell[(_gaps(low, high, projection(v[None, :], query=True)[0]) <= radius) & (cell != home)]
                rows += [i] * len(near)
                cells += near.tolist()
            taken = batch.select(["n", "query", "v", "known"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells, pa.int64())], ["n", "query", "v", "known", "cell"])

    return asked.mapInArrow(visit, "n long, query long, v array<double>, known double, cell long")


@settled
def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, certainty: float = CERTAINTY, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, the k nearest found of all other
    rows, or all if they are fewer: largest inner product (score, in double precision) first, ties by smaller vec_id.

    Every vector is projected to DIMENSIONS Gaussian components, after one more component has made the largest inner product
    the smallest distance. A kd-tree of a bounded sample cuts the projections into cells, whose boxes are then
    taken from all vectors. A query first searches the cell where it would lie itself, which gives a k-th distance; then
    every other cell whose box may hold something nearer. In a cell, a kd-tree of the projections in it is read
    leaf by leaf, by projected distance. A squared projected distance is the squared distance times a chi-square with
    DIMENSIONS degrees, so both for cells and leaves the search stops where the chi-square distribution of the next
    projected distance over the k-th distance so far exceeds the certainty. What is within is verified on the vectors
    themselves. A true neighbour is missed with a probability of 1 - certainty at most. How much of the corpus
    that leaves out follows from the data alone: of evenly spread directions, little.

    Equal vectors are one node: searched once, and found once with the first k + 1 of their ids. Cells are dealt in parts, and
    their queries in blocks, of bounded size, so neither a crowded cell nor a third of all vectors in one place is one task.

    No part take: null ids; vectors that are null, empty, zero, or hold null or non-finite components. Vectors
    of other lengths than a query's are no candidates for it. A row is no candidate for itself; another row with its id is, and repeated
    query rows have a result each. Other columns are ignored. Empty table: no rows.
    """
    rows = _usable(vectors, id_col, vector_col)
    classes = _classes(rows, k, every)
    context = vectors.sparkSession.sparkContext
    quantile = chi_square_quantile(certainty, DIMENSIONS)
    shared = context.broadcast(_fitted(classes, DIMENSIONS))
    placed = _placed(classes, shared)
    ends = [f(F.get("z", F.lit(i))).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(DIMENSIONS)]
    by_length: dict[int, list] = {}
    for r in placed.groupBy("n", "cell").agg(*ends).collect():  # as many as cells: MAX_CELLS and one for each length, about
        by_length.setdefault(r["n"], []).append(r)
    boxes = {n: (np.array([r["cell"] for r in rs]), *(np.array([[r[f"{x}{i}"] for i in range(DIMENSIONS)] for r in rs]) for x in ("low", "high"))) for n, rs in by_length.items()}
    boxes = context.broadcast(boxes)

    of_query = W.partitionBy("query").orderBy(F.desc("score"), "least", "node")
    best = lambda found: found.withColumn("_k", F.row_number().over(of_query)).where(F.col("_k") <= k + 1)
    asked = placed.where("asks").select("n", "cell", F.col("node").alias("query"), "v")
    first = materialize(best(_searched(placed, asked.withColumn("known", F.lit(float("-inf"))), shared, k + 1, quantile)), "first")
    upto = F.sum("times").over(of_query.rowsBetween(W.unboundedPreceding, W.currentRow))
    known = first.withColumn("upto", upto).where(F.col("upto") > k).groupBy("query").agg(F.max("score").alias("known"))
    asked = asked.withColumnRenamed("cell", "home").join(known, "query", "left").withColumn("known", F.coalesce("known", F.lit(float("-inf"))))
    visits = materialize(_visits(asked, boxes, shared, quantile), "visits")
    more = _searched(placed, visits, shared, k + 1, quantile)
    found = materialize(best(first.drop("_k").unionByName(more)), "found")

    # nodes to rows: the first k + 1 rows of a query's, of which one may be itself
    listed = found.join(classes.select("node", F.explode("ids").alias("i")), "node").select("query", "score", F.col("i.id").alias("vec_id"), F.col("i.number").alias("number"))
    in_order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "number")
    listed = materialize(listed.withColumn("_k", F.row_number().over(in_order)).where(F.col("_k") <= k + 1).drop("_k"), "listed")
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).join(classes.select("n", "v", F.col("node").alias("query")), ["n", "v"])
    queries = queries.select("query", F.col("id").alias("query_id"), F.col("number").alias("own"))
    of_row = W.partitionBy("own").orderBy(F.desc("score"), "vec_id", "number")
    out = queries.join(listed, "query").where("number != own").withColumn("rank", F.row_number().over(of_row)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
