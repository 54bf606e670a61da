import numpy as np
import pytest

from tessera.llm import neighbours, queries

from .helpers import clashing

VECTORS = "vec_id long, embedding array<double>"


def brute(rows, k=20, every=20):
    """For each query row, all other rows by score, as (score, id)."""
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            others = [(float((v * q).sum()), j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q)]
            out.append((i, sorted(others, key=lambda x: (-x[0], x[1]))[:k]))
    return out


def found(df):
    """Lists by query; rows of one id are told apart by nothing, so there tests have one query row an id."""
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def recall(got, want, k=20):
    """By score, so that either of two ties counts."""
    hits = total = 0
    for i, others in want:
        total += len(others)
        least = others[-1][0] - 1e-9 if others else 0
        hits += sum(s >= least for s, _ in got.get(i, []))
    return hits / max(total, 1)


@pytest.fixture
def small(monkeypatch):
    for name, value in {"CELL_ROWS": 60, "PART_BYTES": 8 * 40 * 30, "QUERY_ROWS": 7, "LEAF_ROWS": 8}.items():
        monkeypatch.setattr(neighbours, name, value)


def clusters(seed, n=800, dimension=24, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dimension))
    x = centres[rng.integers(12, size=n)] + rng.normal(0, spread, (n, dimension))
    return [(k, (v * rng.choice([0.3, 1, 2])).tolist()) for k, v in enumerate(x)]


def test_recall_in_many_cells_and_parts(spark, small):
    rows = clusters(1)
    want = brute(rows)
    got = found(neighbours.nearest(clashing(spark.createDataFrame(rows, VECTORS))))
    assert len(got) == len(want) == 40 and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.95
    exact = found(neighbours.nearest(spark.createDataFrame(rows, VECTORS), certainty=1 - 1e-12))
    assert recall(exact, want) == 1
    for i, others in want:
        assert [j for _, j in exact[i]] == [j for _, j in others] and np.allclose([s for s, _ in exact[i]], [s for s, _ in others], rtol=1e-12)


def test_copies_ties_and_ids_that_rows_share(spark, small):
    one, two = [1.0, 2.0, 0.0], [2.0, 1.0, 0.0]
    rows = [(k, one) for k in range(1, 300)] + [(k, two) for k in range(300, 340)] + [(340, one), (400, [0.5, 0.5, 0.5]), (400 + 7, one), (407, one), (407, two)]
    want = brute(rows)
    got = found(neighbours.nearest(spark.createDataFrame(rows, VECTORS), certainty=1 - 1e-12))
    assert got == {i: others for i, others in want}


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, []), (80, [1.0, nan]), (100, [1.0, inf]), (120, [1.0, None]), (None, [1.0, 1.0])]
    rows += [(1, [2.0, 1.0]), (2, [-1.0, 0.0]), (140, [1.0, 0.0, 0.0]), (-20, [0.0, -3.0]), (3, [-0.0, 1.0]), (160, [1e200, 1e200, 1.0, 1.0])]
    got = found(neighbours.nearest(spark.createDataFrame(rows, VECTORS)))
    assert got == {i: others for i, others in brute(rows) if others}
    assert set(got) == {0, -20} and len(got[0]) == 4
    assert neighbours.nearest(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_on_a_given_table(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = found(queries.QUERIES["op11_nearest_neighbours"](spark, "/root/testdata/sf0.001"))
    assert recall(got, brute(rows)) >= 0.95


def test_chi_square_and_projections():
    assert abs(neighbours.chi_square(18.307, 10) - 0.95) < 1e-4 and abs(neighbours.chi_square_quantile(0.95, 16) - 26.296) < 1e-2
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 32)) * rng.choice([0.1, 1.0], (2000, 1))
    longest = np.linalg.norm(x, axis=1).max()
    q = rng.normal(size=32)
    shares = []
    for length in range(40):  # other seeds
        p = neighbours.Projection(32, longest, 16)
        p.matrix = np.random.default_rng(length).normal(size=p.matrix.shape)
        off = p(x) - p(q[None, :], query=True)
        shares.append(((off**2).sum(axis=1) <= neighbours.chi_square_quantile(0.9, 16) * p.squared_distance(x @ q, q)).mean())
    assert abs(np.mean(shares) - 0.9) < 0.03


def test_trees_route_points_to_their_leaves():
    rng = np.random.default_rng(5)
    points = np.round(rng.normal(size=(500, 4)), 1)
    tree = neighbours.KdTree(points, 16)
    assert sorted(tree.order) == list(range(500)) and all(0 < b - a <= 16 for a, b in tree.leaves)
    leaf = tree.route(points)
    # equal values go to the upper side, wherever the median cut them
    assert set(leaf) <= set(range(len(tree.leaves))) and len(set(leaf)) > 20
    assert neighbours.KdTree(np.empty((0, 4)), 1).route(points).tolist() == [0] * 500
