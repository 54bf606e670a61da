import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow.parquet
from pyspark.sql import functions as F

from tessera.llm import descriptors, embeddings, media
from tessera.llm.embeddings import RotatedCodes

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    ids = [r[0] for r in rows]
    v = []
    for _, e, label in rows:
        x = np.array([np.nan if c is None else c for c in e], dtype=float) if e else np.full(1, np.nan)
        v.append(x / np.linalg.norm(x) if label is not None and np.isfinite(x).all() and x.any() else None)
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if v[i] is not None and v[j] is not None and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]) and float(v[i] @ v[j]) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, stack = set(), [i]
        while stack:
            k = stack.pop()
            if k not in seen:
                seen.add(k)
                stack += links[k]
        out[ids[i]] = (len(links[i]), min(ids[k] for k in seen))
    return out


def vectors(seed, n=400, dimension=16):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            base = np.array(rows[rng.integers(len(rows))][1])
            x = base + rng.normal(0, rng.choice([0.0, 0.02, 0.045, 0.06]), len(base)) * np.linalg.norm(base)
        else:
            x = rng.normal(size=dimension)
        rows.append((k, x.astype(np.float32).tolist(), int(rng.integers(3))))
    return rows


def test_links_equal_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_ROWS", 25)
    monkeypatch.setattr(embeddings, "PART_ROWS", 20)
    rows = vectors(1)
    want = brute(rows)
    assert sum(n for n, _ in want.values()) > 100
    got = embeddings.near_embeddings(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_that_cannot_link(spark):
    one = [1.0, 0.0, 0.0]
    rows = [
        (1, one, 1), (2, one, 1), (3, [2.0, 0.0, 0.0], 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [], 1), (8, [0.0] * 3, 1),
        (9, [1.0, None, 0.0], 1), (10, [float("nan"), 1.0, 0.0], 1), (11, [float("inf"), 1.0, 0.0], 1), (12, [1.0, 0.0], 1), (1, one, 1),
    ]
    got = embeddings.near_embeddings(spark.createDataFrame([*rows, (None, one, 1)], VECTORS)).collect()
    assert len(got) == len(rows) + 1
    by = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert by[1] == by[2] == by[3] == (2, 1)
    assert all(by[k] == (0, k) for k in range(4, 13)) and by[None] == (0, None)
    assert embeddings.near_embeddings(spark.createDataFrame([], VECTORS)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + rng.normal(0, 0.2 / 8, x.shape)
    y /= np.linalg.norm(y, axis=1)[:, None]
    codes = RotatedCodes(64)
    assert np.allclose(codes.rotation @ codes.rotation.T, np.eye(64))
    code, factor, *_ = codes.encode(x)
    rounded = codes.encode(y)[2:]
    assert code.shape == (500, 8)
    exact = x @ y.T
    estimate = codes.estimates(code, factor, *rounded[:2])
    assert abs((estimate - exact).mean()) < 0.005
    some = codes.plausible(code, factor, *rounded, 0.98)
    assert some[exact >= 0.98].all() and some.mean() < 0.05


def test_a_label_spread_evenly_is_dealt_in_blocks(spark, monkeypatch):
    """Random directions would visit nearly every cell; clustered ones stay at home. Neither loses a link."""
    monkeypatch.setattr(embeddings, "CELL_ROWS", 20)
    monkeypatch.setattr(embeddings, "PART_ROWS", 150)
    rng = np.random.default_rng(3)
    even = rng.normal(size=(300, 24))
    even[150:] = even[:150] + rng.normal(0, 0.1, (150, 24))
    tight = np.repeat(rng.normal(size=(15, 24)), 20, axis=0) + rng.normal(0, 0.02, (300, 24))
    rows = [(k, x.astype(np.float32).tolist(), int(k >= 300)) for k, x in enumerate(np.concatenate([even, tight]))]
    df = spark.createDataFrame(rows, VECTORS)
    unit = embeddings._unit(df, "vec_id", "embedding", "label")
    centres = embeddings._centres(unit.withColumnRenamed("id", "node"), 0.98)
    assert {k[0] for k in centres} == {1}
    got = embeddings.near_embeddings(df.withColumn("node", F.lit("x")).withColumn("cell", F.lit(1)).withColumn("v", F.lit(None))).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)


def picture(rng):
    return descriptors.resize(rng.random((1, 12, 12)).astype(np.float32), 96, 96)[0] * 255


def edits(rng, p):
    yield p[8:88, 6:86]
    yield np.clip(p * 0.8 + 20 + rng.normal(0, 4, p.shape), 0, 255)
    yield np.rot90(p)


def test_copies_of_images_are_found(spark):
    rng = np.random.default_rng(3)
    rows, family = [], {}
    for k in range(40):
        p = picture(rng)
        for image in (p, *edits(rng, p)) if k % 2 else (p,):
            family[len(rows)] = k
            rows.append((len(rows), descriptors.write_pgm(image)))
    got = media.near_media(spark.createDataFrame(rows, "media_id long, image binary")).collect()
    right = [family[r.media_id] == family[r.component_id] for r in got]
    assert all(right)
    copies = [r for r in got if family[r.media_id] % 2 and r.media_id != min(i for i, f in family.items() if f == family[r.media_id])]
    assert sum(not r.kept for r in copies) >= 0.9 * len(copies)


def test_many_copies_of_few_images_against_all_pairs(spark, monkeypatch):
    """Families of 24, so most share buckets with more images than there are centres."""
    monkeypatch.setattr(media, "WHOLE_ROUNDS", 3)
    rng = np.random.default_rng(8)
    images = []
    for _ in range(2):
        p = picture(rng)
        for _ in range(24):
            top, left = rng.integers(0, 13, 2)
            images.append(np.clip(p[top : top + 84, left : left + 84] * rng.uniform(0.8, 1.1) + rng.normal(0, 3, (84, 84)), 0, 255).astype(np.uint8))
    found = descriptors.describe(np.stack(images))
    component = list(range(len(images)))
    for b in range(len(images)):
        for a in range(b):
            if component[a] != component[b] and descriptors.inliers(found[a], found[b]) >= descriptors.MIN_INLIERS:
                low, high = sorted((component[a], component[b]))
                component = [low if c == high else c for c in component]
    merges = len(images) - len(set(component))
    assert merges >= 40
    rows = [(k, descriptors.write_pgm(i)) for k, i in enumerate(images)]
    df = spark.createDataFrame(rows, "media_id long, image binary")
    for c in ("a", "node", "table", "key", "digest", "component"):
        df = df.withColumn(c, F.lit("x"))
    for centres in (media.CENTRES, None):
        got = {r.media_id: r.component_id for r in media.near_media(df, centres).collect()}
        assert all(component[k] == component[c] for k, c in got.items())
        assert len(images) - len(set(got.values())) >= 0.9 * merges


def test_links_beyond_the_centres_are_found(spark, monkeypatch):
    """Pictures drawn from vectors share buckets with many unrelated ones, so with one centre a bucket most links are beyond it."""
    monkeypatch.setattr(media, "WHOLE_ROUNDS", 2)
    rng = np.random.default_rng(13)
    x = rng.normal(size=(400, 64))
    x[200:280] = x[:80] + rng.normal(0, 0.08, (80, 64))
    df = media.draw_embeddings(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], VECTORS))
    want = sorted(tuple(r) for r in media.near_media(df, None).collect())
    assert sum(not kept for *_, kept in want) >= 60
    assert sorted(tuple(r) for r in media.near_media(df, 1).collect()) == want
    rows = media._features(df).selectExpr("media_id AS node", "media_id % 90 AS component", "places", "words", "media_id AS h", "0 AS block")
    block, found = media._Block(rows.toArrow()), []
    for votes, pairs in ((media.VOTES, media.PAIRS), (20, 500)):
        monkeypatch.setattr(media, "VOTES", votes)
        monkeypatch.setattr(media, "PAIRS", pairs)
        pieces = [*block.candidates(np.arange(150), np.arange(150, 400)), *block.candidates(np.arange(150), np.arange(150))]
        found.append({(a, b) for one, two in pieces for a, b in zip(one.tolist(), two.tolist(), strict=True)})
    assert found[0] == found[1] and found[0] and all(a < b and a % 90 != b % 90 for a, b in found[0])


def test_strong_crops_and_other_sizes(spark):
    """Halves, quarters, a turned quarter, both sizes; pictures of 192 pixels, and one beyond MOST_SIDE."""
    rng = np.random.default_rng(11)
    rows, family = [], []
    for k in range(12):
        p = descriptors.resize(rng.random((1, 24, 24)).astype(np.float32), 192, 192)[0] * 255
        sizes = [descriptors.resize(p[None], n, n)[0] for n in (96, 384)]
        for image in (p, p[10:146, 40:176], p[60:156, 30:126], np.rot90(p[60:156, 30:126]), *sizes):
            rows.append((len(rows), descriptors.write_pgm(np.rint(image))))
            family.append(k)
    wide = descriptors.resize(rng.random((1, 30, 50)).astype(np.float32), 600, 1000)[0] * 255
    for image in (wide, wide[100:500, 200:700]):
        rows.append((len(rows), descriptors.write_pgm(np.rint(image))))
        family.append(12)
    got = media.near_media(spark.createDataFrame(rows, "media_id long, image binary")).collect()
    assert all(family[r.media_id] == family[r.component_id] for r in got)
    assert sum(not r.kept for r in got) >= 0.95 * (len(rows) - 13)


def test_large_unrelated_images_do_not_link():
    rng = np.random.default_rng(12)
    images = [np.rint(descriptors.resize(rng.random((1, 24, 24)).astype(np.float32), 512, 512)) * 255 for _ in range(2)]
    images += [descriptors.resize(rng.random((1, 64, 64)).astype(np.float32), 512, 512) * 255 for _ in range(3)]
    found = [descriptors.describe(np.rint(i).astype(np.uint8))[0] for i in images]
    assert all(descriptors.inliers(found[a], found[b]) == 0 for a in range(5) for b in range(a))


def plain_inliers(one, two):
    """The comparison of two images, written for a single pair."""
    if len(one[0]) < descriptors.MIN_INLIERS or len(two[0]) < descriptors.MIN_INLIERS:
        return 0
    bits = [np.unpackbits(f[4].view(np.uint8), axis=1).astype(np.int16) for f in (one, two)]
    far = np.abs(bits[0][:, None] - bits[1][None]).sum(axis=2)
    i = np.arange(len(one[0]))
    j = far.argmin(axis=1)
    good = (far.argmin(axis=0)[j] == i) & (far[i, j] <= descriptors.HAMMING)
    i, j = i[good], j[good]
    if len(i) < descriptors.MIN_INLIERS:
        return 0
    turn, grow = two[2][j] - one[2][i], two[3][j] / one[3][i]
    c, s = grow * np.cos(turn), grow * np.sin(turn)
    x, y, u, v = one[0][i], one[1][i], two[0][j], two[1][j]
    dx, dy = x[None, :] - x[:, None], y[None, :] - y[:, None]
    ex = u[:, None] + c[:, None] * dx - s[:, None] * dy - u[None, :]
    ey = v[:, None] + s[:, None] * dx + c[:, None] * dy - v[None, :]
    most = int((np.hypot(ex, ey) <= descriptors.TOLERANCE + 0.12 * grow[:, None] * np.hypot(dx, dy)).sum(axis=1).max())
    return most if most >= descriptors.LEAST_SHARE * len(i) else 0


def test_images_compared_together_match_as_pairs_do():
    """Equal counts for images of few and many corners, and none; pairs of small ones together take a fraction of the time."""
    rng = np.random.default_rng(21)
    sizes = [64] * 70 + [17, 20, 30, 96, 96, 130, 300, 300]
    images = [np.rint(descriptors.resize(rng.random((1, 8, 8)).astype(np.float32), n, n) * 255) for n in sizes]
    images += [np.rot90(i, axes=(1, 2)) for i in images[:10] + images[-4:]] + [np.full((1, 40, 40), 7.0)]
    found = [descriptors.describe(i)[0] for i in images]
    a, b = (v.ravel() for v in np.meshgrid(*[np.arange(len(images))] * 2))
    count = np.array([len(f[0]) for f in found])
    x, y, angle, scale, words = (np.concatenate(c) for c in zip(*found, strict=True))
    points, start = (x, y, angle, scale, list(np.ascontiguousarray(words.T))), np.cumsum(count) - count
    assert count.min() == 0 and count.max() > 128
    want = [plain_inliers(found[i], found[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert descriptors.many_inliers(points, start, count, a, b).tolist() == want and sum(n >= descriptors.MIN_INLIERS for n in want) > 100
    assert [descriptors.inliers(found[i], found[j]) for i, j in zip(a[:200], b[:200], strict=True)] == want[:200]
    assert descriptors.many_inliers(points, start, count, a[:0], b[:0]).tolist() == []
    small = np.flatnonzero((a < 70) & (b < 70))
    took = []
    for run in (lambda: [plain_inliers(found[i], found[j]) for i, j in zip(a[small].tolist(), b[small].tolist(), strict=True)], lambda: descriptors.many_inliers(points, start, count, a[small], b[small])):
        began = time.process_time()
        run()
        took.append(time.process_time() - began)
    assert took[1] < took[0] / 2.5


def test_blocks_in_rounds_find_what_one_block_does(spark, monkeypatch):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(240, 64))
    x[150:] = x[:90] + rng.normal(0, 0.08, (90, 64))
    nodes = media._features(media.draw_embeddings(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], VECTORS)))
    nodes = nodes.selectExpr("media_id AS node", "struct(places, words) AS f", "media_id % 200 AS component").where("size(f.words) > 0").cache()

    def classes(links):
        root = {k: k % 200 for k in range(240)}
        for a, b in links:
            low, high = sorted((root[a], root[b]))
            root = {k: low if c == high else c for k, c in root.items()}
        return root

    found = []
    for block, few, dealt in ((10**9, 1, 10**9), (1000, 8, 10**9), (1000, 8, 9000)):
        for name, value in (("BLOCK_POINTS", block), ("FEW_BLOCKS", few), ("ROUND_POINTS", dealt)):
            monkeypatch.setattr(media, name, value)
        found.append(classes(sorted(tuple(r) for r in media._across(nodes).collect())))
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) < 190


def test_images_that_cannot_link(spark):
    flat = descriptors.write_pgm(np.full((40, 40), 7))
    rows = [(1, None), (2, b""), (3, b"P5\n9"), (4, b"JPEG"), (5, flat), (6, flat), (None, flat), (7, descriptors.write_pgm(np.zeros((1, 3)))), (7, None)]
    got = media.near_media(spark.createDataFrame(rows, "media_id long, image binary")).collect()
    assert len(got) == len(rows) and all(r.n_points == 0 and r.kept and r.component_id == r.media_id for r in got)
    assert media.near_media(spark.createDataFrame([], "media_id long, image binary")).count() == 0
    drawn = media.draw_embeddings(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, None, 1), (3, [float("nan")], 1)], VECTORS)).collect()
    assert [r.image is None for r in drawn] == [False, True, True]


def test_long_numbers_and_narrow_images_are_borne(spark):
    digits = b"P5\n" + b"9" * 5000 + b" 3\n255\nabc"
    assert descriptors.read_pgm(digits) is None and descriptors.read_pgm(b"P5 1 1 " + b"0" * 5000) is None
    line = np.arange(4_000_000, dtype=np.uint8)
    images = [descriptors.write_pgm(line[None, :]), descriptors.write_pgm(line[:, None]), digits]
    tracemalloc.start()
    for raw in images[:2]:
        descriptors.describe(descriptors.read_pgm(raw)[None])
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    df = spark.createDataFrame(list(enumerate(map(bytearray, images))), "media_id long, image binary")
    assert {(r.media_id, r.n_points, r.component_id) for r in media.near_media(df).collect()} == {(k, 0, k) for k in range(3)}


def test_planted_copies_equal_the_sql(spark, tmp_path):
    """The given tables have no two vectors this near, so their SQL alone would show no link."""
    rows = [r for r in vectors(7, 300) if all(r[1])]
    x = np.array([v for _, v, _ in rows], dtype=np.float32)
    cosine = (x.astype(float) @ x.astype(float).T) / np.outer(*[np.linalg.norm(x.astype(float), axis=1)] * 2)
    assert (np.abs(cosine - 0.98) > 1e-9).all() and (np.triu(cosine, 1) >= 0.98).sum() > 50
    df = spark.createDataFrame(rows, VECTORS)
    pyarrow.parquet.write_table(df.toArrow(), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({embeddings.ORACLE_SQL})").fetchall()
    more = df.select("*", *[F.lit("x").alias(c) for c in ("node", "v", "n", "id", "cell", "times", "home", "least", "component")])
    got = embeddings.near_embeddings(more).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and sum(r[1] for r in want) > 50
