import random

from tessera.llm import minhash

from .helpers import ODD, clashing, frame


def sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts, k, percent=80):
    """Smallest id reachable over links among all pairs."""
    s = {i: sets(t, k) for i, t in texts.items()}
    reach = {i: i for i in texts}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(reach[a], reach[b])
            if reach[a] != low or reach[b] != low:
                reach[a] = reach[b] = low
                changed = True
    return reach, {i: len(x) for i, x in s.items()}


def corpus(seed, families=12, copies=9):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 12, 60, 200]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8]) * len(w) // 100 + rng.choice([0, 0, 1])):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(rng.choice([" ", "\n", "\t "]).join(w))
    return out


def check(spark, texts, k):
    rows = minhash.near_duplicates(frame(spark, [(i, t, "en", "s", 0) for i, t in texts.items()]), words=k).collect()
    reach, sizes = brute(texts, k)
    assert {r.doc_id: r.component_id for r in rows} == reach
    assert {r.doc_id: r.n_shingles for r in rows} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_components_equal_those_of_all_pairs(spark):
    check(spark, dict(enumerate(corpus(1))), 4)


def test_large_units_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS", 0)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    check(spark, dict(enumerate(corpus(2, families=5, copies=20))), 4)


def test_word_hashes_over_block_edges(monkeypatch):
    text = " ".join(f"Word{k}" for k in range(300)) + " É x " + "y" * 90
    whole = minhash.word_hashes(text)
    monkeypatch.setattr(minhash, "_BLOCK", 50)
    assert (minhash.word_hashes(text) == whole).all()
    assert whole.shape == (2, len(text.encode().split())) and len(set(whole[0].tolist())) == whole.shape[1]
    assert (minhash.word_hashes(text.encode().lower().decode()) == whole).all()


def test_densified_bins_estimate_similarity():
    signer = minhash._Signer()
    a, b = minhash.shingle_hashes(" ".join(map(str, range(60))), 4), minhash.shingle_hashes(" ".join(map(str, range(6, 66))), 4)
    a, b = a[0], b[0]
    exact = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs((signer.bins(a) == signer.bins(b)).mean() - exact) < 0.15


def test_odd_rows_and_empty_tables(spark):
    rows = minhash.near_duplicates(clashing(frame(spark, ODD))).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept
    assert by[None].component_id is None and by[None].kept
    assert by[6].component_id == 5 and not by[6].kept
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_words_made_to_collide_are_not_linked(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64 in any base."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    check(spark, {1: f"one two three {word}", 2: f"one two three {other}", 3: f"one two three {word}", 4: word[:32] + " x y z", 5: other[:32] + " x y z"}, 4)


def test_very_long_texts(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    edited = list(words)
    for k in range(0, len(words), 100):
        edited[k] = "edited"
    other = [f"v{rng.randrange(10**6)}" for _ in range(200_000)]
    check(spark, {1: " ".join(words), 2: " ".join(edited), 3: " ".join(other), 4: "x" * 2_000_000}, 4)


FAMILY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def test_ids_that_several_rows_share(spark):
    """Decisions are on texts: an id's other text stays, of equal rows one stays, null ids come last."""
    near = " ".join(FAMILY.split() * 8) + " end"
    rows = [(3, FAMILY), (7, FAMILY), (7, "another text of its own with some words"), (3, FAMILY), (8, near), (9, near + " now"), (9, "third text here with words")]
    rows += [(None, FAMILY), (None, "only under a null id and twice"), (None, "only under a null id and twice"), (2, ""), (2, "")]
    docs = frame(spark, [(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)])
    kept = minhash.keep_distinct(clashing(docs), words=4)
    assert kept.columns == clashing(docs).columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = [(3, FAMILY), (7, rows[2][1]), (8, near), (9, rows[6][1]), (None, rows[8][1]), (2, ""), (2, "")]
    assert got == sorted(want, key=str)
    by = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, words=4).collect()]
    want = [(3, 3, True), (7, 3, False), (7, 7, True), (3, 3, True), (8, 8, True), (9, 8, False), (9, 9, True), (None, 3, False)] + [(None, None, True)] * 2 + [(2, 2, True)] * 2
    assert sorted(by, key=str) == sorted(want, key=str)
    assert minhash.keep_distinct(frame(spark, [])).count() == 0


def test_texts_of_a_large_unit_go_to_few_groups(spark, monkeypatch):
    """Of a unit of many blocks with one node outside, each text goes to one group, and that node to all."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 100)
    units = spark.createDataFrame([(1, k, 1 if k < 60 else 60, 50) for k in range(1, 61)], "unit long, node long, component long, n_shingles long")
    large = spark.createDataFrame([(1, 60 * 50, 50)], "unit long, n_all long, n_out long")
    rows = minhash._unit_groups(units, large).collect()
    assert sum(not r.outside for r in rows) == 60 and sum(r.outside for r in rows) == 30
    assert {r.i for r in rows if r.outside} == set(range(30)) and {r.j for r in rows} == {0}
