import hashlib
import math
import random
import re
import zlib
from collections import Counter

from tessera.llm import resampling

from .helpers import ODD, clashing, frame

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def features(text, most):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def brute(rows, targets, most=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in rows for f in features(text, most)[1])
    t = Counter(bucket(f) for text in targets for f in features(text, most)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for doc_id, text in rows:
        words, found = features(text, most)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


def texts(rng, n):
    words = [*"abcdefgh", "straße", "É", "ZOO", "x1", "東京", "y" * 40]
    marks = [" ", "-", "\n", ", ", "_", " "]
    return ["".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.choice([0, 1, 5, 19, 20, 21, 60]))) for _ in range(n)]


def test_ranks_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = list(enumerate(texts(rng, 300))) + [(7, "a b " * 30)] * 5 + [(None, "c d e " * 20)] * 3 + [(900, None), (901, "--- ...")]
    targets = [*texts(rng, 20), None, "only here"]
    docs = clashing(frame(spark, [(i, t, "en", "s", 0) for i, t in rows]))
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    for most, buckets in ((1, 10_000), (1, 5), (3, 50)):
        got = resampling.importance_ranks(docs, target, most=most, buckets=buckets)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert plain(got.collect()) == plain(brute(rows, targets, most, buckets))


def test_blocks_count_tuples():
    block = resampling._Block(3)
    block.add(1, None, b"A b a b, a", 3)
    block.add(2, None, b"b", 3)
    longer = {tuple(block._parts(list(block.longer), k)): block.totals[-1 - k] for k in range(len(block.longer))}
    assert list(block.words) == [b"a", b"b"] and block.totals[0] == 3 and block.totals[1] == 3
    assert longer == {(0, 1): 2, (1, 0): 2, (0, 1, 0): 2, (1, 0, 1): 1}


def test_drawn_rows_keep_their_columns(spark):
    rng = random.Random(3)
    rows = [(i, f"{t} and one word more " * 5, "en", f"s{i}", i) for i, t in enumerate(texts(rng, 120))]
    target = spark.createDataFrame([("and one word",)], "text string")
    got = resampling.resample(clashing(frame(spark, rows)), target, percent=25).collect()
    want = {r[0] for r in brute([r[:2] for r in rows], ["and one word"], percent=25) if r[4]}
    assert {r.doc_id for r in got} == want and len(got) == 30
    assert all(r.text == rows[r.doc_id][1] and r.source == f"s{r.doc_id}" and r.rank == "x5" for r in got)


def test_odd_rows_long_texts_and_empty_tables(spark):
    target = spark.createDataFrame([("the same words",)], "text string")
    none = target.limit(0)
    got = resampling.importance_ranks(clashing(frame(spark, ODD)), target, percent=100, least_words=1)
    assert plain(got.collect()) == plain(brute([r[:2] for r in ODD], ["the same words"], percent=100, least=1))
    long = [(1, "word " * 700_000, "", "", 0), (2, "x" * 3_000_000, "", "", 0), (3, "é" * 10, "", "", 0)]
    got = resampling.importance_ranks(frame(spark, long), none, percent=100)
    assert plain(got.collect()) == plain(brute([r[:2] for r in long], [], percent=100))
    assert resampling.importance_ranks(frame(spark, []), target).count() == 0


def test_long_texts_are_numbered_in_slices(monkeypatch):
    text = b"one two three two one " * 100
    whole = resampling._word_ids(text, resampling._Numbers())
    monkeypatch.setattr(resampling, "SLICE_BYTES", 7)
    assert (resampling._word_ids(text, resampling._Numbers()) == whole).all() and len(whole) == 500
