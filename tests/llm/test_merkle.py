import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import merkle, ranks

from .helpers import ODD, clashing, frame


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        out.append(nodes)
    return out


def siblings(tree, k):
    path = []
    for nodes in tree[:-1]:
        low = k // 3 * 3
        path.append((k % 3, [d for i, d in enumerate(nodes[low : low + 3]) if i != k % 3]))
        k //= 3
    return path


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees.append(levels([leaf(*r) for r in by[s]]))
    top = levels([t[-1][0] for t in trees]) if trees else []
    out = []
    for j, s in enumerate(sources):
        for k, r in enumerate(by[s]):
            path = siblings(trees[j], k) + siblings(top, j)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            d = leaf(r[0], r[1].replace("\n", "") if even and r[1] is not None else r[1], *r[2:])
            for slot, others in path:
                d = h(*others[:slot], d, *others[slot:])
            proof = h(*[x for _, others in path for x in others])
            out.append((r[0], leaf(*r), trees[j][-1][0], top[-1][0], proof, d, d == top[-1][0]))
    return out


def check(spark, rows):
    got = merkle.merkle_manifest(clashing(frame(spark, rows)), merkle.without_newlines_where_even())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    plain = lambda x: sorted(map(repr, x))
    assert plain(tuple(r) for r in got.collect()) == plain(brute(rows))


def test_manifest_equals_a_plain_one(spark, monkeypatch):
    rng = random.Random(1)
    texts = [None, "", "a\nb", "é 😀", "\n", "plain"]
    rows = [(rng.randrange(400), rng.choice(texts), rng.choice([None, "en"]), rng.choice([None, "", "é", "z", "~", "😀", "hot", "hot", "hot"]), rng.choice([None, 3])) for _ in range(700)]
    rows += [(k, "x\ny", "en", f"lone{k}", 3) for k in range(12)] + [(5, "same\n", "en", "copies", 5)] * 40
    for levels in (8, 1, 2):  # all in one shuffle, and in many
        monkeypatch.setattr(merkle, "LEVELS", levels)
        check(spark, rows)
    monkeypatch.setattr(merkle, "PART_NODES", 10)
    check(spark, rows)


def test_odd_rows_and_small_tables(spark):
    check(spark, ODD)
    check(spark, ODD[:1])
    check(spark, ODD[4:6])
    check(spark, [(k, "a\n" * 500_000, "en", "s", 1) for k in range(3)])
    assert merkle.merkle_manifest(frame(spark, [])).count() == 0


def test_proofs_verify_and_alterations_do_not(spark):
    rows = [(k, f"text {k}", "en", f"s{k % 4}", 6) for k in range(50)]
    docs = frame(spark, rows)
    altered = F.when(F.col("doc_id") == 7, F.lit(None).cast("string")).when(F.col("doc_id") == 8, F.lit("other")).otherwise(F.col("text"))
    got = merkle.merkle_manifest(docs, altered, proofs=True).collect()
    assert {r.doc_id for r in got if not r.verified} == {7, 8}
    for r in got:
        d = r.leaf
        for slot, others in r.proof:
            d = h(*others[:slot], d, *others[slot:])
        assert d == r.root
    assert all(r.verified for r in merkle.merkle_manifest(docs).collect())


def test_ranks_in_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(9), k) for k in range(500)]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, x int, number int"), [F.desc("x"), F.asc("number")], ["g"], numbered=True).collect()
    want = {}
    for number, g in enumerate([None, "a", "b"]):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        want |= {r[2]: (k, len(mine), number) for k, r in enumerate(mine)}
    assert {r.number: (r["rank"], r.n, r.group) for r in got} == want
