import os
import random

import corpus_pipeline
from tessera.llm.components import connected_components
from tessera.llm.scratch import shared_folder

from .helpers import ODD, clashing, frame

TESTDATA = "/root/testdata/sf0.001"


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(0)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(3, 3), (5, 4), (4, 5), (5, 4)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    docs = docs.unionByName(frame(spark, [(900_001, "the and with token = abcdef0123456789 of the", "en", "src1", 44)]))
    columns, dtypes, counts = docs.columns, docs.dtypes, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, TESTDATA)
        assert docs.columns == columns and docs.dtypes == dtypes, name
        counts.append(docs.count())
    assert counts[0] == counts[1] > counts[2] == counts[3] <= counts[4]
    assert {r.text for r in docs.where("doc_id = 900001").collect()} == {"the and with [REDACTED] of the"}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, TESTDATA)
    assert packed.where("start = 0").count() == counts[4]


def test_a_run_leaves_its_result_alone(spark):
    folder = shared_folder(spark).removeprefix("file://") + "/tessera"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = corpus_pipeline.run(spark, TESTDATA)
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["run"]
    assert rows.where("start = 0").count() > 100


def test_stages_bear_odd_rows_and_empty_tables(spark):
    for rows in (ODD, []):
        docs = clashing(frame(spark, rows))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, TESTDATA)
            assert docs.columns == clashing(frame(spark, [])).columns
        # one row of each text, for rows alike in id and text are copies too
        assert corpus_pipeline.pack(spark, docs, TESTDATA).count() == len({r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])})


def test_near_dedup_keeps_texts_of_ids_that_go(spark):
    copy, other = "one two three four five six seven eight", "quite another text under an id that goes"
    docs = frame(spark, [(3, copy, "en", "a", 0), (7, copy, "en", "b", 0), (7, other, "en", "c", 0), (3, copy, "en", "d", 0), (None, copy, "en", "e", 0), (None, other + "!", "en", "f", 0)])
    kept = corpus_pipeline.near_dedup(spark, docs, TESTDATA).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(3, copy), (7, other)]
    assert [r.text for r in kept if r.doc_id is None] == [other + "!"]
