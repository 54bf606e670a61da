import hashlib
import math
import operator
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.aggregates import check_digits, geometric_mean
from tessera.functions.columns import cosine, dot, gathered_schema, variant_path
from tessera.operators.graphs import reached
from tessera.operators.inequality import SortedRuns, inequality_join
from tessera.operators.joins import asof_join, place_among, quantile_bounds, range_join, salted_join
from tessera.operators.windows import exact_percentile, sessionize, stratified_sample, top_k
from tessera.plans import relational
from tessera.sources.files import read_table, write_table
from tessera.streaming.events import count_by_window, first_seen, run_to_end
from tessera.streaming.sessions import sessions_by_silence, sessions_to_outcome

T0 = datetime(2024, 1, 1)


def test_asof_takes_ties_and_leaves_nulls(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), (None, 9, 4), ("a", None, 5)], "k string, t int, i int")
    right = spark.createDataFrame([("a", 5, 10), ("a", 5, 11), ("a", 3, 12), (None, 1, 13), ("a", None, 14)], "k string, t int, v int")
    got = {r.i: r.asof_v for r in asof_join(left, right, "k", "t", "t", ["v"]).collect()}
    assert got == {1: 11, 2: None, 3: None, 4: None, 5: None}


def test_asof_of_one_hot_key_is_many_tasks(spark):
    rng = random.Random(1)
    when = lambda: rng.choice([T0, T0 + timedelta(seconds=rng.randrange(500))])  # noqa: E731  a third of all times is one
    left = [(rng.choice(["hot"] * 9 + ["cold", "alone", None]), rng.choice([None] + [when()] * 30), i) for i in range(700)]
    right = [(rng.choice(["hot"] * 9 + ["cold", None]), rng.choice([None] + [when()] * 30), rng.choice([None, i])) for i in range(300)]
    want = {}
    for k, t, i in left:
        before = [(s, v is not None, v or 0, v) for key, s, v in right if key == k and k and s and t and s <= t]
        want[i] = max(before)[3] if before else None
    for kind in ("timestamp", "timestamp_ntz", "long"):
        cast = F.col("t").cast("timestamp").cast(kind)
        a = spark.createDataFrame(left, "k string, t timestamp, i int").withColumn("t", cast)
        b = spark.createDataFrame(right, "k string, u timestamp, v int").withColumn("u", F.col("u").cast("timestamp").cast(kind))
        for ranges in (1, 2, 16, 200):
            got = asof_join(a, b, "k", "t", "u", ["v"], ranges).collect()
            assert len(got) == len(left) and {r.i: r.asof_v for r in got} == want, (kind, ranges)
    places = a.select(place_among(F.col("t"), quantile_bounds(a, 16), False).alias("p")).groupBy("p").count().collect()
    assert len(places) > 8
    assert asof_join(a.limit(0), b, "k", "t", "u", ["v"]).count() == 0
    assert asof_join(a, b.limit(0), "k", "t", "u", ["v"]).where("asof_v IS NULL").count() == len(left)


def test_exact_percentiles_in_rounds(spark):
    rng = random.Random(2)
    nan = float("nan")
    groups = {"even": list(range(1000)), "ties": [7] * 900 + list(range(50)), "two": [1, 2], "one": [5], None: [3] * 30 + [4] * 31, "wild": [rng.gauss(0, 1e9) for _ in range(777)]}
    groups |= {"nans": [1.0, 2.0] + [nan] * 3}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("even", None), ("empty", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double")
    for share in (0.0, 0.5, 0.9, 1.0):
        want = {}
        for g, xs in groups.items():
            xs, at = sorted(map(float, xs), key=lambda x: (math.isnan(x), x)), (len(xs) - 1) * share
            a, b = xs[math.floor(at)], xs[math.ceil(at)]
            want[g] = a if a == b or math.floor(at) == math.ceil(at) else (math.ceil(at) - at) * a + (at - math.floor(at)) * b
        for few, grid in ((50_000, 256), (20, 8), (0, 4)) if share == 0.5 else ((20, 8),):
            got = {r.g: r.percentile for r in exact_percentile(df, "g", "x", share, few, grid).collect()}
            assert got.keys() == want.keys()
            assert all(math.isclose(got[g], x, rel_tol=1e-12) or math.isnan(got[g]) and math.isnan(x) for g, x in want.items()), (share, few)
    assert exact_percentile(df.limit(0), "g", "x", 0.5).count() == 0


def test_range_join_equals_a_loop(spark):
    points = [(k, k * 0.37 - 9) for k in range(80)]
    ranges = [(k, k * 0.9 - 12, k * 0.9 - 12 + (k % 7)) for k in range(30)]
    p, r = spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(ranges, "j int, low double, high double")
    got = {(a.i, a.j) for a in range_join(p, r, "x", "low", "high", 2.5).collect()}
    assert got == {(i, j) for i, x in points for j, lo, hi in ranges if lo <= x < hi}


def test_long_ranges_are_few_rows(spark):
    points = [(k, k * 1.7 - 50) for k in range(120)] + [(999, None)]
    ranges = [(k, -60 + k * 3.3, -60 + k * 3.3 + length) for k, length in enumerate([0.5, 1, 2, 1e3, 1e9, 3e7, 0, -1] * 5)] + [(99, None, 1.0), (98, 1.0, None)]
    p, r = spark.createDataFrame(points, "i int, x double"), spark.createDataFrame(ranges, "j int, low double, high double")
    out = range_join(p, r, "x", "low", "high", 1.0)
    want = sorted((i, j) for i, x in points for j, lo, hi in ranges if None not in (x, lo, hi) and lo <= x < hi)
    assert sorted((a.i, a.j) for a in out.collect()) == want
    assert range_join(p, r.limit(0), "x", "low", "high", 1.0).count() == range_join(p.limit(0), r, "x", "low", "high", 1.0).count() == 0


def test_salted_join_keeps_every_pair(spark):
    large = spark.createDataFrame([("hot", k) for k in range(50)] + [("cold", 99)], "k string, v int")
    small = spark.createDataFrame([("hot", "x"), ("cold", "y"), ("none", "z")], "k string, w string")
    got = sorted((r.k, r.v, r.w) for r in salted_join(large, small, ["k"], 4, F.col("v")).collect())
    assert got == sorted([("hot", k, "x") for k in range(50)] + [("cold", 99, "y")])


def test_sessions_and_top_k(spark):
    rows = [("u", T0 + timedelta(seconds=s)) for s in (0, 10, 10, 100, 105)]
    got = [r.session for r in sessionize(spark.createDataFrame(rows, "u string, t timestamp"), "u", "t", 30).orderBy("t").collect()]
    assert got == [1, 1, 1, 2, 2]
    rng = random.Random(8)
    rows = [(k, rng.choice(["hot"] * 9 + ["cold", None]), T0 + timedelta(seconds=rng.choice([rng.randrange(9000), 300]))) for k in range(400)]
    want, last = {}, {}
    for k, u, t in sorted(rows, key=lambda r: r[2]):
        before, number = last.get(u, (None, 0))
        want[k] = number + (before is None or (t - before).total_seconds() > 30)
        last[u] = t, want[k]
    df = spark.createDataFrame(rows, "k int, u string, t timestamp")
    for ranges in (1, 3, 64):
        got = sessionize(df, "u", "t", 30, ranges).collect()
        assert {r.k: r.session for r in got} == want and len(got) == 400
    assert sessionize(df.limit(0), "u", "t", 30).count() == 0
    df = spark.createDataFrame([("a", k) for k in range(40)] + [("b", 1)], "g string, v int")
    got = sorted((r.g, r.v, r["rank"]) for r in top_k(df, ["g"], [F.desc("v")], 2).collect())
    assert got == [("a", 38, 2), ("a", 39, 1), ("b", 1, 1)]


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [0.0, 0.0])], "x array<float>, y array<float>, z array<float>")
    d, c, n = row.select(dot(F.col("x"), F.col("y")), cosine(F.col("x"), F.col("x")), cosine(F.col("x"), F.col("z"))).first()
    assert d == 11 and abs(c - 1) < 1e-12 and n is None


def test_files_round_trip_and_prune(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (3, None, 2.5)], "i int, s string, x double")
    for fmt in ("parquet", "orc", "json", "csv"):
        write_table(df, str(tmp_path / fmt), fmt)
        assert sorted(read_table(spark, str(tmp_path / fmt), fmt, df.schema).collect(), key=lambda r: r.i) == df.collect()
    write_table(df, str(tmp_path / "dealt"), "parquet", ["s"])
    plan = read_table(spark, str(tmp_path / "dealt")).where("s = 'a' AND x > 1").select("i")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(s" in plan and "GreaterThan(x,1.0)" in plan and "ReadSchema: struct<i:int,x:double>" in plan


def stream_of(spark, path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_events_are_dropped_and_repeats_counted_once(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string"
    at = lambda h: T0 + timedelta(hours=h)
    batches = [[(1, at(1), "x")], [(2, at(30), "x")], [(2, at(30), "x")], [(3, at(2), "x")], [(4, at(60), "x")], [(5, at(90), "x")]]
    stream = stream_of(spark, str(tmp_path / "in"), batches, schema).withWatermark("ts", "1 hour")
    windows = run_to_end(count_by_window(stream, "1 day"), "append").collect()
    assert {r.window.start.day: r.n for r in windows} == {1: 1, 2: 2, 3: 1}
    again = stream_of(spark, str(tmp_path / "again"), batches, schema).withWatermark("ts", "1 hour")
    seen = [r.event_id for r in run_to_end(first_seen(again), "append").collect()]
    assert sorted(seen) == [1, 2, 4, 5]


def test_late_events_merge_sessions_and_too_late_ones_go(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    # u: 0 and 50 are two sessions until 25 connects them; at 500 both are over; 10 comes too late
    batches = [[("u", at(0))], [("u", at(50))], [("u", at(25)), ("v", at(40))], [("w", at(500))], [("w", at(505))], [("u", at(10))], [("w", at(900))]]
    stream = stream_of(spark, str(tmp_path / "in"), batches, "u string, ts timestamp").withWatermark("ts", "1 hour")
    got = {(r.u, r.began, r.ended, r.n) for r in run_to_end(sessions_by_silence(stream, "u", "ts", "30 minutes"), "append").collect()}
    assert got == {("u", at(0), at(80), 3), ("v", at(40), at(70), 1), ("w", at(500), at(535), 2)}
    table = spark.createDataFrame([x for b in batches for x in b], "u string, ts timestamp")
    assert sessions_by_silence(table, "u", "ts", "30 minutes").count() == 4


def test_sessions_to_an_outcome_and_their_state(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    schema = "number long, u string, ts timestamp, kind string"
    batches = [
        [(1, "u", at(5), "view"), (2, "u", at(0), "view")],
        [(3, "u", at(20), "buy"), (4, "u", at(10), "view"), (5, "u", at(21), "view"), (6, "v", at(30), "view"), (7, None, at(30), "view")],
        [(8, "w", at(300), "view")],
        [(12, "w", at(305), "view")],  # what is late is known from the batch before
        [(9, "u", at(22), "buy"), (10, "w", at(310), "buy")],  # 9 is too late
        [(11, "x", at(900), "view")],
    ]
    stream = stream_of(spark, str(tmp_path / "in"), batches, schema).withWatermark("ts", "1 hour")
    found = run_to_end(sessions_to_outcome(stream, "u", "ts", "kind", "number", 1800, "buy"), "append", rocksdb=True)
    got = {(r.u, r.began, r["last"], r.n, r.by_outcome) for r in found.collect()}
    want = {("u", at(0), at(20), 4, True), ("u", at(21), at(21), 1, False), ("v", at(30), at(30), 1, False), ("w", at(300), at(310), 3, True)}
    assert got == want
    # what is over has left neither state nor timers: x alone is there
    folder = found.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file://") + "-state"
    for name in ("waiting", "open"):
        rows = spark.read.format("statestore").option("stateVarName", name).load(folder)
        assert {r.key.by for r in rows.select("key").collect()} == ({"x"} if name == "waiting" else set())


def test_what_waits_is_one_value_a_key_and_null_numbers_come_first(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [[(None, "u", at(0), "buy"), (1, "u", at(0), "view")], [(k, "w", at(300 + k), "view") for k in range(20)]]
    stream = stream_of(spark, str(tmp_path / "in"), batches, "number long, u string, ts timestamp, kind string").withWatermark("ts", "1 hour")
    found = run_to_end(sessions_to_outcome(stream, "u", "ts", "kind", "number", 1800, "buy"), "append", rocksdb=True)
    assert {tuple(r) for r in found.collect()} == {("u", at(0), at(0), 1, True), ("u", at(0), at(0), 1, False)}
    folder = found.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file://") + "-state"
    assert spark.read.format("statestore").option("stateVarName", "waiting").load(folder).count() == 1



@pytest.mark.parametrize("ops", [("<", ">"), ("<=", "<"), (">", ">="), (">=", "<=")])
def test_inequality_join_equals_a_loop(spark, ops):
    rng = random.Random(4)
    nan = float("nan")
    draw = lambda: rng.choice([None, nan, 5.0] + [rng.randrange(30) / 2 for _ in range(20)])
    left, right = ([(k, draw(), rng.choice([None, 3] + [rng.randrange(20) for _ in range(9)])) for k in range(n)] for n in (300, 230))
    left += [(300, 5.0, 3)] * 80  # rows that are alike, more than a block holds
    l = spark.createDataFrame(left, "i int, a double, c int")  # noqa: E741
    r = spark.createDataFrame(right, "j int, b double, d int").withColumn("d", F.col("d").cast("long"))
    tests = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
    rank = lambda x: (math.isnan(x), 0 if math.isnan(x) else x)
    want = sorted((i, j) for i, a, c in left for j, b, d in right if None not in (a, b, c, d) and tests[ops[0]](rank(a), rank(b)) and tests[ops[1]](c, d))
    for block in (16_384, 20):
        out = inequality_join(l, r, ("a", ops[0], "b"), ("c", ops[1], "d"), block)
        assert out.columns == ["i", "a", "c", "j", "b", "d"]
        assert sorted((x.i, x.j) for x in out.collect()) == want
        assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    assert inequality_join(l.limit(0), r, ("a", ops[0], "b"), ("c", ops[1], "d")).count() == 0
    assert inequality_join(l, r.limit(0), ("a", ops[0], "b"), ("c", ops[1], "d")).count() == 0


def test_short_intervals_are_dealt_to_few_places(spark, monkeypatch):
    """However many rows there are, one meets few blocks of others where only neighbours can overlap."""
    n = 4000
    rows = [(k, 3.0 * k, 3.0 * k + 1 + k % 5) for k in range(n)]
    l, r = spark.createDataFrame(rows, "k long, a double, c double"), spark.createDataFrame(rows, "m long, b double, d double")
    dealt, repartition = [], type(l).repartition
    monkeypatch.setattr(type(l), "repartition", lambda df, *by: (dealt.append(df.count()), repartition(df, *by))[1])
    out = inequality_join(l, r, ("a", "<", "d"), ("c", ">", "b"), 20).select("k", "m")
    want = {(k, m) for k in range(n) for m in range(max(k - 2, 0), min(k + 3, n)) if 3 * k < 3 * m + 1 + m % 5 and 3 * k + 1 + k % 5 > 3 * m}
    assert sorted(tuple(x) for x in out.collect()) == sorted(want)
    assert len(dealt) == 1 and dealt[0] <= 12 * n


def test_a_third_condition_and_chosen_columns(spark):
    """Tested before pairs leave their task; null and NaN as in the others."""
    rng = random.Random(9)
    nan = float("nan")
    left, right = ([(k, rng.randrange(40), rng.randrange(40), rng.choice([None, nan, *range(6)])) for k in range(n)] for n in (150, 120))
    as_double = lambda rows: [(*r[:3], None if r[3] is None else float(r[3])) for r in rows]
    l = spark.createDataFrame(as_double(left), "i int, a int, c int, e double")  # noqa: E741
    r = spark.createDataFrame(as_double(right), "j int, b int, d int, f double")
    rank = lambda x: (math.isnan(x), 0 if math.isnan(x) else x)
    for op, test in (("<", operator.lt), (">=", operator.ge)):
        want = sorted((j, c, i) for i, a, c, e in left for j, b, d, f in right if None not in (e, f) and a < b and c >= d and test(rank(e), rank(f)))
        for block in (16_384, 20):
            out = inequality_join(l, r, ("a", "<", "b"), ("c", ">=", "d"), block, also=("e", op, "f"), columns=["j", "c", "i"])
            assert out.columns == ["j", "c", "i"] and sorted(tuple(x) for x in out.collect()) == want and want


def test_pairs_of_copies_are_written_small(spark, tmp_path, monkeypatch):
    """Many users' sessions at the same times: what is written of a session's pairs resembles the next one's, so it takes few bytes; and
    sessions are made once for both sides."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").crossJoin(spark.range(100).withColumnRenamed("id", "copy"))
    events.withColumn("user_id", F.col("user_id") + 100_000 * F.col("copy")).drop("copy").write.parquet(f"{tmp_path}/events.parquet")
    sides = []
    monkeypatch.setattr(relational, "inequality_join", lambda *args, **more: (sides.extend(args[:2]), inequality_join(*args, **more))[1])
    out = relational.sessions_at_one_time(spark, str(tmp_path))
    assert len(sides) == 2 and not any("Window" in s._jdf.queryExecution().toString() for s in sides)
    out.write.parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert n > 100_000 and sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.7 * n


def test_sorted_runs_find_what_is_below():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 7, 64, 100):
        values, starts, limits = rng.integers(0, 20, n), rng.integers(0, n + 1, 50), rng.integers(0, 25, 50)
        got = [(i, j) for rows, places in SortedRuns(values).below(starts, limits) for i, j in zip(rows, places, strict=True)]
        assert sorted(got) == [(i, j) for i in range(50) for j in range(starts[i], n) if values[j] < limits[i]]


def test_nodes_reached_in_fewest_steps(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(1, 2), (2, 3), (3, 1), (1, 1), (None, 4), (4, None)] + [(200, k) for k in range(300, 340)]
    starts = [1, 1, 77, None, 200]
    want, frontier = {s: 0 for s in starts if s is not None}, {1, 77, 200}
    while frontier:
        frontier = {b for a, b in edges if a in frontier and b is not None} - want.keys()
        want |= dict.fromkeys(frontier, max(want.values()) + 1)
    e = spark.createDataFrame(edges, "src int, dst int")
    s = spark.createDataFrame([(x,) for x in starts], "node int")
    for most in (None, 0, 2):
        got = reached(s, e, most).collect()
        assert {r.node: r.steps for r in got} == {n: k for n, k in want.items() if most is None or k <= most} and len(got) == len({r.node for r in got})
    assert reached(s.limit(0), e).count() == 0


def test_stratified_samples_are_the_smallest_digests(spark):
    rows = [(k % 3 if k % 7 else None, k if k % 50 else None, f"x{k}") for k in range(400)] + [(0, 5, "again")] * 3
    df = spark.createDataFrame(rows, "g int, i int, s string")
    digest = lambda i: hashlib.md5(f"seed{'' if i is None else i}".encode()).hexdigest()
    want = []
    for g in (None, 0, 1, 2):
        want += sorted((r for r in rows if r[0] == g), key=lambda r: (digest(r[1]), r[2]))[:20]
    got = stratified_sample(df, ["g"], "i", 20, "seed").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert stratified_sample(df, ["g"], "i", 1000).count() == len(rows) and stratified_sample(df.limit(0), ["g"], "i", 3).count() == 0


def test_variants_keep_nested_values_and_gather_a_schema(spark):
    texts = ['{"a": {"b": [1, {"c": "x"}]}, "k": 1}', '{"k": 2.5}', '{"a": null, "k": "z"}', None, "[]", "17"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(variant_path("t", "$.a.b[1].c", "string").alias("c"), variant_path("t", "$.k", "double").alias("k"), "t")
    assert [(r.c, r.k) for r in df.collect()] == [("x", 1.0), (None, 2.5)] + [(None, None)] * 4
    kind = gathered_schema(df.where("t LIKE '{%'"), "t")
    assert kind == "OBJECT<a: OBJECT<b: ARRAY<VARIANT>>, k: VARIANT>"


def test_theta_sketches_intersect_and_unite(spark):
    df = spark.range(60_000).selectExpr("id", "id % 2 = 0 AS even", "id % 3 = 0 AS third")
    one, two = (df.where(c).agg(F.theta_sketch_agg("id").alias(c)) for c in ("even", "third"))
    row = one.join(two).select(F.theta_sketch_estimate(F.theta_intersection("even", "third")), F.theta_sketch_estimate(F.theta_union("even", "third"))).first()
    assert abs(row[0] - 10_000) < 1_000 and abs(row[1] - 40_000) < 2_000


def test_lateral_takes_the_first_rows_of_each(spark):
    left = spark.createDataFrame([(1,), (2,), (3,), (1,)], "a int")
    right = spark.createDataFrame([(k % 3, k) for k in range(12)] + [(None, 99)], "b int, v int")
    inner = right.where(F.col("b") == F.col("a").outer()).orderBy(F.desc("v")).limit(2).select("v")
    assert sorted((r.a, r.v) for r in left.lateralJoin(inner).collect()) == sorted([(1, 10), (1, 7)] * 2 + [(2, 11), (2, 8)])


def test_own_aggregates_add_up_over_batches(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, -1.0, 2.0, 8.0]), rng.choice([None, 1, 3])) for _ in range(500)] + [("none", -1.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, q int").repartition(7)
    want = {}
    for g in ("a", "b", None, "none"):
        mine = [(v, q) for h, v, q in rows if h == g and q and v is not None and v > 0]
        want[g] = math.exp(sum(q * math.log(v) for v, q in mine) / sum(q for _, q in mine)) if mine else None
    got = {r.g: r["mean"] for r in geometric_mean(df, "g", "v", "q").collect()}
    assert got.keys() == want.keys() and all(x is None and got[g] is None or math.isclose(got[g], x) for g, x in want.items())
    assert geometric_mean(df.limit(0), "g", "v", "q").count() == 0


def test_check_digits(spark):
    numbers = [0, 1, 97, 123456789, -5, None]
    got = [r.d for r in spark.createDataFrame([(n,) for n in numbers], "n long").select(check_digits("n").alias("d")).collect()]
    assert got[4:] == [None, None] and all((n * 100 + d) % 97 == 1 for n, d in zip(numbers[:4], got[:4], strict=True))
