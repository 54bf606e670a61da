import hashlib
import random
import re
import time

import duckdb
import pyarrow
import pyarrow.parquet
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import secrets

from .helpers import ODD, clashing, frame

KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = [
    ("assign", re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p, good) in enumerate(BASE) for m in p.finditer(text or "") if good(m)]
    return [f"{name}:{s}:{e}" for s, _, e, name in sorted(found)]


PARTS = ["token=", "Token: ", "secret='", "api_key=", "apikey = ", "abc", "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é", "😀", " ", "\n", "=", ":", "password", "https://x.y/z", "10.0.0.1", "user_id=joe"]


def test_base_spans_equal_a_plain_search(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(400)] + ["secret=token: abcdefgh", "a" * 5000 + "token=abcdefg"]
    rows = secrets.scan_secrets(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r.spans.split(","))


def test_weak_parts_need_a_complement(spark):
    near = "user_id = joe at 10.1.2.3 with token = abcdef0123"
    far = "user_id = joe at 10.1.2.3" + " word" * 100 + " token = abcdef0123"
    alone = "user_id = joe and https://host/path"
    docs = frame(spark, [(1, near, "", "", 0), (2, far, "", "", 0), (3, alone, "", "", 0)])
    spans = {r.doc_id: r.spans for r in secrets.scan_secrets(docs).collect()}
    assert [x.split(":")[0] for x in spans[1].split(",")] == ["identifier", "endpoint", "assign"]
    assert [x.split(":")[0] for x in spans[2].split(",")] == ["assign"]
    assert spans[3] == ""


def test_a_long_url_alone_is_no_finding(spark):
    url = "https://example.org/wiki/Category2024_Archive"
    texts = [url, f"{url} and {url}", "https://example.org/x?sig=" + "Abc123" * 5, "https://u:" + "Abc123" * 5 + "@example.org/x", f"user_id = joe of {url}", "user_id = " + "Abc123" * 5]
    docs = frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])
    spans = {r.doc_id: [x.split(":")[0] for x in r.spans.split(",") if x] for r in secrets.scan_secrets(docs).collect()}
    assert [spans[i] for i in (0, 1, 4, 5)] == [[]] * 4
    assert sorted(spans[2]) == sorted(spans[3]) == ["endpoint", "material"]
    out = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    assert [out[i] for i in (0, 1, 4, 5)] == [texts[i] for i in (0, 1, 4, 5)] and out[2] == out[3] == "[REDACTED]"


def test_redaction_replaces_spans_once(spark):
    text = "é before token = abcdef0123456789abcdef01 after"
    docs = frame(spark, [(1, text, "en", "a", len(text)), (2, "clean", "en", "a", 5)])
    out = {r.doc_id: r for r in secrets.redact_secrets(clashing(docs)).collect()}
    assert out[1].text == "é before [REDACTED] after" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "clean" and out[2].n_chars == 5 and out[2].node == "x0"


def test_long_texts_and_ids_that_rows_share(spark):
    line = "é word user_id = joe at 10.1.2.3 with token = abcdef0123 and 0123456789abcdef01234567, 😀\n"
    long = "lead " + line * 3000 + "x" * 5000
    rows = [(1, long), (1, line), (None, line), (None, line), (None, "secret: abcdefgh"), (2, None), (2, "")]
    docs = frame(spark, [(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)])
    found = secrets.scan_secrets(docs).collect()
    assert found[0].__fields__ == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_weak"]
    want = sorted((str(i), hashlib.sha256(",".join(brute(t)).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in found) == want
    assert max(r.n_weak for r in found) == 6000
    out = {r.source: r.text for r in secrets.redact_secrets(docs).collect()}
    marked = line.replace("user_id = joe", "#").replace("10.1.2.3", "#").replace("token = abcdef0123", "#").replace("0123456789abcdef01234567", "#").replace("#", "[REDACTED]")
    assert out["s0"] == "lead " + marked * 3000 + "x" * 5000
    assert out["s1"] == out["s2"] == out["s3"] == marked and out["s4"] == "[REDACTED]" and out["s5"] is None and out["s6"] == ""


def test_odd_rows_and_empty_tables(spark):
    rows = secrets.scan_secrets(clashing(frame(spark, ODD))).collect()
    assert len(rows) == len(ODD)
    assert sum(r.n_assign for r in rows) == 1 and all(r.spans == "" for r in rows if r.doc_id is not None)
    assert secrets.scan_secrets(frame(spark, [])).count() == 0
    assert secrets.redact_secrets(frame(spark, ODD)).count() == len(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_patterns_for_spark_and_for_the_plain_search_agree(text):
    """The patterns themselves, in Python's engine: short runs of access and hex are left to the search."""
    for kind, pattern, group, tests in secrets.BASE:
        plain = next(x for x in BASE if x[0] == kind)
        want = [m.span() for m in plain[1].finditer(text) if plain[2](m)]
        assert [m.span() for m in re.finditer(pattern, text) if all(re.search(t, m[group]) for t in tests)] == want


def test_long_runs_of_digits_and_dots(spark):
    """They cost what as many letters do: no stack, no running back."""

    def seconds(texts):
        docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
        began = time.perf_counter()
        spans = {r.doc_id: r.spans for r in secrets.scan_secrets(docs).collect()}
        out = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
        assert all(out[i] == t for i, t in enumerate(texts) if not spans[i])
        return spans, time.perf_counter() - began

    n = 1_000_000
    seconds(["warm up 10.0.0.1"])
    _, letters = seconds(["ab" * n, "a" * n])
    spans, took = seconds(["1." * n + "1", "1" * n])
    assert took < 2 * letters + 5
    assert spans[0] == "" and [s.split(":")[0] for s in spans[1].split(",")] == ["hex"]
    text = "user_id = joe of 10.1.2.3. token = abcdef0123"
    assert "endpoint:17:25" in seconds([text])[0][0]


def test_sql_and_query_agree_on_overlapping_parts(spark, tmp_path):
    """The SQL over texts that the given tables lack: parts within parts, and endpoints with users and queries."""
    rng = random.Random(5)
    more = ["https://u:Abc123Abc123Abc123Abc123@h/", "?sig=", "Abc123" * 5, "/", "https://example.org/wiki/Category2024_Archive", "1.2.3.4.", " " * 90]
    texts = ["".join(rng.choice(PARTS + more) for _ in range(rng.randrange(12))) for _ in range(500)]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    pyarrow.parquet.write_table(pyarrow.table({"doc_id": range(len(texts)), "text": texts}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, spans, n_weak FROM ({secrets.ORACLE_SQL})").fetchall()}
    got = {r.doc_id: (r.spans, r.n_weak) for r in secrets.scan_secrets(docs).collect()}
    assert sum(n for _, n in got.values()) > 100
    assert got == want
