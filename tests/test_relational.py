import os

import duckdb
import pytest

import __spark_entry__
from tessera.plans import relational
from tessera.session import TABLES

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{TESTDATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(rows):
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(relational.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = relational.QUERIES[name](spark, TESTDATA)
    columns = sorted(df.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {names} FROM ({relational.ORACLE_SQL[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


def test_sketches_are_near_the_exact_counts(spark, duck):
    want = dict(duck.execute("SELECT year(l_shipdate), count(DISTINCT l_partkey) FROM lineitem GROUP BY 1").fetchall())
    got = {r.year: r.parts for r in relational.approximate_parts(spark, TESTDATA).collect()}
    assert got.keys() == want.keys() and all(abs(got[y] - n) <= 0.1 * n + 2 for y, n in want.items())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
