import os

import duckdb
import pytest

import __spark_entry__
from tessera.llm import queries
from tessera.session import TABLES

TESTDATA = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = [n for n in __spark_entry__.queries() if n in queries.QUERIES]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(queries.ORACLE_SQL) < set(names)
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{TESTDATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = queries.QUERIES[name](spark, TESTDATA)
    columns = sorted(df.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"SELECT {names} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    plain = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else repr(x) for x in r) for r in rows)
    assert plain(df.select(*columns).collect()) == plain(want)
