"""Every named query runs, and agrees with its SQL on the smallest tables."""

import os

import duckdb
import pytest

from credence import checks
from credence import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
queries = lambda: engine.queries() | checks.queries()
oracle_sql = lambda: engine.oracle_sql() | checks.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    v = float(v) if type(v).__name__ == "Decimal" else v
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_agrees_with_sql(spark, sql, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = sql.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns[-2:] == ["probabilities", "predicted"] and df.count() > 0
