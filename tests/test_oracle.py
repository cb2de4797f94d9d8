"""Every query of the core against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tessera.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(x[names.index(c)] for c in cols) for x in res.fetchall()), key=repr)
    assert got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
