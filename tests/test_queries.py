"""Every registered query against its SQL, and that the others run."""

import os

import duckdb
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def rows_of(names, rows):
    form = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(form(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, rows) == rows_of(names, cur.fetchall())


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 90
