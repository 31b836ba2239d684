"""Every registered query against its SQL twin over the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import DATA, has_data
from polyphony.plans import oracle
from polyphony.plans import queries as core

pytestmark = pytest.mark.skipif(not has_data(), reason="no test data")
SQL, QUERIES = oracle.oracle_sql(), core.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in (DATA / "sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 5)

    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, str(DATA / "sf0.001"))
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    got, want = canon([tuple(r) for r in df.collect()], df.columns), canon(cur.fetchall(), names)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_runs(spark, name):
    df = QUERIES[name](spark, str(DATA / "sf0.001"))
    assert df.columns and len(df.collect()) > 0
