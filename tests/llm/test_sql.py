import duckdb
import pytest

from conftest import DATA, has_data
from polyphony.llm import queries, sql

pytestmark = pytest.mark.skipif(not has_data(), reason="no test data")


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in (DATA / "sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(sql.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    got = sorted(tuple(r) for r in queries.queries()[name](spark, str(DATA / "sf0.001")).select(*names).collect())
    assert got == want and got
