"""Every query with reference SQL against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from tarnfold import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    listed = ", ".join(f'"{c}"' for c in columns)
    want = sorted(repr(tuple(r)) for r in duck.execute(f"SELECT {listed} FROM ({catalog.oracle_sql()[name]})").fetchall())
    assert got == want
