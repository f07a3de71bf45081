"""Every query of the subpackage with an SQL form agrees with it on the smallest tables."""

import duckdb
import pytest

from strandlink.llm.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, con, name):
    got, want = queries()[name](spark, DIR).toPandas(), con.sql(oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)
