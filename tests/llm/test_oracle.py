"""Queries of this subpackage against their SQL."""

import glob
import os

import duckdb
import pytest

from tallyloom.llm.registry import ORACLE_SQL, QUERIES

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    got = QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(cols)
    rows = lambda data: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in data)
    assert rows(got.select(*cols).collect()) == rows(want.fetchall())
