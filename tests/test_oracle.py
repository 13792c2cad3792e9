"""Each query against its SQL twin in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tallyloom.operators import graph
from tallyloom.plans.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(str(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    run, sql = QUERIES[name]
    got = run(spark, DATA)
    want = duck.execute(sql)
    cols = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(cols)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found == rows(cols, want.fetchall()) and found  # an empty result proves nothing


def test_edges_of_every_row(spark, tmp_path):
    """Parts beyond 100 and rows beyond the first of an order are edges too."""
    pairs = [(1, 2), (1, 102), (2, 202), (2, 2), (102, 5), (1, 2)]
    spark.createDataFrame([(1, k, s, p) for k, (s, p) in enumerate(pairs, 1)], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = lambda name: sorted(tuple(r) for r in QUERIES[name][0](spark, str(tmp_path)).collect())
    assert got("node_degree") == [(2, 2), (5, 1), (102, 1), (202, 1)]
    edges = set(pairs)
    df = spark.createDataFrame(pairs, "src long, dst long").distinct()
    assert sorted(map(tuple, graph.two_step_neighbours(df).collect())) == sorted({(a, d) for a, b in edges for c, d in edges if b == c and a != d})
    spark.createDataFrame([(1, 7), (2, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 3), (2, 4), (102, 4), (103, 5)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert got("related_nodes") == [("customer-7", "nation-3"), ("customer-7", "nation-4")]
