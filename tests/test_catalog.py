"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

from basinflow import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_oracle(spark, con, name):
    got = catalog.queries()[name](spark, SF)
    found = [tuple(r) for r in got.collect()]
    if name not in catalog.oracle_sql():
        assert found
        return
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, found) == rows(names, want.fetchall())
