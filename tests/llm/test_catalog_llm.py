"""Text queries against their SQL on the smallest tables; the others against plain Python."""

import os
import zlib

import duckdb
import pytest

from basinflow.llm import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr([r[c] for c in sorted(names)]) for r in got.collect()) == sorted(repr([dict(zip(names, r))[c] for c in sorted(names)]) for r in want.fetchall())


@pytest.mark.parametrize("name, m, r", [("op5_compression_language", 5, 0), ("op8_toxicity", 3, 1), ("op10_co_training", 3, 1)])
def test_classifiers_return_every_document(spark, name, m, r):
    rows = catalog.queries()[name](spark, SF).collect()
    ids = [x[0] for x in duckdb.sql(f"select doc_id from '{SF}/documents.parquet'").fetchall()]
    assert sorted(x.doc_id for x in rows) == sorted(ids)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % m == r) and 0 <= x.score <= 1 for x in rows)
