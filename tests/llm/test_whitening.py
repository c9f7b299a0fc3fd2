import math

import duckdb
import numpy as np
import pytest

from basinflow.llm import catalog, whitening

SF = "/root/testdata/sf0.001"


def brute(vectors, k=8):
    """Integer vectors, n, exact deviations, whitened components up to sign, shares of variance."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n = len(x)
    sums = [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    z = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x])
    cov = z.T @ z / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    return n, deviation, z @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(cov)


def test_query_against_numpy(spark):
    rows = [(i, v) for i, v in duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()]
    got = catalog.queries()["op11_whitening"](spark, SF).collect()
    n, deviation, white, share = brute([v for _, v in rows])
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    at = {i: k for k, (i, _) in enumerate(rows)}
    found = np.zeros((n, 8))
    for r in got:
        assert r.deviation == deviation[at[r.vec_id]]
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        assert 0 <= r.identity_error < 1e-9
        found[at[r.vec_id], r.component - 1] = r.whitened
    signs = np.sign((found * white).sum(axis=0))
    assert np.allclose(found * signs, white, atol=1e-8)


def test_many_tiles_equal_one(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(500, 11)) @ rng.normal(size=(11, 11)) * 50).round().astype(int)
    frame = spark.createDataFrame([([int(a) for a in v],) for v in vectors], "x array<long>").repartition(7)
    got = whitening.moments(frame, 11, tile=4, block_entries=110)
    assert got.n == 500 and got.sums == tuple(vectors.sum(axis=0))
    assert np.allclose(got.covariance, np.cov(vectors.T, bias=True), rtol=1e-12)


def test_large_offset_keeps_small_variance(spark):
    """Products of values that aren't centred would lose the variance."""
    values = [10**11 + k % 3 for k in range(300)]
    frame = spark.createDataFrame([([v, -v],) for v in values], "x array<long>")
    got = whitening.moments(frame, 2)
    assert np.allclose(got.covariance, np.array([[1, -1], [-1, 1]]) * 2 / 3, rtol=1e-12)


def test_sums_of_large_squares_are_exact(spark):
    rows = [(1, [0.0, 0.0]), (2, [2.0**40, 1.0]), (3, [-(2.0**40), 5.0])]
    out, model, _ = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "embedding", scale=1024.0, offset=0)
    n, x = 3, {i: [math.floor(1024 * c) for c in v] for i, v in rows}
    sums = [sum(v[d] for v in x.values()) for d in range(2)]
    assert {r.vec_id: int(r.deviation) for r in out.collect()} == {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x.items()}
    assert model.moments.sums == tuple(sums)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 2.0, 3.0], "a"), (2, [2.0, 2.0, 1.0], "b"), (2, [2.0, 2.0, 1.0], "b"), (None, [0.5, 2.0, 0.0], None), (3, None, "c"),
        (4, [1.0, None, 2.0], "d"), (5, [1.0, nan, 2.0], "e"), (6, [inf, 1.0, 2.0], "f"), (7, [-inf, 1.0, 2.0], "g"), (8, [], "h"), (9, [1.0, 2.0], "i"),
    ]
    out, model, error = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string"))
    got = out.collect()
    assert out.columns == ["vec_id", "embedding", "whitened", "deviation"]
    assert sorted((r.vec_id or 0) for r in got) == [0, 1, 2, 2] and model.moments.n == 4
    # the second dimension has no variance: two components, the third is null
    assert all(r.whitened[2] is None and None not in r.whitened[:2] for r in got) and error < 1e-9
    assert len({tuple(r.whitened[:2]) for r in got if r.vec_id == 2}) == 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_variance(spark, rows, tmp_path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()["op11_whitening"](spark, str(tmp_path)).collect()
    assert len(got) == 2 * sum(v is not None for _, v in rows)
    assert all(r.whitened is None and r.identity_error is None and r.deviation == 0 and r.explained == 0 for r in got)
