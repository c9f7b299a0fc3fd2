import math

import numpy as np
import pytest

from basinflow.llm import topk


def brute(rows, k=20, by=20, scale=64):
    good = [(i, np.floor(scale * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    out = []
    for q, x in good:
        if q % by == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(df, **kw):
    return sorted(map(tuple, topk.top_k(df, **kw).collect()))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 12))
    return [(int(i), (centres[i % 8] + 0.2 * rng.normal(size=12)).tolist()) for i in rng.permutation(500)]


@pytest.mark.parametrize("tiles", [{}, {"tile_documents": 60, "tile_queries": 7}, {"tile_documents": 1000, "tile_queries": 3}])
def test_equals_brute_force(spark, rows, tiles):
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **tiles) == brute([(i, np.float32(v).tolist()) for i, v in rows])


def test_any_columns_of_the_result(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute([(i, np.float32(v).tolist()) for i, v in rows])
    assert topk.top_k(df).count() == len(want)
    assert sorted(r.score for r in topk.top_k(df).select("score").collect()) == sorted(w[3] for w in want)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, None), (3, [None, 1.0]), (4, [math.nan, 1.0]), (5, [math.inf, 0.0]), (None, [1.0, 1.0]), (6, []), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (20, [-0.5, 0.01])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, x int, score int")
    assert run(df) == brute(rows)
    assert run(df, k=1) == brute(rows, k=1)
    assert run(df.limit(0)) == []


def test_repeated_ids_are_searched_for_each_row(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [-1.0]), (1, [2.0]), (3, [3.0])], "vec_id long, embedding array<double>")
    assert run(df) == sorted([(0, 1, 3, 64 * 192), (0, 2, 1, 64 * 128), (0, 1, 1, -64 * 128), (0, 2, 3, -64 * 192)])


def test_all_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(200)], "vec_id long, embedding array<double>")
    got = run(df, tile_documents=30)
    assert [i for q, _, i, _ in got if q == 0] == list(range(1, 21))
    assert [i for q, _, i, _ in got if q == 20] == list(range(20))


def test_pruning_skips_blocks_of_separated_clusters():
    rng = np.random.default_rng(0)
    x = np.floor(64 * np.concatenate([rng.normal(0, 0.02, (640, 16)) + 3 * np.eye(16)[k] for k in range(10)]))
    ids = np.arange(len(x))
    tile = topk.Tile(ids, x)
    q = ids % 20 == 0
    *_, scored = tile.search(ids[q], x[q], 20)
    assert scored < 0.5 * q.sum() * len(tile.starts)
    bound = tile.bounds(x[:5])
    for b, (s, e) in enumerate(zip(tile.starts, tile.ends)):
        assert ((x[:5] @ tile.x[s:e].T).max(axis=1) <= bound[:, b] + 1e-9).all()


def test_known_least_scores_skip_blocks_and_change_nothing():
    rng = np.random.default_rng(3)
    x = np.floor(64 * np.concatenate([rng.normal(0, 0.02, (320, 16)) + 3 * np.eye(16)[k] for k in range(10)]))
    ids = np.arange(len(x))
    tile, q = topk.Tile(ids, x), ids % 20 == 0
    rows, found, scores, scored = tile.search(ids[q], x[q], 20)
    least = np.array([scores[rows == r].min() for r in range(q.sum())])
    again = tile.search(ids[q], x[q], 20, least=least)
    assert all((a == b).all() for a, b in zip((rows, found, scores), again[:3])) and again[3] < scored


def test_one_id_of_many_rows(spark):
    df = spark.createDataFrame([(0, [float(i % 7), 1.0]) for i in range(300)] + [(1, [3.0, 3.0]), (2, [1.0, 9.0])], "vec_id long, embedding array<double>")
    got = run(df, tile_documents=20, tile_queries=30)
    assert len(got) == 600 and {g[2] for g in got} == {1, 2}
