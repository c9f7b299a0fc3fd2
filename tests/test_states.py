import math

import numpy as np
import pandas as pd
import pytest

from basinflow.operators import dbscan, grid_states


def df(spark, x, y, g=None):
    g = g or ["a"] * len(x)
    return spark.createDataFrame([(i, float(a) if a is not None else None, float(b) if b is not None else None, k) for i, (a, b, k) in enumerate(zip(x, y, g))], "k long, x double, y double, g string")


def grid(spark, x, y, step, least, domain=(-180.0, 180.0), **kw):
    out = grid_states.assign_grid_states(df(spark, x, y, kw.pop("g", None)), "x", "y", "s", step=step, min_count=least, x_domain=domain, y_domain=domain, **kw)
    return [r.s for r in out.orderBy("k").collect()]


def blobs(n, sigma, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(20, sigma, (n, 2)), rng.normal(160, sigma, (n, 2))
    return np.concatenate([a, b])


def test_two_blobs_and_noise(spark):
    p = np.concatenate([blobs(200, 0.5), [[90, 90]]])
    got = grid(spark, p[:, 0], p[:, 1], 2.0, 5)
    assert set(got[:-1]) - {"noise"} == {"0", "1"} and got[-1] == "noise"


def test_periodic_seam(spark):
    x, y = [-179.4, -179.2, 179.2, 179.4], [10, 10.1, 10.2, 10.3]
    assert grid(spark, x, y, 2.0, 2, periodic=True) == ["0"] * 4
    assert grid(spark, x, y, 2.0, 2) == ["0", "0", "1", "1"]


def test_missing_off_domain_and_small_groups(spark):
    got = grid(spark, [5, 5, None, math.nan, 500, 5], [5, 5, 5, 5, 5, None], 10.0, 2, domain=(0.0, 10.0))
    assert got == ["0", "0", "noise", "noise", "0", "noise"]
    # a group of one valid frame is noise even if one frame is enough for a cell
    got = grid(spark, [5, 5, 5], [5, 5, 5], 10.0, 1, domain=(0.0, 10.0), group=["g"], g=["a", "a", "b"])
    assert got == ["0", "0", "noise"]


def test_null_group_is_a_group(spark):
    got = grid(spark, [5] * 4, [5] * 4, 10.0, 2, domain=(0.0, 10.0), group=["g"], g=["a", "a", None, None])
    assert got == ["0"] * 4


def test_component_order_is_by_first_cell():
    xi, yi = np.array([3, 0, 0, 3]), np.array([3, 0, 1, 2])
    assert grid_states.component_ids(xi, yi, 4, 4).tolist() == [1, 0, 0, 1]
    assert grid_states.component_ids(np.array([0, 3]), np.array([1, 1]), 4, 4, wrap_x=True).tolist() == [0, 0]
    # diagonal cells don't touch
    assert grid_states.component_ids(np.array([0, 1]), np.array([0, 1]), 2, 2).tolist() == [0, 1]


def test_random_components_equal_flood_fill():
    rng = np.random.default_rng(2)
    for wrap in (False, True):
        on = rng.random((9, 7)) < 0.5
        xi, yi = np.nonzero(on)
        got = grid_states.component_ids(xi, yi, 9, 7, wrap, wrap)
        label = -np.ones((9, 7), int)
        n = 0
        for a, b in zip(xi, yi):
            if label[a, b] >= 0:
                continue
            stack = [(a, b)]
            while stack:
                i, j = stack.pop()
                if wrap:
                    i, j = i % 9, j % 7
                if not (0 <= i < 9 and 0 <= j < 7) or not on[i, j] or label[i, j] >= 0:
                    continue
                label[i, j] = n
                stack += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
            n += 1
        assert got.tolist() == label[xi, yi].tolist()


def test_summaries(spark):
    frames = spark.createDataFrame([("0",), ("0",), ("noise",), (None,), ("1",)], "s string")
    assert {r.s: r.frames for r in grid_states.state_summary(frames, "s").collect()} == {"0": 2, "noise": 1, None: 1, "1": 1}
    assert grid_states.state_totals(frames, "s").first().asDict() == {"frames": 5, "assigned": 3, "noise": 1, "unset": 1, "states": 2}


def db(spark, p, eps, least, **kw):
    frames = df(spark, p[:, 0], p[:, 1], kw.pop("g", None))
    return [r.s for r in dbscan.dbscan_states(frames, "x", "y", "k", "s", eps=eps, min_samples=least, **kw).orderBy("k").collect()]


def brute(p, eps, least, periodic=False):
    if periodic:
        r = np.radians(p)
        p = np.hstack([np.stack([np.cos(r[:, i]), np.sin(r[:, i])], 1) for i in range(2)])
        eps = math.sqrt(2 - 2 * math.cos(math.radians(eps)))
    d = np.linalg.norm(p[:, None] - p[None], axis=2) <= eps
    core = d.sum(1) >= least
    label = -np.ones(len(p), int)
    n = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if label[j] >= 0:
                continue
            label[j] = n
            stack += list(np.flatnonzero(d[j] & core & (label < 0)))
        n += 1
    for i in np.flatnonzero(~core):
        near = label[d[i] & core]
        if len(near):
            label[i] = near.min()
    return ["noise" if v < 0 else str(v) for v in label]


@pytest.mark.parametrize("periodic", [False, True])
def test_dbscan_equals_brute_force(spark, periodic):
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.uniform(-180, 180, (120, 2)), rng.normal(0, 8, (40, 2)) + [179, -170]])
    p = (p + 180) % 360 - 180
    assert db(spark, p, 20.0, 4, periodic=periodic) == brute(p, 20.0, 4, periodic)


@pytest.mark.parametrize("periodic", [False, True])
@pytest.mark.parametrize("eps, least", [(6.0, 12), (20.0, 3), (95.0, 40), (170.0, 5)])
def test_dbscan_of_crowded_cells_equals_brute_force(spark, periodic, eps, least):
    """Blobs denser than a cell, repeated points, rings a little within and beyond eps, points at eps itself."""
    rng = np.random.default_rng(3)
    turn = rng.uniform(0, 2 * np.pi, 60)
    ring = np.stack([np.cos(turn), np.sin(turn)], 1)
    p = np.concatenate([
        rng.normal(0, 1.0, (80, 2)) + [-150, 100],
        rng.normal(0, 1.0, (80, 2)) + [-150 + eps * 1.05, 100],
        np.repeat([[40.0, -60.0]], 50, axis=0),
        ring * eps * 0.999 + [40.0, -60.0],
        np.array([[40.0 + eps, -60.0], [40.0, -60.0 - eps]]),
        rng.uniform(-180, 180, (60, 2)),
        np.round(rng.uniform(-20, 20, (80, 2)) / 6) * 6,
    ])
    p = (p + 180) % 360 - 180
    assert db(spark, p, eps, least, periodic=periodic) == brute(p, eps, least, periodic)


def test_dbscan_of_missing_values_and_of_nothing(spark):
    p = np.array([[0.0, 0.0], [-0.0, 0.0], [np.nan, 0.0], [np.inf, 1.0], [0.1, 0.0]])
    assert db(spark, p, 1.0, 3) == ["0", "0", "noise", "noise", "0"]
    assert db(spark, p, 1.0, 3, group=["g"], g=[None, None, None, "a", None]) == ["0", "0", "noise", "noise", "0"]
    empty = df(spark, p[:, 0], p[:, 1]).where("k < 0")
    assert not dbscan.dbscan_states(empty, "x", "y", "k", "s", eps=1.0, min_samples=2).collect()


def test_dbscan_seam_groups_and_checks(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([np.stack([rng.normal(-179, 0.3, 10), np.zeros(10)], 1), np.stack([rng.normal(179, 0.3, 10), np.zeros(10)], 1)])
    assert set(db(spark, p, 5.0, 3, periodic=True)) == {"0"}
    assert set(db(spark, p, 5.0, 3)) == {"0", "1"}
    assert db(spark, np.zeros((3, 2)), 1.0, 1, group=["g"], g=["a", "a", "b"]) == ["0", "0", "noise"]
    with pytest.raises(ValueError):
        db(spark, p, 180.0, 3, periodic=True)
    with pytest.raises(ValueError):
        db(spark, p, 5.0, 3, max_points=4)


@pytest.mark.parametrize("periodic", [False, True])
def test_tiles_label_as_one_task(spark, periodic):
    """Groups (one of them null, one of a single frame), tiles that don't divide the grid, cells off the grid."""
    rng = np.random.default_rng(4)
    rows = [(g, int(x), int(y), int(rng.integers(1, 5))) for g in ("a", None) for x in range(-1, 23) for y in range(-1, 19) if rng.random() < 0.75]
    df = spark.createDataFrame([*rows, ("one", 3, 3, 1)], "g string, xi int, yi int, count long")
    want = grid_states.label_cells(df, 23, 19, 2, ["g"], periodic)
    got = grid_states.label_cells(df, 23, 19, 2, ["g"], periodic, tile=4)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert len({r.component for r in want.collect()}) > 3
    empty = df.where("g = 'none'")
    assert grid_states.label_cells(empty, 23, 19, 2, ["g"], periodic, tile=4).collect() == []


def test_a_large_grid_is_labelled_in_tiles(spark):
    n = 20_000
    rng = np.random.default_rng(8)
    # lines of 4 000 cells along both axes cross many tiles, one another, and the periodic edges
    along, fixed = (rng.integers(0, n, (60, 1)) + np.arange(4_000)) % n, np.broadcast_to(rng.integers(0, n, (60, 1)), (60, 4_000))
    turned = np.arange(60)[:, None] % 2 == 0
    key = np.unique(np.where(turned, along * n + fixed, fixed * n + along))
    cells = pd.DataFrame({"xi": (key // n).astype(np.int32), "yi": (key % n).astype(np.int32), "count": 1})
    got = grid_states.label_cells(spark.createDataFrame(cells, "xi int, yi int, count long"), n, n, 1, periodic=True).toPandas().sort_values(["xi", "yi"])
    want = grid_states.component_ids(cells["xi"].to_numpy(), cells["yi"].to_numpy(), n, n, True, True)
    assert got["component"].tolist() == want.tolist()
