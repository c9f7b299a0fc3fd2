import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basinflow.functions import binning, energy
from basinflow.operators import density, overlay

EDGES = binning.linear_edges(0.0, 120.0, 4)


def frames(spark, x, y):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(x, y))], "i long, x double, y double")


def test_bin_index_rules(spark):
    v = [0.0, 29.9, 30.0, 119.9, 120.0, -0.1, 120.1, math.nan, None, math.inf]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    got = df.select("i", binning.bin_index(F.col("v"), EDGES).alias("b"), binning.clipped_index(F.col("v"), EDGES).alias("c")).orderBy("i").collect()
    assert [r.b for r in got] == [0, 0, 1, 3, 3, -1, -1, -1, -1, -1]
    assert [r.c for r in got] == [0, 0, 1, 3, 3, 0, 3, None, None, 3]


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 40), st.floats(-500, 500), st.floats(0.01, 1000), st.integers(0, 2**32 - 1))
def test_bin_index_equals_numpy(spark, bins, low, width, seed):
    edges = np.array(binning.linear_edges(low, low + width, bins))
    rng = np.random.default_rng(seed)
    v = np.concatenate([edges, np.nextafter(edges, -np.inf), np.nextafter(edges, np.inf), rng.uniform(low - 1, low + width + 1, 60), edges.astype(np.float32)])
    want = np.clip(np.digitize(v, edges) - 1, 0, bins - 1)
    want[(v < edges[0]) | (v > edges[-1])] = -1
    df = spark.createDataFrame(list(enumerate(v.tolist())), "i long, v double")
    got = [r[0] for r in df.select("i", binning.bin_index(F.col("v"), edges.tolist()).alias("b")).orderBy("i").select("b").collect()]
    assert got == want.tolist()


def test_edges_are_checked():
    assert binning.stepped_edges(-180, 180, 25)[-1] == 195
    for bad in (lambda: binning.linear_edges(0, 1, 0), lambda: binning.linear_edges(1, 1, 3), lambda: binning.stepped_edges(0, 1, 0)):
        with pytest.raises(ValueError):
            bad()


def test_counts_and_dense_grid(spark):
    cells = density.cells(frames(spark, [-170.0, 30.0, 60.0, math.nan, None], [10.0] * 5), "x", "y", EDGES, EDGES)
    assert sorted(map(tuple, cells.collect())) == [(1, 0, 1), (2, 0, 1)]
    grid = {(r.xi, r.yi): r["count"] for r in density.dense(cells, 4, 4).collect()}
    assert len(grid) == 16 and sum(grid.values()) == 2


def test_text_that_is_no_number_is_missing(spark):
    df = spark.createDataFrame([("10", 1.0), ("ten", 1.0)], "x string, y double")
    assert [tuple(r) for r in density.cells(df, "x", "y", EDGES, EDGES).collect()] == [(0, 0, 1)]


def test_random_histogram_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.uniform(-10, 130, 2000), rng.uniform(-10, 130, 2000)
    want, _, _ = np.histogram2d(x, y, bins=[EDGES, EDGES])
    got = np.zeros((4, 4))
    for r in density.cells(frames(spark, x.tolist(), y.tolist()), "x", "y", EDGES, EDGES).collect():
        got[r.xi, r.yi] = r["count"]
    assert (got == want).all()


def test_representative_is_nearest_then_earliest(spark):
    df = frames(spark, [2.0, 14.0, 16.0, 15.0], [15.0, 15.0, 15.0, 29.0])
    r = density.representatives(df, "x", "y", EDGES, EDGES, ["i"]).collect()
    assert [(a.xi, a.yi, a.i, a.distance2) for a in r] == [(0, 0, 1, 1.0)]


def test_free_energy_scales(spark):
    counts = {(0, 1): 1, (0, 2): 4, (1, 0): 16, (1, 1): 2}
    df = spark.createDataFrame([(*k, v) for k, v in counts.items()], "xi int, yi int, count long")
    got = {(r.xi, r.yi): r.free_energy for r in density.free_energy(df).collect()}
    for k, c in counts.items():
        assert got[k] == pytest.approx(math.log(16 / c))
    logs = density.log_scale(df).where("xi = 0 and yi = 2").first().log_count
    assert logs == pytest.approx(math.log10(5))


@pytest.mark.parametrize("unit, want", [("kJ/mol", 2.494), ("kcal/mol", 0.5962), ("eV", 0.02585), ("meV", 25.85), ("cm^-1", 208.5), ("kT", 1.0)])
def test_thermal_energy(unit, want):
    assert energy.thermal_energy(unit, 300.0) == pytest.approx(want, rel=5e-4)


def test_thermal_energy_is_checked():
    for unit, t in (("J", 300.0), ("eV", None), ("eV", -1.0), ("eV", math.nan)):
        with pytest.raises(ValueError):
            energy.thermal_energy(unit, t)


def _states(spark, rows):
    return spark.createDataFrame(rows, "x double, y double, s string, g string")


def test_majority_and_centres(spark):
    edges = [0.0, 1.0, 2.0, 3.0]
    votes = {(0.5, 0.5): ["1", "1", "noise"], (1.5, 0.5): ["noise", "noise", "2"], (2.5, 0.5): ["10", "2"], (0.5, 1.5): ["2", None], (0.5, 2.5): [None]}
    df = _states(spark, [(x, y, s, None) for (x, y), ss in votes.items() for s in ss])
    got = {r.bin: r.s for r in overlay.majority_states(df, "x", "y", "s", edges, edges).collect()}
    assert got == {0: "1", 2: "2", 3: "2"}
    labels = [r.s for r in overlay.state_labels(df, "s").orderBy("position").collect()]
    assert labels == ["1", "2", "10"]


def test_groups_keep_their_own_majority_null_is_a_group(spark):
    edges = [0.0, 1.0]
    df = _states(spark, [(0.5, 0.5, "0", "a"), (0.5, 0.5, "1", None)])
    got = {r.g: r.s for r in overlay.majority_states(df, "x", "y", "s", edges, edges, ["g"]).collect()}
    assert got == {"a": "0", None: "1"}
    names = [r[0] for r in df.select(overlay.group_name(["g"])).collect()]
    assert names == ["a", "none"]


def test_circular_centre(spark):
    df = _states(spark, [(170.0, 0.0, "0", None), (-170.0, 0.0, "0", None)])
    edges = [-180.0, 180.0]
    assert abs(overlay.state_centres(df, "x", "y", "s", edges, edges, periodic=True).first().centre_x) == pytest.approx(180)
    assert overlay.state_centres(df, "x", "y", "s", edges, edges).first().centre_x == pytest.approx(0)


@pytest.mark.parametrize("n, spread", [(0, 1.0), (1, 1.0), (3000, 1.0), (3000, 0.02)])
def test_nearest_frames_equal_brute_force(spark, n, spread):
    """Ties, repeated places, a crowd in one corner, pins far away, missing values."""
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(0, spread, (n - n // 2, 2)), np.round(rng.normal(5, 2, (n // 2, 2)))])
    odd = [(n, float("nan"), 0.0), (n + 1, None, 0.0), (n + 2, float("inf"), 1.0)]
    frames = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + odd, "k long, x double, y double")
    q = np.concatenate([rng.normal(2, 4, (40, 2)), [[1e6, -1e6], [4.5, 4.5], [4.5, 4.5], [5, 5]]])
    pins = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)] + [(99, None, 1.0)], "pin long, px double, py double")
    got = {r.pin: (r.k, r.distance2) for r in density.nearest_frames(frames, "x", "y", pins, "px", "py", ["k"]).collect()}
    if not n:
        assert not got
        return
    d = ((q[:, None] - p[None]) ** 2).sum(axis=2)
    assert got == {i: (int(v.argmin()), float(v.min())) for i, v in enumerate(d)}
    with pytest.raises(ValueError):
        density.nearest_frames(frames, "x", "y", pins.withColumn("k", pins["pin"]), "px", "py", ["k"])
