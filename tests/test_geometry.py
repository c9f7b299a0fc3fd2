import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basinflow.functions import geometry
from basinflow.operators import coordinates, structures


def one(spark, points, column):
    flat = [float(v) for p in points for v in p]
    return spark.createDataFrame([(flat,)], "coords array<double>").select(column.alias("v")).first()[0]


@pytest.mark.parametrize("d, want", [((1, -1, 0), 180), ((1, 1, 0), 0), ((1, 0, 1), 90)])
def test_dihedral_by_hand(spark, d, want):
    got = one(spark, [(0, 1, 0), (0, 0, 0), (1, 0, 0), d], geometry.dihedral(F.col("coords"), (0, 1, 2, 3)))
    assert abs(got) == pytest.approx(want)
    assert -180 <= got < 180


def test_distance_and_angles(spark):
    assert one(spark, [(0, 0, 0), (3, 4, 0)], geometry.distance(F.col("coords"), (0, 1))) == 5
    angle = geometry.bond_angle(F.col("coords"), (0, 1, 2))
    assert one(spark, [(1, 0, 0), (0, 0, 0), (0, 1, 0)], angle) == pytest.approx(90)
    assert one(spark, [(1, 0, 0), (0, 0, 0), (-1, 0, 0)], angle) == pytest.approx(180)
    assert one(spark, [(0, 0, 0), (1, 0, 0), (0.5, 3**0.5 / 2, 0)], angle) == pytest.approx(60)


def test_degenerate_is_error_or_null(spark):
    line = [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0)]
    assert one(spark, line, geometry.dihedral(F.col("coords"), (0, 1, 2, 3), "null")) is None
    with pytest.raises(Exception, match="collinear"):
        one(spark, line, geometry.dihedral(F.col("coords"), (0, 1, 2, 3)))
    assert one(spark, [(0, 0, 0)] * 3, geometry.bond_angle(F.col("coords"), (0, 1, 2), "null")) is None
    assert one(spark, line, geometry.plane_normal3(F.col("coords"), (0, 1, 2), "null")) is None


@pytest.mark.parametrize("angle, want", [(200, -160), (540, -180), (-180, -180), (180, -180), (0, 0)])
def test_wrap(spark, angle, want):
    assert spark.range(1).select(geometry.wrap(F.lit(float(angle)))).first()[0] == want


def test_shift(spark):
    row = spark.range(1).select(geometry.shift(F.lit(160.0), 40), geometry.shift(F.lit(-170.0), -20, "dihedral")).first()
    assert tuple(row) == (-160, 170)
    with pytest.raises(ValueError):
        geometry.shift(F.lit(0.0), 1, "other")


def _dihedral(p):
    b1, b2, b3 = p[1] - p[0], p[2] - p[1], p[3] - p[2]
    n1, n2 = np.cross(b1, b2), np.cross(b2, b3)
    return -np.degrees(np.arctan2(np.linalg.norm(b2) * (b1 @ n2), n1 @ n2))


def test_batch_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4, 3))
    df = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)], "i long, coords array<double>")
    out = coordinates.add_coordinates(df, "coords", {"a": ("dihedral", (0, 1, 2, 3)), "d": ("distance", (0, 3))}).orderBy("i").collect()
    assert np.allclose([r.a for r in out], [_dihedral(v) for v in x], atol=1e-3)
    assert np.allclose([r.d for r in out], np.linalg.norm(x[:, 3] - x[:, 0], axis=1), atol=1e-5)


def test_missing_atom_is_error(spark):
    df = spark.createDataFrame([([0.0] * 6,)], "coords array<double>")
    with pytest.raises(Exception, match="lacks atom"):
        coordinates.add_coordinates(df, "coords", {"d": ("distance", (0, 2))}).collect()
    with pytest.raises(ValueError):
        coordinates.coordinate(F.col("coords"), "collective", (0, 1))
    with pytest.raises(ValueError):
        coordinates.coordinate(F.col("coords"), "distance", (-1, 1))


def test_pair_transforms(spark):
    def run(x, y, steps):
        df = spark.createDataFrame(list(zip(range(len(x)), map(float, x), map(float, y))), "i long, x double, y double")
        return [(r.x, r.y) for r in coordinates.transform_pair(df, "x", "y", steps).orderBy("i").collect()]

    assert [p[0] for p in run([90, 0, 180, -90], [0] * 4, [("center_x_at", 90)])] == [0, -90, 90, -180]
    assert run([-45, -90], [30, -60], [("fold_sign_symmetry", 0)]) == [(45, -30), (90, 60)]
    assert all(y >= 0 for _, y in run([0, 1e-12], [-5, -10], [("fold_sign_symmetry", 0)]))
    assert run([1, 2, 3], [5, -5, 0], [("restrict_positive_y", 0)]) == [(1, 5), (None, None), (3, 0)]
    assert [p[0] for p in run([170, -170], [0, 0], [("shift_x", -90)])] == [80, 100]
    with pytest.raises(ValueError):
        run([1], [1], [("twist", 0)])


def test_shifted_columns_and_long_form(spark):
    df = spark.createDataFrame([(1, 170.0, 5.0)], "frame_id long, a float, b float")
    out = coordinates.add_shifted(df, {"a": 20.0, "absent": 1.0})
    assert out.columns == ["frame_id", "a", "b", "a_shifted"]
    assert out.first().a_shifted == -170
    long = coordinates.long_form(df, ["frame_id"], ["a", "b"], {"a": "A"}, {"a": "dihedral"}).orderBy("dof_name").collect()
    assert [(r.dof_name, r.dof_value, r.dof_label, r.dof_type) for r in long] == [("a", 170.0, "A", "dihedral"), ("b", 5.0, "b", None)]
    with pytest.raises(ValueError):
        coordinates.normalised(df, ["a"], ["missing_column"])


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_superpose_recovers_a_motion(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(6, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    back, rmsd = structures.superpose(x @ q + rng.normal(size=3), x)
    assert rmsd < 1e-8 and np.allclose(back, x)


def brute_normal(p):
    """By singular values; None for points on a line."""
    c = p - p.mean(axis=0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    if s[1] < 1e-10 or s[1] < 1e-8 * s[0]:
        return None
    for i, j, k in itertools.combinations(range(len(p)), 3):
        side = np.cross(p[j] - p[i], p[k] - p[i])
        if np.linalg.norm(side) > 1e-10:
            return -v[2] if v[2] @ side < 0 else v[2]


def odd_structures():
    """(n, 7, 3) structures: any, alike, flat, on a line, on a point, mirrored, nearly flat, nearly on a line."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 7, 3))
    x[1:4] = x[0] + np.arange(3)[:, None, None]
    x[4, :, 2] = 0
    x[5] = np.outer(np.arange(7), [1, 2, 3])
    x[6] = 2
    x[7] = -x[0]
    x[8:20, :, 2] *= 1e-5
    x[20:30, :, 1:] *= 1e-6
    x[30, 1] = x[30, 0]
    return x


def test_planes_equal_singular_values(spark):
    x = odd_structures()
    df = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)] + [(90, None), (91, [float("nan")] * 21), (92, [1.0, None] + [3.0] * 19)], "i long, coords array<double>")
    atoms = (0, 1, 3, 5, 6)
    got = {r.i: r.n for r in structures.plane_normals(df, "coords", atoms, "n", "null").collect()}
    for i, v in enumerate(x):
        want = brute_normal(v[list(atoms)])
        assert (want is None) == (got[i] is None)
        assert want is None or np.allclose(got[i], want, atol=1e-8)
    assert got[5] is None and got[6] is None and got[90] is None and got[91] is None and got[92] is None
    plan = structures.plane_normals(df, "coords", atoms, "n")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    with pytest.raises(Exception, match="collinear"):
        structures.plane_normals(df.where("i = 5"), "coords", atoms, "n").collect()
    with pytest.raises(Exception, match="lacks atom 7"):
        structures.plane_normals(df.where("i = 0"), "coords", (0, 1, 7), "n").collect()


def test_alignment_equals_singular_values(spark):
    x = odd_structures()
    df = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)] + [(90, None), (91, [float("nan")] * 21)], "i long, coords array<double>")
    for elements, use in ((None, None), (list("CHCCOCH"), np.array([0, 2, 3, 4, 5]))):
        got = {r.i: r for r in structures.align(df, "coords", df.where("i = 0"), elements).collect()}
        for i, v in enumerate(x):
            want, rmsd = structures.superpose(v, x[0], use)
            assert abs(got[i].rmsd - rmsd) < 1e-8
            # a turn about a line, or of a point, is free
            assert i in (5, 6) or 20 <= i < 30 or np.allclose(got[i].aligned, want.ravel(), atol=1e-7)
        assert got[90].aligned is None and got[91].aligned is None and got[91].rmsd is None
    plan = structures.align(df, "coords", df.where("i = 0"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_planes_and_alignment(spark):
    x = np.random.default_rng(0).normal(size=(5, 3))
    turned = x @ np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]]) + 3
    df = spark.createDataFrame([(0, x.ravel().tolist()), (1, turned.ravel().tolist()), (2, None)], "i long, coords array<double>")
    out = structures.align(df, "coords", df.where("i = 0"), elements=["C", "C", "O", "H", "H"]).orderBy("i").collect()
    assert np.allclose(out[1].aligned, x.ravel()) and out[1].rmsd < 1e-6 and out[2].aligned is None
    normals = structures.plane_normals(df.where("i < 2"), "coords", (0, 1, 2), "n").collect()
    assert all(abs(np.linalg.norm(r.n) - 1) < 1e-9 for r in normals)
    with pytest.raises(Exception, match="atoms"):
        structures.align(spark.createDataFrame([([0.0] * 6,)], "coords array<double>"), "coords", df.where("i = 0")).collect()
