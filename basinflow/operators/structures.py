"""Planes and alignment of structures, as Column expressions.

Both need the eigenvector of a small symmetric matrix that belongs to its largest
eigenvalue. ``dominant`` squares the matrix until one direction is left, which needs no
care where eigenvalues are equal: what is left then is a mix of their directions, and
each of these is as good. Sums over atoms and the squarings are array aggregates inside
a row: no Python worker, no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry

#: Squarings until a direction stands alone; eigenvalues nearer than 2 ** -SQUARINGS count as equal.
SQUARINGS = 40
#: Shares of the largest eigenvalue's square in the matrix from which on it stands alone.
_ALONE = 1.0 - 1e-15


def sums(items: Column, names: Sequence[str], terms: Callable[[Column], dict[str, Column]]) -> Column:
    """Struct of the sums of some named terms of each item of an array."""

    def add(total: Column, item: Column) -> Column:
        return F.struct(*[(total[k] + v).alias(k) for k, v in terms(item).items()])

    return F.aggregate(items, F.struct(*[F.lit(0.0).alias(k) for k in names]), add)


def _squares(m: Callable[[int, int], Column], n: int) -> Column:
    """Sum of the squares of all entries."""
    parts = [m(i, j) * m(i, j) * (1.0 if i == j else 2.0) for i in range(n) for j in range(i, n)]
    return sum(parts[1:], parts[0])


def _entries(make: Callable[[int, int], Column], n: int) -> list[Column]:
    return [make(i, j).alias(f"m{i}{j}") for i in range(n) for j in range(i, n)]


def dominant(start: Callable[[int, int], Column], n: int) -> Column:
    """Struct m00, m01, ... of the projector on the largest eigenvalue's direction.

    ``start`` gives the upper entries of a symmetric matrix without negative eigenvalues;
    for a matrix of zeros the result is that of the unit matrix.
    """
    trace = sum((start(i, i) for i in range(1, n)), start(0, 0))
    first = lambda i, j: F.when(trace > 0, start(i, j) / trace).otherwise(1.0 / n if i == j else 0.0)
    zero = F.struct(*_entries(first, n), F.lit(0.0).alias("alone"))

    def step(now: Column, _: Column) -> Column:
        at = lambda i, j: now[f"m{min(i, j)}{max(i, j)}"]
        size = _squares(at, n)
        square = lambda i, j: sum((at(i, k) * at(k, j) for k in range(1, n)), at(i, 0) * at(0, j)) / size
        return F.when(now["alone"] >= _ALONE, now).otherwise(F.struct(*_entries(square, n), size.alias("alone")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(SQUARINGS)), zero, step)


def direction(projector: str, n: int) -> list[Column]:
    """Unit vector of a projector's column with the largest diagonal entry, the first one on ties."""
    at = lambda i, j: F.col(f"{projector}.m{min(i, j)}{max(i, j)}")
    top = F.greatest(*[at(i, i) for i in range(n)])

    def chosen(value: Callable[[int], Column]) -> Column:
        pick = value(n - 1)
        for j in range(n - 2, -1, -1):
            pick = F.when(at(j, j) == top, value(j)).otherwise(pick)
        return pick

    # where several directions are left, a column is shorter than its diagonal entry says
    size = chosen(lambda j: F.sqrt(sum((at(i, j) * at(i, j) for i in range(1, n)), at(0, j) * at(0, j))))
    return [chosen(lambda j, i=i: at(i, j)) / size for i in range(n)]


def _finite(values: Column) -> Column:
    return ~F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def plane_normals(frames: DataFrame, coords: str, atoms: Sequence[int], name: str, on_degenerate: str = "error") -> DataFrame:
    """frames with the unit normal of the best-fit plane of some atoms of each structure.

    The normal lies on the side of the first ordered triple of atoms that are not on one
    line. Atoms on a line are an error, or null; a missing structure, or one with a
    missing or non-finite coordinate among the atoms, gives null; one without all the
    atoms is an error.
    """
    if len(atoms) < 3 or min(atoms) < 0:
        raise ValueError(f"a plane needs three atom ids from 0 on; got {list(atoms)}")
    if on_degenerate not in ("error", "null"):
        raise ValueError(f"on_degenerate must be error or null; got {on_degenerate!r}")
    keep, last = frames.columns, max(atoms)
    # each step is a projection of its own, so that nothing is computed twice
    out = frames.withColumn("_x", F.col(coords).cast("array<double>"))
    few = F.size("_x") < 3 * (last + 1)
    out = out.withColumn("_x", F.when(few & F.col("_x").isNotNull(), F.raise_error(F.lit(f"plane: a structure lacks atom {last}")).cast("array<double>")).otherwise(F.col("_x")))
    flat = F.array(*[F.get("_x", F.lit(3 * i + k)) for i in atoms for k in range(3)])
    out = out.withColumn("_f", flat).withColumn("_f", F.when(_finite(F.col("_f")), F.col("_f")))
    ids = F.sequence(F.lit(0), F.lit(len(atoms) - 1))
    point = lambda i: [F.get("_f", 3 * i + k) for k in range(3)]
    out = out.withColumn("_m", F.when(F.col("_f").isNotNull(), sums(ids, "xyz", lambda i: dict(zip("xyz", point(i))))))
    away = lambda i: [p - F.col(f"_m.{a}") / len(atoms) for p, a in zip(point(i), "xyz")]

    def scatter(i: Column) -> dict[str, Column]:
        c = away(i)
        return {f"s{j}{k}": c[j] * c[k] for j in range(3) for k in range(j, 3)}

    out = out.withColumn("_s", sums(ids, [f"s{j}{k}" for j in range(3) for k in range(j, 3)], scatter)).withColumn("_d", dominant(lambda i, j: F.col(f"_s.s{i}{j}"), 3))
    out = out.withColumns({f"_u{k}": v for k, v in enumerate(direction("_d", 3))})
    # two axes across the longest one: the scatter across it is summed from the atoms, so a thin plane keeps its digits
    u = (F.col("_u0"), F.col("_u1"), F.col("_u2"))
    flat_axis = (F.abs(u[0]) <= F.abs(u[1])) & (F.abs(u[0]) <= F.abs(u[2]))
    helper = tuple(F.when(c, 1.0).otherwise(0.0) for c in (flat_axis, ~flat_axis & (F.abs(u[1]) <= F.abs(u[2])), ~flat_axis & (F.abs(u[1]) > F.abs(u[2]))))
    side = geometry.cross(u, helper)
    out = out.withColumn("_l", geometry.norm(side)).withColumns({f"_v{k}": c / F.col("_l") for k, c in enumerate(side)})
    v = (F.col("_v0"), F.col("_v1"), F.col("_v2"))
    out = out.withColumns({f"_w{k}": c for k, c in enumerate(geometry.cross(u, v))})
    w = (F.col("_w0"), F.col("_w1"), F.col("_w2"))

    def across(i: Column) -> dict[str, Column]:
        c = tuple(away(i))
        p, q, r = geometry.dot(c, u), geometry.dot(c, v), geometry.dot(c, w)
        return {"pp": p * p, "qq": q * q, "qr": q * r, "rr": r * r}

    out = out.withColumn("_t", sums(ids, ["pp", "qq", "qr", "rr"], across))
    half = (F.col("_t.qq") - F.col("_t.rr")) / 2
    middle = (F.col("_t.qq") + F.col("_t.rr")) / 2 + F.sqrt(half * half + F.col("_t.qr") * F.col("_t.qr"))
    turn = F.atan2(2 * F.col("_t.qr"), F.col("_t.qq") - F.col("_t.rr")) / 2
    out = out.withColumn("_line", (F.sqrt(middle) < geometry.SHORTEST) | (F.sqrt(middle) < 1e-8 * F.sqrt("_t.pp"))).withColumn("_a", turn)
    n = [F.cos("_a") * w[k] - F.sin("_a") * v[k] for k in range(3)]
    out = out.withColumns({f"_n{k}": c for k, c in enumerate(n)})
    # unless all atoms are on a line, some triple with the first atom isn't
    pairs = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(k).alias("k")) for j, k in combinations(range(1, len(atoms)), 2)])
    zero = [F.get("_f", F.lit(k)) for k in range(3)]

    def facing(known: Column, p: Column) -> Column:
        a, b = (tuple(x - z for x, z in zip(point(p[i]), zero)) for i in "jk")
        c = geometry.cross(a, b)
        along = geometry.dot(c, (F.col("_n0"), F.col("_n1"), F.col("_n2")))
        return F.when(known != 0, known).when(geometry.norm(c) > geometry.SHORTEST, F.when(along < 0, -1.0).otherwise(1.0)).otherwise(0.0)

    out = out.withColumn("_sign", F.aggregate(pairs, F.lit(0.0), facing)).withColumn("_sign", F.when(F.col("_sign") < 0, -1.0).otherwise(1.0))
    normal = F.array(*[F.col("_sign") * F.col(f"_n{k}") for k in range(3)])
    bad = F.raise_error(F.lit("plane: atoms are collinear")).cast("array<double>") if on_degenerate == "error" else F.lit(None).cast("array<double>")
    found = F.when(F.col("_f").isNull(), F.lit(None).cast("array<double>")).when(F.col("_line"), bad).otherwise(normal)
    return out.withColumn("_normal", found).select(*[c for c in keep if c != name], F.col("_normal").alias(name))


def superpose(moving: np.ndarray, fixed: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """moving rotated and translated onto fixed, fitted on the atoms ``use``, and the fit's RMSD."""
    at = np.arange(len(fixed)) if use is None else use
    a, b = moving[at], fixed[at]
    ca, cb = a.mean(axis=0), b.mean(axis=0)
    u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
    # a proper rotation: no reflection
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    rotation = u @ flip @ vt
    out = (moving - ca) @ rotation + cb
    return out, float(np.sqrt(((out[at] - b) ** 2).sum(axis=1).mean()))


def heavy_atoms(elements: Sequence[str]) -> np.ndarray | None:
    """Places of all atoms but hydrogen, None if fewer than three are left."""
    heavy = np.flatnonzero(np.array([e.upper() != "H" for e in elements]))
    return heavy if len(heavy) >= 3 else None


def superpose_all(moving: np.ndarray, fixed: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n, atoms, 3) structures at once, each as by ``superpose``, and the fits' RMSD."""
    at = np.arange(len(fixed)) if use is None else use
    a, b = moving[:, at], fixed[at]
    ca, cb = a.mean(axis=1, keepdims=True), b.mean(axis=0)
    u, _, vt = np.linalg.svd((a - ca).transpose(0, 2, 1) @ (b - cb))
    sign = np.sign(np.linalg.det(u @ vt))
    u[:, :, 2] *= np.where(sign == 0, 1.0, sign)[:, None]
    out = (moving - ca) @ (u @ vt) + cb
    return out, np.sqrt(((out[:, at] - b) ** 2).sum(axis=2).mean(axis=1))


def align(frames: DataFrame, coords: str, reference: DataFrame, elements: Sequence[str] | None = None, heavy_only: bool = True) -> DataFrame:
    """frames with ``aligned`` coordinates and ``rmsd``, on the one structure of ``reference``.

    With elements, hydrogen is left out of the fit unless too few atoms remain. The
    reference is a single row, a constant of the plan. The rotation is the unit
    quaternion of the largest eigenvalue of the 4x4 matrix made from the two structures'
    scatter, so it is never a reflection. A structure that is null, or holds a missing or
    non-finite coordinate, has neither result; one of another length is an error.
    """
    row = reference.select(coords).first()
    if row is None or row[0] is None:
        raise ValueError("no reference structure")
    fixed = np.asarray(row[0], float).reshape(-1, 3)
    use = heavy_atoms(elements) if elements is not None and heavy_only else None
    at = np.arange(len(fixed)) if use is None else use
    centre = fixed[at].mean(axis=0)
    keep, n = frames.columns, len(at)
    constant = lambda values, kind: F.lit(np.ascontiguousarray(values).tolist()).cast(f"array<{kind}>")
    out = frames.withColumn("_x", F.col(coords).cast("array<double>"))
    wrong = F.concat(F.lit("a structure has "), F.floor(F.size("_x") / 3).cast("string"), F.lit(f" atoms, the reference {len(fixed)}"))
    out = out.withColumn("_x", F.when(F.col("_x").isNotNull() & (F.size("_x") != fixed.size), F.raise_error(wrong).cast("array<double>")).when(_finite(F.col("_x")), F.col("_x")))
    # the fit's atoms with their places on the reference, centred
    items = F.arrays_zip(constant(at, "int").alias("i"), *[constant(fixed[at, k] - centre[k], "double").alias(a) for k, a in enumerate("xyz")])
    spot = lambda i: [F.get("_x", 3 * i + k) for k in range(3)]
    out = out.withColumn("_m", F.when(F.col("_x").isNotNull(), sums(items, "xyz", lambda p: dict(zip("xyz", spot(p["i"]))))))
    moved = lambda i: [c - F.col(f"_m.{a}") / n for c, a in zip(spot(i), "xyz")]
    out = out.withColumn("_h", sums(items, [a + b for a in "xyz" for b in "xyz"], lambda p: {a + b: c * p[b] for a, c in zip("xyz", moved(p["i"])) for b in "xyz"}))
    h = lambda ab: F.col(f"_h.{ab}")
    matrix = {
        (0, 0): h("xx") + h("yy") + h("zz"), (0, 1): h("yz") - h("zy"), (0, 2): h("zx") - h("xz"), (0, 3): h("xy") - h("yx"),
        (1, 1): h("xx") - h("yy") - h("zz"), (1, 2): h("xy") + h("yx"), (1, 3): h("zx") + h("xz"),
        (2, 2): h("yy") - h("xx") - h("zz"), (2, 3): h("yz") + h("zy"), (3, 3): h("zz") - h("xx") - h("yy"),
    }
    out = out.withColumns({f"_k{i}{j}": v for (i, j), v in matrix.items()})
    # no eigenvalue is below minus this
    out = out.withColumn("_shift", F.sqrt(_squares(lambda i, j: F.col(f"_k{i}{j}"), 4)))
    out = out.withColumn("_d", dominant(lambda i, j: F.col(f"_k{i}{j}") + F.col("_shift") if i == j else F.col(f"_k{i}{j}"), 4))
    out = out.withColumns({f"_q{k}": v for k, v in zip("wxyz", direction("_d", 4))})
    w, x, y, z = (F.col(f"_q{k}") for k in "wxyz")
    turn = [
        [w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z],
    ]
    out = out.withColumns({f"_r{j}{k}": turn[j][k] for j in range(3) for k in range(3)})

    def laid(i: Column) -> list[Column]:
        c = moved(i)
        return [F.col(f"_r{j}0") * c[0] + F.col(f"_r{j}1") * c[1] + F.col(f"_r{j}2") * c[2] + F.lit(float(centre[j])) for j in range(3)]

    atoms = F.sequence(F.lit(0), F.lit(len(fixed) - 1))
    out = out.withColumn("_aligned", F.when(F.col("_x").isNotNull(), F.flatten(F.transform(atoms, lambda i: F.array(*laid(i))))))
    off = lambda p: sum(((F.get("_aligned", 3 * p["i"] + k) - F.lit(float(centre[k])) - p[a]) ** 2 for k, a in ((1, "y"), (2, "z"))), (F.get("_aligned", 3 * p["i"]) - F.lit(float(centre[0])) - p["x"]) ** 2)
    rmsd = F.sqrt(sums(items, ["d"], lambda p: {"d": off(p)})["d"] / n)
    out = out.withColumn("_rmsd", F.when(F.col("_aligned").isNotNull(), rmsd))
    return out.select(*[c for c in keep if c not in ("aligned", "rmsd")], F.col("_aligned").alias("aligned"), F.col("_rmsd").alias("rmsd"))
