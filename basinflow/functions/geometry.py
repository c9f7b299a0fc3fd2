"""Geometry of atoms as Column expressions over a flat coordinate array.

``coords`` is an array of 3 * atoms numbers, x, y, z of one atom after the other. All
arithmetic is double precision and stays in generated code; callers narrow the result.
Degenerate input raises an error, or gives null with ``on_degenerate="null"``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]

#: Shortest vector whose direction counts.
SHORTEST = 1e-10


def atom(coords: Column, i: int) -> Vector:
    """Position of one atom."""
    if i < 0:
        raise ValueError(f"atom ids start at 0; got {i}")
    return tuple(F.get(coords, F.lit(3 * i + k)).cast("double") for k in range(3))  # type: ignore[return-value]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def over(a: Vector, s: Column) -> Vector:
    # a zero length gives null, which the guard of the degenerate case turns into its result
    return tuple(F.try_divide(k, s) for k in a)  # type: ignore[return-value]


def _guarded(bad: Column, value: Column, what: str, on_degenerate: str) -> Column:
    if on_degenerate == "null":
        return F.when(~bad, value)
    if on_degenerate != "error":
        raise ValueError(f"on_degenerate must be error or null; got {on_degenerate!r}")
    return F.when(bad, F.raise_error(F.lit(what)).cast("double")).otherwise(value)


def wrap(angle: Column) -> Column:
    """Angle in degrees brought to [-180, 180)."""
    return F.pmod(angle + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def shift(angle: Column, degrees: float, mode: str = "signed") -> Column:
    """Angle moved by some degrees and wrapped; both modes name the same rule."""
    if mode not in ("signed", "dihedral"):
        raise ValueError(f"unknown shift mode {mode!r}")
    return wrap(angle + F.lit(float(degrees)))


def distance(coords: Column, atoms: tuple[int, int]) -> Column:
    """Distance of two atoms."""
    a, b = (atom(coords, i) for i in atoms)
    return norm(minus(b, a))


def bond_angle(coords: Column, atoms: tuple[int, int, int], on_degenerate: str = "error") -> Column:
    """Angle at the second atom, 0 to 180 degrees."""
    a, b, c = (atom(coords, i) for i in atoms)
    u, v = minus(a, b), minus(c, b)
    lu, lv = norm(u), norm(v)
    cosine = dot(over(u, lu), over(v, lv))
    value = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    return _guarded((lu < SHORTEST) | (lv < SHORTEST), value, "bond angle: two of the atoms coincide", on_degenerate)


def dihedral(coords: Column, atoms: tuple[int, int, int, int], on_degenerate: str = "error") -> Column:
    """Signed dihedral of four atoms in [-180, 180)."""
    a, b, c, d = (atom(coords, i) for i in atoms)
    b1, b2, b3 = minus(b, a), minus(c, b), minus(d, c)
    n1, n2 = cross(b1, b2), cross(b2, b3)
    l1, l2, lb = norm(n1), norm(n2), norm(b2)
    # lengths other than the axis' cancel out; unit vectors would make the expression many times as long.
    # the sign convention: looking along the axis, clockwise is negative
    angle = F.lit(0.0) - F.degrees(F.atan2(lb * dot(b1, n2), dot(n1, n2)))
    value = F.when(angle >= 180.0, angle - 360.0).otherwise(angle)
    bad = (lb < SHORTEST) | (l1 < SHORTEST) | (l2 < SHORTEST)
    return _guarded(bad, value, "dihedral: atoms are collinear or coincide", on_degenerate)


def plane_normal3(coords: Column, atoms: tuple[int, int, int], on_degenerate: str = "error") -> Column:
    """Unit normal of the plane of three atoms, oriented by their order."""
    a, b, c = (atom(coords, i) for i in atoms)
    n = cross(minus(b, a), minus(c, a))
    size = norm(n)
    bad = size < SHORTEST
    unit = over(n, size)
    x = _guarded(bad, unit[0], "plane: atoms are collinear", on_degenerate)
    return F.when(x.isNotNull(), F.array(x, unit[1], unit[2]))
