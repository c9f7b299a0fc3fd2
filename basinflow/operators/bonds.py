"""Bonds of a reference frame, and cutting trajectories where one breaks."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from .grouping import join_groups

# Published covalent radii in angstrom by element, and the radius of any other.
COVALENT_RADII = {
    "H": 0.31, "B": 0.84, "C": 0.76, "N": 0.71, "O": 0.66, "F": 0.57, "Si": 1.11,
    "P": 1.07, "S": 1.05, "Cl": 1.02, "Br": 1.20, "I": 1.39, "Se": 1.20, "Te": 1.38,
}
OTHER_RADIUS = 0.77
BOND_TOLERANCE = 1.1


def atom_rows(frames: DataFrame, keys: Sequence[str], coords: str) -> DataFrame:
    """(keys..., atom, x, y, z): one row for each atom of a frame."""
    n = F.floor(F.size(coords) / 3).cast("int")
    at = frames.select(*keys, F.col(coords).alias("_c"), F.explode(F.sequence(F.lit(0), n - 1)).alias("atom")).where(F.col("atom") >= 0)
    return at.select(*keys, "atom", *[F.get("_c", 3 * F.col("atom") + k).cast("double").alias(a) for k, a in enumerate("xyz")])


def bond_graph(frames: DataFrame, keys: Sequence[str], coords: str, reach: Column | float) -> DataFrame:
    """(keys..., i, j, distance) of the atom pairs of each frame closer than ``reach``.

    Pairs are made inside a row by array functions: no join and no shuffle.
    """
    n = F.floor(F.size("_c") / 3).cast("int")
    get = lambda i, k: F.get("_c", 3 * F.col(i) + k).cast("double")
    rows = frames.select(*keys, F.col(coords).alias("_c"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), n - 2))).withColumn("j", F.explode(F.sequence(F.col("i") + 1, n - 1)))
    d2 = sum(((get("i", k) - get("j", k)) ** 2 for k in range(1, 3)), (get("i", 0) - get("j", 0)) ** 2)
    reach = F.lit(reach) if isinstance(reach, (int, float)) else reach
    return rows.select(*keys, "i", "j", F.sqrt(d2).alias("distance")).where(F.col("distance") < reach)


def broken(coords: str, bonds: Sequence[tuple[int, int]], cutoff: float) -> Column:
    """Whether a bond of the structure is longer than the cutoff."""
    longest = [geometry.distance(F.col(coords), b).cast("float") for b in bonds]
    return F.greatest(*longest, F.lit(0.0).cast("float"), F.lit(0.0).cast("float")) > F.lit(cutoff).cast("float") if bonds else F.lit(False)


def broken_by(coords: str, pairs: str, cutoff: float) -> Column:
    """Whether a bond of an array of atom pairs (i, j) is longer than the cutoff; without pairs none is."""
    at = lambda i, k: F.get(F.col(coords), 3 * i + k).cast("double")
    far = lambda p: F.sqrt(sum(((at(p["i"], k) - at(p["j"], k)) ** 2 for k in range(1, 3)), (at(p["i"], 0) - at(p["j"], 0)) ** 2))
    return F.coalesce(F.exists(F.col(pairs), lambda p: far(p).cast("float") > F.lit(cutoff).cast("float")), F.lit(False))


def radius(element: Column) -> Column:
    """Covalent radius of an element."""
    table = F.create_map(*[F.lit(v) for pair in COVALENT_RADII.items() for v in pair])
    return F.coalesce(F.element_at(table, element), F.lit(OTHER_RADIUS))


def near_atoms(atoms: DataFrame, keys: Sequence[str], reach: float, carry: Sequence[str] = ()) -> DataFrame:
    """(keys..., i, j, distance, and i_c, j_c of carried columns) of the atoms of each frame closer than ``reach``, i < j.

    ``atoms`` are rows (keys, atom, x, y, z). Atoms fall into cells as wide as the reach
    and meet those of their own cell and of 13 of the 26 around it, so that each pair
    meets once: for structures too large to make their pairs inside a row. Null keys are
    frames of their own; atoms with a missing or non-finite coordinate have no bonds.
    """
    if not reach > 0:
        raise ValueError(f"the reach must be positive; got {reach}")
    cell = [F.floor(F.col(c) / F.lit(float(reach))).cast("long").alias(f"_{c}") for c in "xyz"]
    finite = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    rows = atoms.where(finite("x") & finite("y") & finite("z")).select(F.struct(F.lit(0).alias("_"), *keys).alias("_frame"), F.struct("atom", "x", "y", "z", *carry).alias("_a"), *cell)
    ahead = [s for s in product((-1, 0, 1), repeat=3) if s >= (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", s)]) for s in ahead])
    left = rows.withColumn("_s", F.explode(steps)).select("_frame", F.col("_a").alias("_p"), *[(F.col(f"_{c}") + F.col(f"_s.{c}")).alias(f"_{c}") for c in "xyz"], ((F.col("_s.x") == 0) & (F.col("_s.y") == 0) & (F.col("_s.z") == 0)).alias("_own"))
    met = left.join(rows, ["_frame", "_x", "_y", "_z"]).where(~F.col("_own") | (F.col("_p.atom") < F.col("_a.atom")))
    swap = F.col("_p.atom") < F.col("_a.atom")
    met = met.select("_frame", F.when(swap, F.col("_p")).otherwise(F.col("_a")).alias("_p"), F.when(swap, F.col("_a")).otherwise(F.col("_p")).alias("_a"))
    off = [F.col(f"_p.{c}") - F.col(f"_a.{c}") for c in "xyz"]
    distance = F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])
    named = [F.col(f"_{side}.{c}").alias(f"{n}_{c}") for c in carry for side, n in (("p", "i"), ("a", "j"))]
    out = met.select(*[F.col(f"_frame.{k}").alias(k) for k in keys], F.col("_p.atom").alias("i"), F.col("_a.atom").alias("j"), distance.alias("distance"), *named)
    return out.where(F.col("distance") < float(reach))


def radii_bonds(structures: DataFrame, keys: Sequence[str], elements: str, coords: str) -> DataFrame:
    """(keys..., i, j, distance): atoms closer than the sum of their covalent radii, with a tolerance."""
    n = F.floor(F.size(coords) / 3).cast("int")
    rows = structures.select(*keys, F.col(elements).alias("_e"), F.col(coords).alias("_c"), F.explode(F.sequence(F.lit(0), n - 1)).alias("atom")).where(F.col("atom") >= 0)
    atoms = rows.select(*keys, "atom", radius(F.get("_e", F.col("atom"))).alias("r"), *[F.get("_c", 3 * F.col("atom") + k).cast("double").alias(a) for k, a in enumerate("xyz")])
    widest = 2 * max(OTHER_RADIUS, *COVALENT_RADII.values()) * BOND_TOLERANCE
    met = near_atoms(atoms, keys, widest, ["r"])
    return met.where(F.col("distance") < (F.col("i_r") + F.col("j_r")) * BOND_TOLERANCE).drop("i_r", "j_r")


def reference_bonds(structures: DataFrame, keys: Sequence[str], elements: str, coords: str) -> DataFrame:
    """(keys..., bonds array<struct<i, j>>) of structures, a row each: by covalent radii; an empty array without bonds."""
    found = radii_bonds(structures, keys, elements, coords).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("bonds"))
    none = F.array().cast("array<struct<i: int, j: int>>")
    return join_groups(structures.select(*keys), found, keys, how="left").withColumn("bonds", F.coalesce("bonds", none))


def first_broken_frame(frames: DataFrame, coords: str, bonds: Sequence[tuple[int, int]], cutoff: float, frame: str, group: Sequence[str]) -> DataFrame:
    """(group..., first_broken): null where no bond breaks."""
    return frames.groupBy(*group).agg(F.min(F.when(broken(coords, bonds, cutoff), F.col(frame))).alias("first_broken"))


def cut_at_break(frames: DataFrame, is_broken: Column, frame: str, stream: Sequence[str], trajectory: Sequence[str]) -> DataFrame:
    """frames of each trajectory before the earliest break of any of its streams.

    A stream without a break counts as breaking after its last frame, so all streams of
    a trajectory end alike.
    """
    marked = frames.withColumn("_broken", is_broken)
    ends = marked.groupBy(*dict.fromkeys((*trajectory, *stream))).agg(F.coalesce(F.min(F.when(F.col("_broken"), F.col(frame))), F.max(frame) + 1).alias("_end"))
    stops = ends.groupBy(*trajectory).agg(F.min("_end").alias("_stop"))
    return join_groups(marked, stops, trajectory).where(F.col(frame) < F.col("_stop")).drop("_broken", "_stop")


def frame_range(frames: DataFrame, frame: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Frames start to end, both included; without an end all from start on."""
    if start < 0 or (end is not None and end < start):
        raise ValueError(f"a frame range needs 0 <= start <= end; got {start}, {end}")
    out = frames.where(F.col(frame) >= start)
    return out if end is None else out.where(F.col(frame) <= end)
