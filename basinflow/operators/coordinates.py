"""Coordinates of frames: computed columns, shifts, pair transforms and the long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.binning import missing

#: Coordinate types computed from atoms, with the number of atoms each takes.
ATOM_TYPES = {"dihedral": 4, "distance": 2, "angle": 3}


def coordinate(coords: Column, kind: str, atoms: Sequence[int], on_degenerate: str = "error") -> Column:
    """One coordinate of a structure, single precision."""
    if kind not in ATOM_TYPES:
        raise ValueError(f"coordinate type {kind!r} can't be computed; one of {', '.join(ATOM_TYPES)}")
    if len(atoms) < ATOM_TYPES[kind] or min(atoms) < 0:
        raise ValueError(f"a {kind} needs {ATOM_TYPES[kind]} atom ids from 0 on; got {list(atoms)}")
    use = tuple(atoms[: ATOM_TYPES[kind]])
    if kind == "dihedral":
        value = geometry.dihedral(coords, use, on_degenerate)
        narrow = value.cast("float")
        # narrowing may round up to +180, which the half-open domain excludes
        return F.when(narrow >= 180.0, F.lit(-180.0).cast("float")).otherwise(narrow)
    value = geometry.distance(coords, use) if kind == "distance" else geometry.bond_angle(coords, use, on_degenerate)
    return value.cast("float")


def add_coordinates(frames: DataFrame, coords: str, specs: Mapping[str, tuple[str, Sequence[int]]], on_degenerate: str = "error", keep_coords: bool = False) -> DataFrame:
    """frames with a column for each named (type, atoms); atoms beyond the structure are an error."""
    most = max((max(atoms) for _, atoms in specs.values()), default=-1)
    checked = F.when(F.size(coords) >= 3 * (most + 1), F.col(coords)).otherwise(F.raise_error(F.lit(f"a structure lacks atom {most}")).cast(frames.schema[coords].dataType))
    out = frames.withColumn("_coords", checked)
    out = out.withColumns({name: coordinate(F.col("_coords"), kind, atoms, on_degenerate) for name, (kind, atoms) in specs.items()}).drop("_coords")
    return out if keep_coords else out.drop(coords)


def add_shifted(frames: DataFrame, shifts: Mapping[str, float]) -> DataFrame:
    """A wrapped ``<name>_shifted`` companion, single precision, of each shifted column that exists."""
    new = {f"{c}_shifted": geometry.shift(F.col(c).cast("double"), d).cast("float") for c, d in shifts.items() if c in frames.columns}
    return frames.withColumns(new) if new else frames


Pair = tuple[Column, Column]


def _center(p: Pair, v: float) -> Pair:
    return geometry.wrap(p[0] - F.lit(v)), p[1]


def _fold(p: Pair, v: float) -> Pair:
    x, y = p
    return F.when(x < -1e-9, -x).otherwise(x), F.when(x < -1e-9, -y).when(F.abs(x) <= 1e-9, F.abs(y)).otherwise(y)


def _restrict(p: Pair, v: float) -> Pair:
    x, y = p
    gone = missing(y) | (y < 0)
    return F.when(~gone, x), F.when(~gone, y)


def _shift(p: Pair, v: float) -> Pair:
    return geometry.wrap(p[0] + F.lit(v)), p[1]


PAIR_TRANSFORMS = {"center_x_at": _center, "fold_sign_symmetry": _fold, "restrict_positive_y": _restrict, "shift_x": _shift}


def transform_pair(frames: DataFrame, x: str, y: str, steps: Sequence[tuple[str, float]]) -> DataFrame:
    """frames with x and y moved by the named steps in order; a restricted pair is null."""
    unknown = [s for s, _ in steps if s not in PAIR_TRANSFORMS]
    if unknown:
        raise ValueError(f"unknown pair transforms {unknown}; one of {', '.join(PAIR_TRANSFORMS)}")

    def step(df: DataFrame, spec: tuple[str, float]) -> DataFrame:
        nx, ny = PAIR_TRANSFORMS[spec[0]]((F.col(x), F.col(y)), float(spec[1]))
        return df.withColumns({x: nx, y: ny})

    return reduce(step, steps, frames.withColumns({x: F.col(x).cast("double"), y: F.col(y).cast("double")}))


def long_form(frames: DataFrame, keys: Sequence[str], names: Sequence[str], labels: Mapping[str, str] | None = None, types: Mapping[str, str] | None = None) -> DataFrame:
    """(keys..., dof_name, dof_value, dof_label, dof_type): one row for each frame and coordinate."""
    typed = frames.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
    out = typed.unpivot(list(keys), list(names), "dof_name", "dof_value")

    def looked_up(values: Mapping[str, str] | None, default: Column) -> Column:
        pairs = [F.lit(v) for item in (values or {}).items() for v in item]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("dof_name")), default) if pairs else default

    return out.withColumn("dof_label", looked_up(labels, F.col("dof_name"))).withColumn("dof_type", looked_up(types, F.lit(None).cast("string")))


def normalised(table: DataFrame, dihedrals: Sequence[str], required: Sequence[str]) -> DataFrame:
    """A ready-made table with its dihedrals wrapped, single precision; an error if a required column is missing."""
    lacking = [c for c in required if c not in table.columns]
    if lacking:
        raise ValueError(f"the table lacks the columns {lacking}")
    return table.withColumns({c: geometry.wrap(F.col(c).cast("double")).cast("float") for c in dihedrals if c in table.columns})
