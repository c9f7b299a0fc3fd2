"""Registered queries of the coordinate engine and their DuckDB oracles.

The tables hold no molecular data, so they are bound to the model: ``embeddings`` are
structures of 21 atoms, ``lineitem`` is a landscape of two coordinates, ``events`` are
state sequences of beads in trajectories.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import binning, energy, geometry, labels
from .operators import bonds, coordinates, dbscan, density, grid_states, overlay, structures, table, transitions
from .plans import sqltext as S
from .session import work_dir
from .sources import tables, xyz
from .sources.files import discover

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    """Query name to ``(spark, sf_dir) -> DataFrame``."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL over the same tables."""
    return dict(_ORACLES)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- population maps

X_EDGES = binning.linear_edges(0.0, 50.0, 10)
Y_EDGES = binning.linear_edges(0.0, 0.1, 5)
_XI, _YI = S.bin_index("l_quantity", X_EDGES), S.bin_index("l_discount", Y_EDGES)
_CELLS = f"SELECT {_XI} AS xi, {_YI} AS yi, count(*) AS count FROM lineitem WHERE {_XI} >= 0 AND {_YI} >= 0 GROUP BY ALL"
_GROUP = ("l_returnflag", "l_linestatus")
_ORDER = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.cells(_read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", X_EDGES, Y_EDGES)


@query(_CELLS)
def density_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


_GROUP_CELLS = f"SELECT l_returnflag, l_linestatus, {_XI} AS xi, {_YI} AS yi, count(*) AS count FROM lineitem WHERE {_XI} >= 0 AND {_YI} >= 0 GROUP BY ALL"


@query(_GROUP_CELLS)
def density_cells_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.cells(_read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", X_EDGES, Y_EDGES, _GROUP)


_FINE = binning.linear_edges(0.0, 60.0, 24)


@query(f"""WITH c AS (SELECT {S.bin_index("l_quantity", _FINE)} AS xi, {_YI} AS yi, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT x.i::INT AS xi, y.i::INT AS yi, coalesce(n, 0)::BIGINT AS count FROM range(24) x(i) CROSS JOIN range(5) y(i) LEFT JOIN c ON c.xi = x.i AND c.yi = y.i""")
def density_dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = density.cells(_read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", _FINE, Y_EDGES)
    return density.dense(found, 24, 5)


@query(f"SELECT xi, yi, count, round(log10(count + 1), 6) AS log_count FROM ({_CELLS})")
def density_log_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.log_scale(_cells(spark, sf_dir)).withColumn("log_count", F.round("log_count", 6))


@query(f"SELECT xi, yi, count, round(ln(max(count) OVER () / count), 6) AS free_energy FROM ({_CELLS})")
def free_energy_kt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.free_energy(_cells(spark, sf_dir)).withColumn("free_energy", F.round("free_energy", 6))


_BY_GROUP_ENERGY = ", ".join(f'round({S.number(energy.thermal_energy(u, 300.0))} * ln(max(count) OVER (PARTITION BY l_returnflag, l_linestatus) / count), 6) AS "{u}"' for u in ("kJ/mol", "kcal/mol", "eV", "meV", "cm^-1"))


@query(f"SELECT l_returnflag, l_linestatus, xi, yi, count, {_BY_GROUP_ENERGY} FROM ({_GROUP_CELLS})")
def free_energy_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = density.free_energy(density_cells_by_group(spark, sf_dir), "kT", None, _GROUP)
    for unit in ("kJ/mol", "kcal/mol", "eV", "meV", "cm^-1"):
        out = out.withColumn(unit, F.round(F.lit(energy.thermal_energy(unit, 300.0)) * F.col("free_energy"), 6))
    return out.drop("free_energy")


_ODD = binning.stepped_edges(0.0, 0.08, 0.01)
_ODD_VALUE = "CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN l_discount - 0.02::DOUBLE ELSE l_discount END"


@query(f"SELECT {S.bin_index(f'({_ODD_VALUE})', _ODD)} AS i, {S.clipped_index(f'({_ODD_VALUE})', _ODD)} AS clipped, count(*) AS n FROM lineitem GROUP BY ALL")
def bin_index_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber")
    v = F.when(number == 3, F.lit(None)).when(number == 4, F.col("l_discount") - F.lit(0.02)).otherwise(F.col("l_discount"))
    frames = _read(spark, sf_dir, "lineitem").select(v.alias("v"))
    return frames.select(binning.bin_index(F.col("v"), _ODD).alias("i"), binning.clipped_index(F.col("v"), _ODD).alias("clipped")).groupBy("i", "clipped").agg(F.count(F.lit(1)).alias("n"))


_DX, _DY = f"(l_quantity - {S.bin_centre('xi', X_EDGES)})", f"(l_discount - {S.bin_centre('yi', Y_EDGES)})"
_REPRESENTATIVES = f"""SELECT xi, yi, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, d AS distance2 FROM (
SELECT *, row_number() OVER (PARTITION BY xi, yi ORDER BY d, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS nth FROM (
SELECT *, {_DX} * {_DX} + {_DY} * {_DY} AS d FROM (SELECT *, {_XI} AS xi, {_YI} AS yi FROM lineitem) WHERE xi >= 0 AND yi >= 0)) WHERE nth = 1"""


@query(_REPRESENTATIVES)
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.representatives(_read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", X_EDGES, Y_EDGES, _ORDER)


@query(f"SELECT r.*, o_orderstatus, o_custkey FROM ({_REPRESENTATIVES}) r LEFT JOIN orders ON o_orderkey = l_orderkey")
def representative_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = representatives(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey")
    out = density.with_metadata(chosen, _read(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderstatus", "o_custkey"])
    return out.withColumnRenamed("o_orderkey", "l_orderkey")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount FROM lineitem
ORDER BY (l_quantity - 20.4::DOUBLE) * (l_quantity - 20.4::DOUBLE) + (l_discount - 0.052::DOUBLE) * (l_discount - 0.052::DOUBLE), l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 1""")
def nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.nearest_frame(_read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", (20.4, 0.052), _ORDER).select(*_ORDER, "l_quantity", "l_discount")


@query("""SELECT s_suppkey, l_orderkey, l_partkey, l_suppkey, l_linenumber, round(d, 6) AS distance2 FROM (
SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS nth FROM (
SELECT s_suppkey, l_orderkey, l_partkey, l_suppkey, l_linenumber, (x - px) * (x - px) + (y - py) * (y - py) AS d
FROM (SELECT s_suppkey, s_acctbal::DOUBLE / 100 AS px, s_nationkey * 2.5::DOUBLE AS py FROM supplier)
CROSS JOIN (SELECT *, l_extendedprice::DOUBLE / 1000 AS x, l_quantity::DOUBLE AS y FROM lineitem))) WHERE nth = 1""")
def nearest_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame nearest to each of many pins."""
    frames = _read(spark, sf_dir, "lineitem").select(*_ORDER, (F.col("l_extendedprice").cast("double") / 1000).alias("x"), F.col("l_quantity").cast("double").alias("y"))
    pins = _read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal").cast("double") / 100).alias("px"), (F.col("s_nationkey") * 2.5).alias("py"))
    found = density.nearest_frames(frames, "x", "y", pins, "px", "py", _ORDER)
    return found.select("s_suppkey", *_ORDER, F.round("distance2", 6).alias("distance2"))


# ---------------------------------------------------------------- coordinates of structures

_STRUCTURE = ("SELECT vec_id, label, embedding AS e FROM embeddings")


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_number"), F.col("label").alias("trajectory_id"), F.slice("embedding", 1, 63).alias("coords"))


def _xyz(i: int) -> list[str]:
    return [f"e[{3 * i + k + 1}]::DOUBLE" for k in range(3)]


def _minus(i: int, j: int) -> list[str]:
    return [f"({a} - {b})" for a, b in zip(_xyz(i), _xyz(j))]


def _sqldot(u: list[str], v: list[str]) -> str:
    return " + ".join(f"{a} * {b}" for a, b in zip(u, v))


def _sqlnorm(u: list[str]) -> str:
    return f"sqrt({_sqldot(u, u)})"


_PHI, _PSI = (6, 5, 10, 7), (5, 6, 12, 11)


@query(f"SELECT vec_id AS frame_number, round({S.dihedral('e', _PHI)}, 3) AS phi, round({S.dihedral('e', _PSI)}, 3) AS psi FROM ({_STRUCTURE})")
def dof_dihedral(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("coords")
    return _structures(spark, sf_dir).select("frame_number", F.round(geometry.dihedral(c, _PHI), 3).alias("phi"), F.round(geometry.dihedral(c, _PSI), 3).alias("psi"))


@query(f"SELECT vec_id AS frame_number, round({_sqlnorm(_minus(4, 2))}, 6) AS d FROM ({_STRUCTURE})")
def dof_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structures(spark, sf_dir).select("frame_number", F.round(geometry.distance(F.col("coords"), (2, 4)), 6).alias("d"))


_COS = f"({_sqldot(_minus(1, 3), _minus(8, 3))}) / {_sqlnorm(_minus(1, 3))} / {_sqlnorm(_minus(8, 3))}"


@query(f"SELECT vec_id AS frame_number, round(degrees(acos(greatest(-1.0, least(1.0, {_COS})))), 5) AS a FROM ({_STRUCTURE})")
def dof_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structures(spark, sf_dir).select("frame_number", F.round(geometry.bond_angle(F.col("coords"), (1, 3, 8)), 5).alias("a"))


@query(f"""WITH w AS (SELECT vec_id, {_sqlnorm(_minus(4, 2))} AS span, degrees(acos(greatest(-1.0, least(1.0, {_COS})))) AS bend FROM ({_STRUCTURE}))
SELECT vec_id AS frame_number, 'span' AS dof_name, round(span::FLOAT::DOUBLE, 4) AS dof_value, 'End to end' AS dof_label, 'distance' AS dof_type FROM w
UNION ALL SELECT vec_id, 'bend', round(bend::FLOAT::DOUBLE, 4), 'bend', 'angle' FROM w""")
def dof_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = coordinates.add_coordinates(_structures(spark, sf_dir), "coords", {"span": ("distance", (2, 4)), "bend": ("angle", (1, 3, 8))})
    out = coordinates.long_form(frames, ["frame_number"], ["span", "bend"], {"span": "End to end"}, {"span": "distance", "bend": "angle"})
    return out.withColumn("dof_value", F.round("dof_value", 4))


def _sqlcross(u: list[str], v: list[str]) -> list[str]:
    return [f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"]


_NORMAL = _sqlcross(_minus(2, 1), _minus(3, 1))


@query(f"SELECT vec_id AS frame_number, {', '.join(f'round({n} / {_sqlnorm(_NORMAL)}, 6) AS {k}' for n, k in zip(_NORMAL, ('nx', 'ny', 'nz')))} FROM ({_STRUCTURE})")
def plane_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = geometry.plane_normal3(F.col("coords"), (1, 2, 3))
    return _structures(spark, sf_dir).select("frame_number", n.alias("n")).select("frame_number", *[F.round(F.get("n", F.lit(k)), 6).alias(a) for k, a in enumerate(("nx", "ny", "nz"))])


_PLANE = (0, 3, 5, 8, 9)


@query(f"SELECT frame_number, round(x, 5) AS nx, round(y, 5) AS ny, round(z, 5) AS nz FROM ({S.best_plane(f'SELECT vec_id AS frame_number, e FROM ({_STRUCTURE})', 'frame_number', 'e', _PLANE)})")
def best_fit_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = structures.plane_normals(_structures(spark, sf_dir), "coords", _PLANE, "normal")
    return frames.select("frame_number", *[F.round(F.get("normal", F.lit(k)), 5).alias(a) for k, a in enumerate(("nx", "ny", "nz"))])


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _structures(spark, sf_dir)
    return structures.align(frames, "coords", frames.orderBy("frame_number").limit(1))


@query(f"""SELECT frame_number, atom, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z FROM ({S.laid_on_first(f'SELECT vec_id AS frame_number, e FROM ({_STRUCTURE})', 'frame_number', 'e', 21)})""")
def kabsch_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = bonds.atom_rows(_aligned(spark, sf_dir), ["frame_number"], "aligned")
    return atoms.select("frame_number", "atom", *[(F.round(a, 4) + 0.0).alias(a) for a in "xyz"])


@query(f"SELECT frame_number, round(rmsd, 5) AS rmsd FROM ({S.least_rmsd(f'SELECT vec_id AS frame_number, e FROM ({_STRUCTURE})', 'frame_number', 'e', 21)})")
def kabsch_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("frame_number", F.round("rmsd", 5).alias("rmsd"))


# exact angles: whole degrees derived from keys
_AX, _AY = "((l_partkey * 37) % 360 - 180)", "((l_suppkey * 53) % 360 - 180)"


def _angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") * 37) % 360 - 180, (F.col("l_suppkey") * 53) % 360 - 180
    return _read(spark, sf_dir, "lineitem").select(*_ORDER, *_GROUP, x.cast("double").alias("x"), y.cast("double").alias("y"))


@query(f"SELECT {S.wrap(f'({_AX} * 3)::DOUBLE')} AS wrapped, count(*) AS n FROM lineitem GROUP BY ALL")
def angle_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _angles(spark, sf_dir).groupBy(geometry.wrap(F.col("x") * 3).alias("wrapped")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_AX}::FLOAT AS x, {S.wrap(f'({_AX} + 90.0)')}::FLOAT AS x_shifted, {S.wrap(f'({_AY} - 45.0)')}::FLOAT AS y_shifted, count(*) AS n FROM lineitem GROUP BY ALL")
def coordinate_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = coordinates.add_shifted(_angles(spark, sf_dir), {"x": 90.0, "y": -45.0, "absent": 1.0})
    return frames.groupBy(F.col("x").cast("float").alias("x"), "x_shifted", "y_shifted").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {S.wrap(f'({_AX} * 3)::DOUBLE')}::FLOAT AS phi, ({_AY})::DOUBLE AS d, count(*) AS n FROM lineitem GROUP BY ALL")
def table_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ready-made table: its dihedrals wrapped, in single precision; other columns as they are."""
    ready = _angles(spark, sf_dir).select((F.col("x") * 3).alias("phi"), F.col("y").alias("d"))
    return coordinates.normalised(ready, ["phi", "absent"], ["phi", "d"]).groupBy("phi", "d").agg(F.count(F.lit(1)).alias("n"))


def _pairs(spark: SparkSession, sf_dir: str, steps: list[tuple[str, float]]) -> DataFrame:
    return coordinates.transform_pair(_angles(spark, sf_dir), "x", "y", steps).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


_BASE = f"SELECT {_AX}::DOUBLE AS x, {_AY}::DOUBLE AS y FROM lineitem"
_CENTERED = f"SELECT {S.wrap('(x - 90.0)')} AS x, y FROM ({{}})"
_FOLDED = "SELECT CASE WHEN x < -1e-9 THEN -x ELSE x END AS x, CASE WHEN x < -1e-9 THEN -y WHEN abs(x) <= 1e-9 THEN abs(y) ELSE y END AS y FROM ({})"
_RESTRICTED = "SELECT CASE WHEN y >= 0 THEN x END AS x, CASE WHEN y >= 0 THEN y END AS y FROM ({})"
_MOVED = f"SELECT {S.wrap('(x - 90.0)')} AS x, y FROM ({{}})"
_TALLY = "SELECT x, y, count(*) AS n FROM ({}) GROUP BY ALL"


@query(_TALLY.format(_CENTERED.format(_BASE)))
def pair_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, [("center_x_at", 90.0)])


# -0.0 and 0.0 are one value to both engines' grouping, but not to a value hash
@query(f"SELECT x, y + 0.0 AS y, n FROM ({_TALLY.format(_FOLDED.format(_BASE))})")
def pair_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, [("fold_sign_symmetry", 0.0)]).withColumn("y", F.col("y") + F.lit(0.0))


@query(_TALLY.format(_RESTRICTED.format(_BASE)))
def pair_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, [("restrict_positive_y", 0.0)])


@query(_TALLY.format(_MOVED.format(_BASE)))
def pair_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, [("shift_x", -90.0)])


@query(f"SELECT x, y + 0.0 AS y, n FROM ({_TALLY.format(_MOVED.format(_RESTRICTED.format(_FOLDED.format(_CENTERED.format(_BASE)))))})")
def pair_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("center_x_at", 90.0), ("fold_sign_symmetry", 0.0), ("restrict_positive_y", 0.0), ("shift_x", -90.0)]
    return _pairs(spark, sf_dir, steps).withColumn("y", F.col("y") + F.lit(0.0))


# ---------------------------------------------------------------- bonds and frame ranges

_REACH = 0.12
_ATOMS = "SELECT vec_id, label, a.i, e[3*a.i+1]::DOUBLE AS x, e[3*a.i+2]::DOUBLE AS y, e[3*a.i+3]::DOUBLE AS z FROM (SELECT vec_id, label, embedding AS e FROM embeddings) CROSS JOIN range(21) a(i)"


@query(f"""SELECT p.vec_id AS frame_number, p.i::INT AS i, q.i::INT AS j, round(sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z)), 6) AS distance
FROM ({_ATOMS}) p JOIN ({_ATOMS}) q ON p.vec_id = q.vec_id AND p.i < q.i
WHERE sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z)) < {_REACH}""")
def bond_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bonds.bond_graph(_structures(spark, sf_dir), ["frame_number"], "coords", _REACH).withColumn("distance", F.round("distance", 6))


@query(f"""SELECT p.vec_id AS frame_number, p.i::INT AS i, q.i::INT AS j, round(sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z)), 6) AS distance
FROM ({_ATOMS}) p JOIN ({_ATOMS}) q ON p.vec_id = q.vec_id AND p.i < q.i
WHERE sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z)) < {_REACH}""")
def bond_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bond graph by cells, for structures of any size."""
    atoms = bonds.atom_rows(_structures(spark, sf_dir), ["frame_number"], "coords")
    return bonds.near_atoms(atoms, ["frame_number"], _REACH).withColumn("distance", F.round("distance", 6))


_ELEMENTS = ("C", "H", "N", "Cl", "Xx")
_RADII = "list_extract([" + ", ".join(S.number(bonds.COVALENT_RADII.get(e, bonds.OTHER_RADIUS)) for e in _ELEMENTS) + "], (i % 5)::INT + 1)"
_SIZED = f"SELECT vec_id, i, 6 * x AS x, 6 * y AS y, 6 * z AS z, {_RADII} AS r FROM ({_ATOMS})"


@query(f"""SELECT p.vec_id AS frame_number, p.i::INT AS i, q.i::INT AS j FROM ({_SIZED}) p JOIN ({_SIZED}) q ON p.vec_id = q.vec_id AND p.i < q.i
WHERE sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z)) < (p.r + q.r) * {S.number(bonds.BOND_TOLERANCE)}""")
def bond_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds by covalent radii; the structures' atoms are given elements in turn."""
    frames = _structures(spark, sf_dir).withColumn("coords", F.transform("coords", lambda v: v.cast("double") * 6))
    elements = F.lit([_ELEMENTS[i % len(_ELEMENTS)] for i in range(21)])
    return bonds.radii_bonds(frames.withColumn("elements", elements), ["frame_number"], "elements", "coords").drop("distance")


_BONDS = [(0, 1), (2, 5), (7, 11)]
_BROKEN = " OR ".join(f"({_sqlnorm(_minus(j, i))})::FLOAT > 0.62::FLOAT" for i, j in _BONDS)


@query(f"SELECT label AS trajectory_id, min(CASE WHEN {_BROKEN} THEN vec_id END) AS first_broken FROM ({_STRUCTURE}) GROUP BY label")
def first_broken_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bonds.first_broken_frame(_structures(spark, sf_dir), "coords", _BONDS, 0.62, "frame_number", ["trajectory_id"])


@query(f"""WITH f AS (SELECT vec_id, label % 3 AS t, label AS b, ({_BROKEN}) AS broken FROM ({_STRUCTURE})),
ends AS (SELECT t, b, coalesce(min(CASE WHEN broken THEN vec_id END), max(vec_id) + 1) AS stop FROM f GROUP BY t, b),
stops AS (SELECT t, min(stop) AS stop FROM ends GROUP BY t)
SELECT f.t AS trajectory_id, f.b AS bead_id, vec_id AS frame_number FROM f JOIN stops USING (t) WHERE vec_id < stop""")
def bond_break_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _structures(spark, sf_dir).withColumn("bead_id", F.col("trajectory_id")).withColumn("trajectory_id", F.col("bead_id") % 3)
    out = bonds.cut_at_break(frames, bonds.broken("coords", _BONDS, 0.62), "frame_number", ["bead_id"], ["trajectory_id"])
    return out.select("trajectory_id", "bead_id", "frame_number")


@query("SELECT conv_id, turn, role FROM conversations WHERE turn BETWEEN 1 AND 3")
def frame_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bonds.frame_range(_read(spark, sf_dir, "conversations"), "turn", 1, 3).select("conv_id", "turn", "role")


# ---------------------------------------------------------------- states

_DOMAIN = (-180.0, 180.0)


def _per_cell(step: float, share: float, keys: str = "") -> str:
    """CTEs of the occupied cells of the angle landscape: more than a share of the rows each."""
    edges = binning.stepped_edges(*_DOMAIN, step)
    x, y = S.bin_index(f"{_AX}::DOUBLE", edges), S.bin_index(f"{_AY}::DOUBLE", edges)
    part = f"{keys}, " if keys else ""
    return f"occupied AS (SELECT {part}{x} AS xi, {y} AS yi, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) >= {share})"


def _grid_oracle(step: float, least: int, periodic: bool, keys: tuple[str, ...] = (), cells_only: bool = False) -> str:
    n = len(binning.stepped_edges(*_DOMAIN, step)) - 1
    k = ", ".join(keys)
    head = f"WITH RECURSIVE {_per_cell(step, least, k)}, {S.components('occupied', n, n, periodic, keys)}"
    part = f"{k}, " if k else ""
    if cells_only:
        return f"{head} SELECT {part}xi::INT AS xi, yi::INT AS yi, count, component FROM numbered JOIN occupied USING ({part}xi, yi)"
    edges = binning.stepped_edges(*_DOMAIN, step)
    x, y = S.bin_index(f"{_AX}::DOUBLE", edges), S.bin_index(f"{_AY}::DOUBLE", edges)
    return f"""{head}, placed AS (SELECT {part}{x} AS xi, {y} AS yi FROM lineitem)
SELECT {"".join(f"p.{c}, " for c in keys)} coalesce(component::VARCHAR, 'noise') AS state, count(*) AS frames FROM placed p LEFT JOIN numbered n USING ({part}xi, yi) GROUP BY ALL"""


def _states(spark: SparkSession, sf_dir: str, step: float, least: int, periodic: bool, group: tuple[str, ...] = ()) -> DataFrame:
    frames = _angles(spark, sf_dir)
    out = grid_states.assign_grid_states(frames, "x", "y", "state", step=step, min_count=least, x_domain=_DOMAIN, y_domain=_DOMAIN, group=group, periodic=periodic)
    return grid_states.state_summary(out, "state", group)


@query(_grid_oracle(30.0, 420, False, cells_only=True))
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_states.labelled_cells(_angles(spark, sf_dir), "x", "y", step=30.0, min_count=420, x_domain=_DOMAIN, y_domain=_DOMAIN)


@query(_grid_oracle(5.0, 7, True, _GROUP[:1], cells_only=True))
def grid_cells_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a finer grid, labelled in tiles that are united over their borders."""
    return grid_states.labelled_cells(_angles(spark, sf_dir), "x", "y", step=5.0, min_count=7, x_domain=_DOMAIN, y_domain=_DOMAIN, group=_GROUP[:1], periodic=True, tile=16)


@query(_grid_oracle(30.0, 420, False))
def grid_states_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir, 30.0, 420, False)


@query(_grid_oracle(30.0, 420, True))
def grid_states_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir, 30.0, 420, True)


@query(_grid_oracle(15.0, 105, True))
def grid_states_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir, 15.0, 105, True)


@query(_grid_oracle(30.0, 135, False, _GROUP))
def grid_states_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir, 30.0, 135, False, _GROUP)


_NARROW = (-100.0, 100.0)
_NARROW_EDGES = binning.stepped_edges(*_NARROW, 25.0)
_NB = len(_NARROW_EDGES) - 1


@query(f"""WITH RECURSIVE occupied AS (SELECT {S.bin_index(f"{_AX}::DOUBLE", _NARROW_EDGES)} AS xi, {S.bin_index(f"{_AY}::DOUBLE", _NARROW_EDGES)} AS yi, count(*) AS count FROM lineitem
WHERE {S.bin_index(f"{_AX}::DOUBLE", _NARROW_EDGES)} >= 0 AND {S.bin_index(f"{_AY}::DOUBLE", _NARROW_EDGES)} >= 0 GROUP BY ALL HAVING count(*) >= 290), {S.components("occupied", _NB, _NB, False)},
placed AS (SELECT {S.clipped_index(f"{_AX}::DOUBLE", _NARROW_EDGES)} AS xi, {S.clipped_index(f"{_AY}::DOUBLE", _NARROW_EDGES)} AS yi FROM lineitem)
SELECT coalesce(component::VARCHAR, 'noise') AS state, count(*) AS frames FROM placed LEFT JOIN numbered USING (xi, yi) GROUP BY ALL""")
def grid_states_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid_states.assign_grid_states(_angles(spark, sf_dir), "x", "y", "state", step=25.0, min_count=290, x_domain=_NARROW, y_domain=_NARROW)
    return grid_states.state_summary(out, "state")


_STATE = "CASE WHEN event_type = 'error' THEN 'noise' WHEN event_type = 'view' AND user_id % 7 = 0 THEN NULL ELSE event_type END"


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as beads of trajectories; errors are noise."""
    user = F.col("user_id")
    state = F.when(F.col("event_type") == "error", labels.NOISE).when((F.col("event_type") == "view") & (user % 7 == 0), F.lit(None)).otherwise(F.col("event_type"))
    return _read(spark, sf_dir, "events").select("event_id", F.floor(user / 5).cast("long").alias("trajectory_id"), (user % 5).alias("bead_id"), state.alias("state"), "value")


@query(f"""WITH s AS (SELECT {_STATE} AS state FROM events) SELECT count(*) AS frames, count(*) FILTER (state <> 'noise') AS assigned, count(*) FILTER (state = 'noise') AS noise,
count(*) FILTER (state IS NULL) AS unset, count(DISTINCT CASE WHEN state <> 'noise' THEN state END) AS states FROM s""")
def state_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_states.state_totals(_sequence(spark, sf_dir), "state")


def _dbscan_oracle(periodic: bool, eps: float, least: int, group: str = "0") -> str:
    x, y = "((c_custkey * c_custkey) % 360 - 180)", "((c_custkey * 37) % 360 - 180)"
    if periodic:
        chord = lambda p, q: f"((cos(radians({p})) - cos(radians({q}))) ** 2 + (sin(radians({p})) - sin(radians({q}))) ** 2)"
        near = f"{chord('a.x', 'b.x')} + {chord('a.y', 'b.y')} <= 2.0 - 2.0 * cos(radians({eps}))"
    else:
        near = f"(a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {eps * eps}"
    return f"""WITH RECURSIVE p AS (SELECT c_custkey AS k, {group} AS g, {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM customer),
near AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON {near} AND a.g IS NOT DISTINCT FROM b.g),
core AS MATERIALIZED (SELECT a AS k FROM near GROUP BY a HAVING count(*) >= {least}),
links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT k, k AS seen FROM core UNION SELECT r.k, l.b FROM reach r JOIN links l ON l.a = r.seen),
root AS (SELECT k, min(seen) AS root FROM reach GROUP BY k),
numbered AS (SELECT k, dense_rank() OVER (PARTITION BY g ORDER BY root) - 1 AS c FROM root JOIN p USING (k)),
found AS (SELECT k, c FROM numbered UNION ALL SELECT n.a, min(m.c) FROM near n JOIN numbered m ON m.k = n.b WHERE n.a NOT IN (FROM core) GROUP BY n.a)
SELECT p.k AS c_custkey, coalesce(c::VARCHAR, 'noise') AS state FROM p LEFT JOIN found USING (k)"""


def _dbscan(spark: SparkSession, sf_dir: str, periodic: bool, eps: float, least: int, group: Column | None = None) -> DataFrame:
    k = F.col("c_custkey")
    frames = _read(spark, sf_dir, "customer").select(k, ((k * k) % 360 - 180).cast("double").alias("x"), ((k * 37) % 360 - 180).cast("double").alias("y"))
    if group is not None:
        frames = frames.withColumn("g", group)
    return dbscan.dbscan_states(frames, "x", "y", "c_custkey", "state", eps=eps, min_samples=least, periodic=periodic, group=[] if group is None else ["g"])


@query(_dbscan_oracle(False, 7.5, 5))
def dbscan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dbscan(spark, sf_dir, False, 7.5, 5)


@query(_dbscan_oracle(True, 7.5, 5))
def dbscan_states_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dbscan(spark, sf_dir, True, 7.5, 5)


@query(_dbscan_oracle(True, 15.0, 5, "nullif(c_custkey % 3, 0)"))
def dbscan_states_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null group is a group of its own."""
    return _dbscan(spark, sf_dir, True, 15.0, 5, F.nullif(F.col("c_custkey") % 3, F.lit(0)))


# ---------------------------------------------------------------- states over the map

_OX = binning.linear_edges(0.0, 50.0, 5)
_OSTATE = "CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'noise' WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN '2' WHEN l_tax > 0.04 THEN '10' ELSE 'b' END"


def _overlay_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    state = F.when(n == 1, F.lit(None)).when(n == 2, labels.NOISE).when(F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp"), "2").when(F.col("l_tax") > F.lit(0.04), "10").otherwise("b")
    x, y = (F.col("l_partkey") * 37) % 360 - 180, (F.col("l_suppkey") * 53) % 360 - 180
    return _read(spark, sf_dir, "lineitem").select(*_GROUP, "l_quantity", "l_discount", state.alias("state"), x.cast("double").alias("x"), y.cast("double").alias("y"))


_OXI = S.bin_index("l_quantity", _OX)
_VOTES = f"SELECT l_returnflag, l_linestatus, {_OXI} AS xi, {_YI} AS yi, CASE WHEN s <> 'noise' THEN s END AS s, count(*) AS frames FROM (SELECT *, {_OSTATE} AS s FROM lineitem) WHERE {_OXI} >= 0 AND {_YI} >= 0 GROUP BY ALL"
_NATURAL = "CASE WHEN s IS NULL THEN 2 WHEN regexp_full_match(s, '[0-9]+') THEN 0 ELSE 1 END, CASE WHEN regexp_full_match(s, '[0-9]+') THEN s::INT END, s"


@query(f"""SELECT l_returnflag, l_linestatus, xi, yi, yi * 5 + xi AS bin, s AS state, frames FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, xi, yi ORDER BY frames DESC, {_NATURAL}) AS nth FROM ({_VOTES}))
WHERE nth = 1 AND s IS NOT NULL""")
def overlay_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.majority_states(_overlay_frames(spark, sf_dir), "l_quantity", "l_discount", "state", _OX, Y_EDGES, _GROUP)


@query(f"""SELECT l_returnflag, l_linestatus, s AS state, round(avg(x), 6) AS centre_x, count(*) AS frames FROM (SELECT *, {_OSTATE} AS s, {_AX}::DOUBLE AS x, {_AY}::DOUBLE AS y FROM lineitem)
WHERE s <> 'noise' GROUP BY ALL""")
def overlay_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = binning.linear_edges(-180.0, 180.0, 12)
    return overlay.state_centres(_overlay_frames(spark, sf_dir), "x", "y", "state", edges, edges, _GROUP).select(*_GROUP, "state", F.round("centre_x", 6).alias("centre_x"), "frames")


@query(f"""SELECT s AS state, round(degrees(atan2(avg(sin(radians(x))), avg(cos(radians(x))))), 5) AS centre_x, round(degrees(atan2(avg(sin(radians(y))), avg(cos(radians(y))))), 5) AS centre_y, count(*) AS frames
FROM (SELECT *, {_OSTATE} AS s, {_AX}::DOUBLE AS x, {_AY}::DOUBLE AS y FROM lineitem) WHERE s <> 'noise' GROUP BY ALL""")
def overlay_centres_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = binning.linear_edges(-180.0, 180.0, 12)
    return overlay.state_centres(_overlay_frames(spark, sf_dir), "x", "y", "state", edges, edges, periodic=True).select("state", F.round("centre_x", 5).alias("centre_x"), F.round("centre_y", 5).alias("centre_y"), "frames")


@query(f"SELECT s AS state, row_number() OVER (ORDER BY {_NATURAL}) - 1 AS position FROM (SELECT DISTINCT {_OSTATE} AS s FROM lineitem) WHERE s <> 'noise'")
def overlay_labels_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.state_labels(_overlay_frames(spark, sf_dir), "state")


# ---------------------------------------------------------------- transitions

_BEADS = ("trajectory_id", "bead_id")
_DT, _T = 0.5, 300.0


def _pairs_sql(lag: int = 1, bridge: bool = True) -> str:
    rows = f"SELECT event_id, user_id // 5 AS trajectory_id, user_id % 5 AS bead_id, {_STATE} AS s FROM events"
    w = f"SELECT *, lead(s, {lag}) OVER (PARTITION BY trajectory_id, bead_id ORDER BY event_id) AS d FROM ({rows}) {"WHERE s <> 'noise'" if bridge else ''}"
    return f"SELECT trajectory_id, bead_id, s AS src, d AS dst FROM ({w}) WHERE d IS NOT NULL AND s IS NOT NULL AND s <> 'noise' AND d <> 'noise'"


def _counts_sql(lag: int = 1, bridge: bool = True) -> str:
    return f"SELECT trajectory_id, bead_id, src, dst, count(*) AS count FROM ({_pairs_sql(lag, bridge)}) GROUP BY ALL"


@query(_counts_sql())
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.counts(_sequence(spark, sf_dir), "state", "event_id", _BEADS)


@query(_counts_sql(lag=2))
def transition_counts_lag2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.counts(_sequence(spark, sf_dir), "state", "event_id", _BEADS, lag=2, chunk_frames=500)


@query(f"SELECT trajectory_id, nullif(bead_id, 0) AS bead_id, src, dst, count FROM ({_counts_sql()})")
def transition_counts_null_bead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without a bead are a group of their own."""
    frames = _sequence(spark, sf_dir).withColumn("bead_id", F.nullif("bead_id", F.lit(0)))
    return transitions.counts(frames, "state", "event_id", _BEADS)


@query(_counts_sql(bridge=False))
def transition_counts_unbridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.counts(_sequence(spark, sf_dir), "state", "event_id", _BEADS, bridge_noise=False)


_MATRIX = f"""WITH c AS ({_counts_sql()}),
l AS (SELECT DISTINCT trajectory_id, bead_id, unnest([src, dst]) AS label FROM c),
m AS (SELECT a.trajectory_id, a.bead_id, a.label AS src, b.label AS dst, coalesce(c.count, 0)::BIGINT AS count FROM l a JOIN l b USING (trajectory_id, bead_id)
  LEFT JOIN c ON c.trajectory_id = a.trajectory_id AND c.bead_id = a.bead_id AND c.src = a.label AND c.dst = b.label),
p AS (SELECT *, count / nullif(sum(count) OVER (PARTITION BY trajectory_id, bead_id, src), 0)::DOUBLE AS probability FROM m)"""


def _analysed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return transitions.analyse(_sequence(spark, sf_dir), "state", "event_id", _BEADS, **options)


@query(f"{_MATRIX} SELECT trajectory_id, bead_id, src, dst, count, round(probability, 6) AS probability FROM p")
def transition_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).withColumn("probability", F.round("probability", 6))


@query(f"{_MATRIX} SELECT trajectory_id, bead_id, src, dst, round(probability / 0.5, 6) AS rate FROM p")
def transition_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir, dt=_DT).select(*_BEADS, "src", "dst", F.round("rate", 6).alias("rate"))


def _barrier_sql(rate: str, model: str, conversion: float = 1.0, attempt: float | None = None) -> str:
    k, f = S.number(energy.BOLTZMANN_EV * _T), S.number(energy.barrier_prefactor(model, _T, attempt_frequency=attempt))
    return f"CASE WHEN src <> dst AND {rate} > 0 THEN round(-{k} * ln({rate} / {f}) * {S.number(conversion)}, 6) END"


@query(f"{_MATRIX} SELECT trajectory_id, bead_id, src, dst, {_barrier_sql('(probability / 0.5)', 'eyring')} AS barrier FROM p")
def barriers_eyring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir, dt=_DT, temperature=_T).select(*_BEADS, "src", "dst", F.round("barrier", 6).alias("barrier"))


_KJ = 96.48533212


@query(f"{_MATRIX} SELECT trajectory_id, bead_id, src, dst, {_barrier_sql('(probability / 0.5)', 'arrhenius', _KJ, 1e12)} AS barrier FROM p")
def barriers_arrhenius(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _analysed(spark, sf_dir, dt=_DT, temperature=_T, model="arrhenius", attempt_frequency=1e12, conversion=_KJ)
    return out.select(*_BEADS, "src", "dst", F.round("barrier", 6).alias("barrier"))


_AVERAGES = f"""{_MATRIX},
beads AS (SELECT user_id // 5 AS trajectory_id, count(DISTINCT user_id % 5) AS n FROM events GROUP BY ALL),
u AS (SELECT DISTINCT trajectory_id, label FROM l),
g AS (SELECT a.trajectory_id, a.label AS src, b.label AS dst FROM u a JOIN u b USING (trajectory_id)),
r AS (SELECT o.trajectory_id, o.bead_id, o.label AS src, u.label AS dst FROM l o JOIN u USING (trajectory_id)),
v AS (SELECT r.*, p.count, CASE WHEN h.label IS NULL THEN 0.0 ELSE p.probability END AS probability FROM r
  LEFT JOIN l h ON h.trajectory_id = r.trajectory_id AND h.bead_id = r.bead_id AND h.label = r.dst
  LEFT JOIN p ON p.trajectory_id = r.trajectory_id AND p.bead_id = r.bead_id AND p.src = r.src AND p.dst = r.dst),
a AS (SELECT trajectory_id, src, dst, sum(count) AS total, avg(probability) AS probability, avg(probability / 0.5) AS rate FROM v GROUP BY ALL),
w AS (SELECT g.trajectory_id, g.src, g.dst, coalesce(total, 0) / n::DOUBLE AS count, probability, rate FROM g LEFT JOIN a USING (trajectory_id, src, dst) JOIN beads USING (trajectory_id))"""


def _averaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _sequence(spark, sf_dir)
    matrix = transitions.analyse(frames, "state", "event_id", _BEADS, dt=_DT)
    return transitions.averages(frames, matrix, _BEADS, "bead_id", temperature=_T)


@query(f"{_AVERAGES} SELECT trajectory_id, src, dst, round(count, 6) AS count FROM w")
def averaged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _averaged(spark, sf_dir).select("trajectory_id", "src", "dst", F.round("count", 6).alias("count"))


@query(f"{_AVERAGES} SELECT trajectory_id, src, dst, round(probability, 5) AS probability FROM w")
def averaged_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _averaged(spark, sf_dir).select("trajectory_id", "src", "dst", F.round("probability", 5).alias("probability"))


@query(f"{_AVERAGES} SELECT trajectory_id, src, dst, round(rate, 5) AS rate FROM w")
def averaged_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _averaged(spark, sf_dir).select("trajectory_id", "src", "dst", F.round("rate", 5).alias("rate"))


@query(f"{_AVERAGES} SELECT trajectory_id, src, dst, {_barrier_sql('rate', 'eyring')} AS barrier FROM w")
def averaged_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _averaged(spark, sf_dir).select("trajectory_id", "src", "dst", F.round("barrier", 6).alias("barrier"))


_TYPES = ("click", "purchase", "signup", "view")


@query(f"""{_MATRIX} SELECT trajectory_id, bead_id, src, {', '.join(f"max(CASE WHEN dst = '{t}' THEN count END) AS {t}" for t in _TYPES)} FROM m GROUP BY ALL""")
def transition_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.wide(_analysed(spark, sf_dir), _BEADS, "count", _TYPES)


@query("""SELECT src, dst, count(*) AS count FROM (SELECT role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations) WHERE dst IS NOT NULL GROUP BY ALL""")
def conversation_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = transitions.lag_pairs(_read(spark, sf_dir, "conversations"), "role", "turn", ["conv_id"])
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------- the coordinate table


@query("SELECT event_id, row_number() OVER (ORDER BY event_type, user_id, event_id) - 1 AS frame_id FROM events")
def table_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return table.number_rows(frames, ["event_type", "user_id", "event_id"], "frame_id").select("event_id", "frame_id")


@query("""SELECT o_orderkey AS id, o_orderstatus AS label, NULL::VARCHAR AS bead FROM orders UNION ALL SELECT event_id, event_type, (user_id % 5)::VARCHAR FROM events""")
def table_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"))
    b = _read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("label"), (F.col("user_id") % 5).cast("string").alias("bead"))
    return table.concatenated([a, b])


_COMMENT = "'# Step:  ' || (event_id * 10)::VARCHAR || CASE WHEN user_id % 3 = 0 THEN '' ELSE '  Bead: ' || (user_id % 5)::VARCHAR END"


@query("SELECT event_id, event_id * 10 AS step_number, CASE WHEN user_id % 3 <> 0 THEN user_id % 5 END AS bead FROM events")
def comment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    comment = F.concat(F.lit("# Step:  "), (F.col("event_id") * 10).cast("string"), F.when(user % 3 == 0, "").otherwise(F.concat(F.lit("  Bead: "), (user % 5).cast("string"))))
    frames = _read(spark, sf_dir, "events").select("event_id", comment.alias("comment_line"))
    return frames.select("event_id", labels.comment_step(F.col("comment_line")).alias("step_number"), labels.comment_bead(F.col("comment_line")).alias("bead"))


@query("SELECT user_id, 'run.' || event_type AS trajectory_id, lpad((user_id % 5)::VARCHAR, 2, '0') AS bead_id, 'dir' AS folder, count(*) AS n FROM events GROUP BY ALL")
def trajectory_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/dir/run."), F.col("event_type"), F.lit("_"), F.lpad((F.col("user_id") % 5).cast("string"), 2, "0"), F.lit(".xyz"))
    frames = _read(spark, sf_dir, "events").select("user_id", path.alias("p"))
    p: Column = F.col("p")
    out = frames.select("user_id", labels.trajectory_id(p, r"^(.+)_\d+$").alias("trajectory_id"), labels.bead_id(p, r"_(\d+)$").alias("bead_id"), labels.trajectory_id(p).alias("folder"))
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type, value FROM events ORDER BY md5('42/' || event_id::VARCHAR), event_id LIMIT 250")
def overlay_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.sample_exact(_read(spark, sf_dir, "events").select("event_id", "event_type", "value"), 250, ["event_id"])


@query("SELECT event_id, trajectory_id, bead_id, to_json({'event_id': event_id, 'trajectory_id': trajectory_id, 'bead_id': bead_id})::VARCHAR AS record FROM (SELECT event_id, user_id // 5 AS trajectory_id, user_id % 5 AS bead_id FROM events)")
def frame_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.records(_sequence(spark, sf_dir).select("event_id", "trajectory_id", "bead_id"), "record")


# ---------------------------------------------------------------- files


@query(f"""SELECT 'label=' || label AS trajectory_id, vec_id AS step_number, 21 AS atom_count, round({_sqlnorm(_minus(4, 2))}, 5) AS d, round({S.dihedral('e', _PHI)}, 3) AS phi,
row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_number FROM ({_STRUCTURE})""")
def xyz_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures written as xyz files, a folder for each trajectory; found, indexed, read by offset and measured."""
    frames = _read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    number = lambda i: F.format_string("%.12f", F.get("embedding", F.lit(i)).cast("double"))
    lines = [F.concat_ws(" ", F.lit("C"), *[number(3 * i + k) for k in range(3)]) for i in range(21)]
    text = F.concat_ws("\n", F.lit("21"), F.concat(F.lit("# Step:  "), F.col("vec_id").cast("string")), *lines)
    folder = f"{work_dir(spark)}/xyz-{uuid.uuid4().hex}"
    one_file = frames.repartition("label").sortWithinPartitions("label", "vec_id")
    one_file.select("label", text.alias("value")).write.partitionBy("label").text(folder)
    index = xyz.index_files(spark, discover(f"{folder}/*/part-*"))
    read = xyz.read_frames(index, run_frames=64, with_elements=False)
    c = F.col("coords")
    return read.select(
        labels.trajectory_id(F.col("source_file")).alias("trajectory_id"), labels.comment_step(F.col("comment_line")).alias("step_number"), "atom_count",
        F.round(geometry.distance(c, (2, 4)), 5).alias("d"), F.round(geometry.dihedral(c, _PHI), 3).alias("phi"), "frame_number",
    )


@query("""SELECT event_id AS frame_id, 'f' || user_id AS source_file, nullif(lpad((user_id % 3)::VARCHAR, 2, '0'), '00') AS bead_id, event_id AS frame_number, round(value::FLOAT::DOUBLE, 4) AS phi FROM events""")
def csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coordinate table written as CSV and read back, types and null beads kept."""
    events = _read(spark, sf_dir, "events")
    columns = {
        "frame_id": F.col("event_id"), "source_file": F.concat(F.lit("f"), F.col("user_id")), "trajectory_id": F.lit("t"), "bead_id": F.nullif(F.lpad((F.col("user_id") % 3).cast("string"), 2, "0"), F.lit("00")),
        "frame_number": F.col("event_id"), "byte_offset": F.lit(0), "atom_count": F.lit(21), "comment_line": F.lit(""), "local_frame_index": F.col("event_id"), "global_frame_index": F.col("event_id"), "phi": F.col("value"),
    }
    path = f"{work_dir(spark)}/table-{uuid.uuid4().hex}.csv"
    tables.write_table(events.select(*[v.alias(k) for k, v in columns.items()]), path)
    out = tables.read_table(spark, path)
    return out.select("frame_id", "source_file", "bead_id", "frame_number", F.round(F.col("phi").cast("double"), 4).alias("phi"))
