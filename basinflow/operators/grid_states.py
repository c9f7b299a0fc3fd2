"""States as connected regions of populated grid cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import binning
from ..functions.labels import NOISE
from ..session import ship_package, written
from .dbscan import linked_roots
from .grouping import join_groups
from .table import number_rows

#: Groups times cells up to which the labelled cells are broadcast.
BROADCAST_CELLS = 200_000
#: Cells of a grid up to which a group's cells are labelled in one task, and the side of the tiles of larger grids.
CELLS_OF_TASK, TILE_SIDE = 1 << 22, 1024


def component_ids(xi: np.ndarray, yi: np.ndarray, nx: int, ny: int, wrap_x: bool = False, wrap_y: bool = False) -> np.ndarray:
    """0-based component of each distinct cell, edge neighbours connected.

    Components are numbered by their first cell in (xi, yi) order; a wrapped axis also
    connects its first and last row.
    """
    key = xi.astype(np.int64) * ny + yi
    order = np.argsort(key)
    cells = key[order]
    parent = np.arange(len(cells))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def connect(a: np.ndarray, b: np.ndarray) -> None:
        at = np.searchsorted(cells, b)
        at[at == len(cells)] = 0
        for i, j in zip(np.searchsorted(cells, a[cells[at] == b]).tolist(), at[cells[at] == b].tolist()):
            i, j = find(i), find(j)
            if i != j:
                parent[max(i, j)] = min(i, j)

    cx, cy = cells // ny, cells % ny
    inner = cy + 1 < ny
    connect(cells[inner], cells[inner] + 1)
    inner = cx + 1 < nx
    connect(cells[inner], cells[inner] + ny)
    if wrap_x and nx > 1:
        edge = cx == 0
        connect(cells[edge], cells[edge] + (nx - 1) * ny)
    if wrap_y and ny > 1:
        edge = cy == 0
        connect(cells[edge], cells[edge] + ny - 1)
    roots = np.array([find(i) for i in range(len(cells))], np.int64)
    number = np.unique(roots, return_inverse=True)[1].reshape(-1)
    out = np.zeros(len(cells), np.int64)
    out[order] = number
    return out


def labelled_cells(
    frames: DataFrame, x: str, y: str, *, step: float, min_count: int,
    x_domain: tuple[float, float], y_domain: tuple[float, float], group: Sequence[str] = (), periodic: bool = False, tile: int | None = None,
) -> DataFrame:
    """(group..., xi, yi, count, component) of the cells with min_count frames or more.

    The frames are aggregated to cells first, which are then labelled as by ``label_cells``.
    """
    x_edges, y_edges = binning.stepped_edges(*x_domain, step), binning.stepped_edges(*y_domain, step)
    vx, vy = F.col(x).try_cast("double"), F.col(y).try_cast("double")
    rows = frames.select(*group, vx.alias("_x"), vy.alias("_y")).where(~binning.missing(F.col("_x")) & ~binning.missing(F.col("_y")))
    counted = rows.withColumn("xi", binning.bin_index(F.col("_x"), x_edges)).withColumn("yi", binning.bin_index(F.col("_y"), y_edges))
    # cells off the grid stay until they are labelled: they count as valid frames of their group
    per_cell = counted.groupBy(*group, "xi", "yi").agg(F.count(F.lit(1)).alias("count"))
    return label_cells(per_cell, len(x_edges) - 1, len(y_edges) - 1, min_count, group, periodic, tile)


def label_cells(per_cell: DataFrame, nx: int, ny: int, min_count: int, group: Sequence[str] = (), periodic: bool = False, tile: int | None = None) -> DataFrame:
    """(group..., xi, yi, count, component) of counted cells, those with min_count frames or more.

    Cells with a negative index are off the grid. A group's cells meet in one task while
    the grid has at most ``CELLS_OF_TASK``. A larger one, or any if ``tile`` gives a side,
    is labelled in square tiles, which are then united over their borders; the result is
    the same.
    """
    ship_package(per_cell.sparkSession)
    if tile is not None or nx * ny > CELLS_OF_TASK:
        return _label_by_tiles(per_cell, nx, ny, min_count, group, periodic, tile or TILE_SIDE)
    fields = [per_cell.schema[c] for c in group] + [T.StructField("xi", T.IntegerType()), T.StructField("yi", T.IntegerType()), T.StructField("count", T.LongType()), T.StructField("component", T.LongType())]

    def label(part: pd.DataFrame) -> pd.DataFrame:
        # a group of fewer than two valid frames has no states
        if part["count"].sum() < 2:
            return part.iloc[:0].assign(component=0)
        part = part[(part["count"] >= min_count) & (part["xi"] >= 0) & (part["yi"] >= 0)]
        return part.assign(component=component_ids(part["xi"].to_numpy(), part["yi"].to_numpy(), nx, ny, periodic, periodic))

    if not group:
        per_cell = per_cell.withColumn("_all", F.lit(0))
    keys = list(group) or ["_all"]
    return per_cell.groupBy(*keys).applyInPandas(lambda part: label(part)[[f.name for f in fields]], T.StructType(fields))


def _label_by_tiles(per_cell: DataFrame, nx: int, ny: int, min_count: int, group: Sequence[str], periodic: bool, tile: int) -> DataFrame:
    """``label_cells`` in tiles: no task sees more than a tile's cells.

    A part is what is connected inside a tile, named by its first cell. Cells on the last
    row or column of a tile meet those behind them, also around a periodic edge, which
    links parts; components of parts are then numbered by their first cell.
    """
    g = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)]) if group else F.struct(F.lit(0).alias("g0"))
    keys = [f"_k{i}" for i in range(len(group))]
    counted = per_cell.select(g.alias("_g"), "xi", "yi", "count")
    enough = counted.groupBy("_g").agg(F.sum("count").alias("_n")).where("_n >= 2").select("_g")
    kept = counted.where((F.col("count") >= min_count) & (F.col("xi") >= 0) & (F.col("yi") >= 0)).join(enough, "_g", "left_semi")
    plain = [F.col(f"_g.g{i}").alias(k) for i, k in enumerate(keys)]
    tiled = kept.select(*plain, "xi", "yi", "count", F.floor(F.col("xi") / tile).alias("_tx"), F.floor(F.col("yi") / tile).alias("_ty"))
    fields = [f for f in tiled.schema if f.name not in ("_tx", "_ty")] + [T.StructField("part", T.LongType())]

    def label(cells: pd.DataFrame) -> pd.DataFrame:
        xi, yi = cells["xi"].to_numpy(), cells["yi"].to_numpy()
        number = component_ids(xi, yi, nx, ny)
        first = np.full(number.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, number, xi.astype(np.int64) * ny + yi)
        return cells.assign(part=first[number])[[f.name for f in fields]]

    parts = tiled.groupBy(*keys, "_tx", "_ty").applyInPandas(label, T.StructType(fields))
    own = F.struct(*[F.col(k).alias(f"g{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("g0"))
    parts = written(parts.select(own.alias("_g"), "xi", "yi", "count", F.struct(own.alias("g"), "part").alias("cell")), "grid-parts")

    def across(axis: str, n: int) -> DataFrame:
        """Cells at the end of a tile, at the place of the cell behind them."""
        behind = F.col(axis) + 1
        last = (behind % tile == 0) & (behind < n)
        if periodic:
            # tiles may end before the grid does
            last, behind = last | (behind == n), F.when(behind == n, 0).otherwise(behind)
        return parts.where(last).select("_g", *[behind.cast("int").alias(c) if c == axis else F.col(c) for c in ("xi", "yi")], F.col("cell").alias("a"))

    met = across("xi", nx).union(across("yi", ny)).join(parts.select("_g", "xi", "yi", F.col("cell").alias("b")), ["_g", "xi", "yi"])
    links = written(met.where("a <> b").select("a", "b").distinct(), "grid-links")
    roots = linked_roots(parts.select("cell").distinct(), links)
    firsts = number_rows(roots.select("root").distinct().select("root.g", "root.part", "root"), ["g", "part"], "n")
    start = firsts.groupBy("g").agg(F.min("n").alias("_start"))
    number = firsts.join(start, "g").select("root", (F.col("n") - F.col("_start")).alias("component"))
    out = parts.join(roots.join(number, "root").select("cell", "component"), "cell")
    return out.select(*[F.col(f"_g.g{i}").alias(c) for i, c in enumerate(group)], "xi", "yi", "count", "component")


def assign_grid_states(
    frames: DataFrame, x: str, y: str, state: str, *, step: float, min_count: int,
    x_domain: tuple[float, float], y_domain: tuple[float, float], group: Sequence[str] = (), periodic: bool = False, groups_at_most: int = 1,
) -> DataFrame:
    """frames with a string column of states: a component's number, or "noise".

    Values off the domain take the state of the nearest edge cell, though they are not
    counted there; frames with a missing value are noise. The labelled cells are joined
    back, broadcast while ``groups_at_most`` times the grid stays within a fixed bound.
    """
    x_edges, y_edges = binning.stepped_edges(*x_domain, step), binning.stepped_edges(*y_domain, step)
    cells = labelled_cells(frames, x, y, step=step, min_count=min_count, x_domain=x_domain, y_domain=y_domain, group=group, periodic=periodic)
    small = groups_at_most * (len(x_edges) - 1) * (len(y_edges) - 1) <= BROADCAST_CELLS if (not group or groups_at_most > 1) else False
    vx, vy = F.col(x).try_cast("double"), F.col(y).try_cast("double")
    valid = ~binning.missing(vx) & ~binning.missing(vy)
    placed = frames.withColumn("_xi", F.when(valid, binning.clipped_index(vx, x_edges))).withColumn("_yi", F.when(valid, binning.clipped_index(vy, y_edges)))
    right = cells.select(*group, F.col("xi").alias("_xi"), F.col("yi").alias("_yi"), F.col("component").cast("string").alias(state))
    joined = join_groups(placed.drop(state), right, group, ("_xi", "_yi"), "left", small)
    return joined.withColumn(state, F.coalesce(state, F.lit(NOISE))).drop("_xi", "_yi")


def state_summary(frames: DataFrame, state: str, group: Sequence[str] = ()) -> DataFrame:
    """Frames of each state, noise and unset ones included."""
    return frames.groupBy(*group, state).agg(F.count(F.lit(1)).alias("frames"))


def state_totals(frames: DataFrame, state: str) -> DataFrame:
    """One row: frames, assigned, noise and unset frames, and distinct states."""
    s = F.col(state)
    return frames.agg(
        F.count(F.lit(1)).alias("frames"), F.count(F.when(s.isNotNull() & (s != NOISE), 1)).alias("assigned"),
        F.count(F.when(s == NOISE, 1)).alias("noise"), F.count(F.when(s.isNull(), 1)).alias("unset"),
        F.count_distinct(F.when(s != NOISE, s)).alias("states"),
    )
