"""Populations of a two-dimensional landscape."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binning, energy
from ..session import written
from .grouping import join_groups

Edges = Sequence[float]

#: Halvings from one level of the tree of boxes to the next, and entries of a box of the last one.
_STEP, _IN_BOX = 3, 16


def binned(frames: DataFrame, x: str, y: str, x_edges: Edges, y_edges: Edges) -> DataFrame:
    """frames with bins xi and yi; rows off the map, or whose value is missing, infinite or no number, go.

    The map's range is a filter on the columns themselves, which reaches the scan.
    """
    vx, vy = F.col(x).try_cast("double"), F.col(y).try_cast("double")
    kept = frames.where(binning.on_range(vx, x_edges) & binning.on_range(vy, y_edges))
    return kept.withColumns({"xi": binning.inner_index(vx, x_edges), "yi": binning.inner_index(vy, y_edges)})


def cells(frames: DataFrame, x: str, y: str, x_edges: Edges, y_edges: Edges, group: Sequence[str] = ()) -> DataFrame:
    """(group..., xi, yi, count): occupied bins. One aggregation, partial before its shuffle."""
    return binned(frames.select(*group, x, y), x, y, x_edges, y_edges).groupBy(*group, "xi", "yi").agg(F.count(F.lit(1)).alias("count"))


def dense(cells_: DataFrame, nx: int, ny: int) -> DataFrame:
    """Every bin of the map, empty ones with count 0; for maps without groups."""
    spark = cells_.sparkSession
    grid = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("xi"), F.floor(F.col("id") / nx).cast("int").alias("yi"))
    return grid.join(cells_, ["xi", "yi"], "left").select("xi", "yi", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def log_scale(cells_: DataFrame) -> DataFrame:
    """Cells with log10(count + 1)."""
    return cells_.withColumn("log_count", energy.log_count(F.col("count")))


def free_energy(cells_: DataFrame, unit: str = "kT", temperature: float | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Cells with their free energy above the most populated one of the group.

    The largest count is an aggregate joined back, or a scalar of the whole map, not a
    window, so no task gathers all cells of an ungrouped map.
    """
    if group:
        top = cells_.groupBy(*group).agg(F.max("count").alias("largest"))
        joined = join_groups(cells_, top, group)
    else:
        joined = cells_.withColumn("largest", cells_.agg(F.max("count")).scalar())
    return joined.withColumn("free_energy", energy.free_energy(F.col("count"), F.col("largest"), unit, temperature)).drop("largest")


def representatives(frames: DataFrame, x: str, y: str, x_edges: Edges, y_edges: Edges, order: Sequence[str], group: Sequence[str] = (), keep: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Of each occupied bin the frame nearest to its centre, the earliest by ``order`` on ties; and its frames, if ``count`` names a column for them.

    An arg-min aggregate over structs: each task reduces its rows to one per bin before
    the shuffle, so a crowded bin costs no more than an empty one. Its buffer is a struct,
    so tasks sort their rows by bin; joining frames with the bins' least distances instead
    took four times as long on whole numbers, where most frames of a bin are ties.
    """
    columns = list(dict.fromkeys((*order, x, y, *keep)))
    b = binned(frames.select(*dict.fromkeys((*group, *columns))), x, y, x_edges, y_edges)
    dx, dy = F.col(x).cast("double") - binning.bin_centre(F.col("xi"), x_edges), F.col(y).cast("double") - binning.bin_centre(F.col("yi"), y_edges)
    out = b.groupBy(*group, "xi", "yi").agg(F.min(F.struct((dx * dx + dy * dy).alias("_d"), *columns)).alias("_best"), *[F.count(F.lit(1)).alias(c) for c in [count] if c])
    return out.select(*group, "xi", "yi", *[c for c in [count] if c], F.col("_best._d").alias("distance2"), *[F.col(f"_best.{c}").alias(c) for c in columns])


def nearest_frame(frames: DataFrame, x: str, y: str, at: tuple[float, float], order: Sequence[str]) -> DataFrame:
    """The frame nearest to a point; the earliest on ties."""
    d2 = (F.col(x) - F.lit(at[0])) ** 2 + (F.col(y) - F.lit(at[1])) ** 2
    return frames.where(binning.finite(F.col(x).cast("double")) & binning.finite(F.col(y).cast("double"))).withColumn("distance2", d2).orderBy("distance2", *order).limit(1)


def nearest_frames(frames: DataFrame, x: str, y: str, points: DataFrame, px: str, py: str, order: Sequence[str]) -> DataFrame:
    """points with ``distance2`` and the ``order`` columns of the frame nearest to each; the earliest frame on ties.

    Frames of one place are one entry, and entries lie in a tree of boxes, each box being
    64 of the next level. A point goes down the tree at once into all boxes that can hold
    its nearest frame: those no farther than the far side of the box that is surely near.
    So a point meets the entries of a few boxes, however many frames there are. Points
    and frames with a missing or non-finite coordinate take no part.
    """
    at = lambda c: F.col(c).try_cast("double")
    entries = frames.select(at(x).alias("_x"), at(y).alias("_y"), F.struct(*order).alias("_o")).where(binning.finite(F.col("_x")) & binning.finite(F.col("_y")))
    entries = entries.groupBy("_x", "_y").agg(F.min("_o").alias("_o"))
    entries = written(entries, "entries")
    x0, x1, y0, y1, n = entries.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y"), F.count(F.lit(1))).first()
    steps = max(1, math.ceil(math.log(max(n / _IN_BOX, 1.0), 4**_STEP)))
    depth = _STEP * steps

    def place(v: str, low: float | None, high: float | None) -> Column:
        width = (high - low if low is not None and high is not None else 0.0) or 1.0
        return F.least(F.floor((F.col(v) - F.lit(low)) / F.lit(width) * float(2**depth)).cast("long"), F.lit(2**depth - 1).cast("long"))

    entries = entries.withColumns({"_i": place("_x", x0, x1), "_j": place("_y", y0, y1)})
    leaves = written(entries.groupBy("_i", "_j").agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1")), "leaves")
    pins = points.select(at(px).alias("_px"), at(py).alias("_py")).where(binning.finite(F.col("_px")) & binning.finite(F.col("_py"))).distinct()
    open_ = pins.withColumns({"_i": F.lit(0).cast("long"), "_j": F.lit(0).cast("long")})
    outside = lambda p, a, b: F.greatest(F.col(a) - F.col(p), F.col(p) - F.col(b), F.lit(0.0))
    across = lambda p, a, b: F.greatest(F.abs(F.col(p) - F.col(a)), F.abs(F.col(b) - F.col(p)))
    for step in range(1, steps + 1):
        up = depth - _STEP * step
        here = [F.shiftright(c, up).alias(f"{c}n") for c in ("_i", "_j")]
        boxes = leaves.groupBy(*here).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
        boxes = boxes.withColumns({c: F.shiftright(f"{c}n", _STEP) for c in ("_i", "_j")})
        # levels of at most 4 096 boxes; all points may be in one box there
        met = open_.join(F.broadcast(boxes) if 4 ** (_STEP * step) <= 4096 else boxes, ["_i", "_j"])
        # rounding keeps order, so a box's bounds hold for the distances as computed
        low = outside("_px", "x0", "x1") * outside("_px", "x0", "x1") + outside("_py", "y0", "y1") * outside("_py", "y0", "y1")
        high = across("_px", "x0", "x1") * across("_px", "x0", "x1") + across("_py", "y0", "y1") * across("_py", "y0", "y1")
        sure = F.min(high).over(Window.partitionBy("_px", "_py"))
        open_ = met.withColumn("_sure", sure).where(low <= F.col("_sure")).select("_px", "_py", F.col("_in").alias("_i"), F.col("_jn").alias("_j"))
    dx, dy = F.col("_x") - F.col("_px"), F.col("_y") - F.col("_py")
    best = open_.join(entries, ["_i", "_j"]).groupBy("_px", "_py").agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), "_o")).alias("_b"))
    best = best.select("_px", "_py", F.col("_b.d").alias("distance2"), *[F.col(f"_b._o.{c}").alias(c) for c in order])
    clash = set(order) & set(points.columns)
    if clash:
        raise ValueError(f"points have columns of the frames' order: {sorted(clash)}")
    asked = points.withColumns({"_px": at(px), "_py": at(py)})
    return asked.join(best, ["_px", "_py"]).drop("_px", "_py")


def with_metadata(chosen: DataFrame, frames: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Metadata of chosen frames by an equi-join on their key."""
    return chosen.join(frames.select(*key, *columns), list(key), "left")
