"""Density clustering by cells.

Equal points are one position with a weight. Positions fall into cells so small that all
points of a cell are neighbours, so a cell of ``min_samples`` points is all core points
and needs no comparison, and the core points of a cell are always one cluster. What is
left to compare: the few points of thin cells with those of the cells around them, and
whether two cells have core points within eps of each other. The latter is asked of
their bounding boxes first, then of smaller and smaller parts, and of the points only
where parts are neither surely near nor surely apart. Clusters are components of the
graph of cells. No list of neighbouring points is ever made.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binning
from ..functions.labels import NOISE
from ..session import written

#: Halvings of a cell's side from one round of comparing parts to the next, and the rounds.
_HALVINGS, _ROUNDS = 2, 3
#: Share by which bounds are kept away from eps, and a cell's side below the largest one: far above rounding errors.
_MARGIN = 1e-9
_SIDES = ("x0", "x1", "y0", "y1")


@dataclass(frozen=True)
class _Metric:
    """Distances of points, bounds for boxes, and cells all of whose points are neighbours."""

    eps: float
    periodic: bool

    @property
    def limit(self) -> float:
        """Largest squared distance of neighbours."""
        return 2.0 - 2.0 * math.cos(math.radians(self.eps)) if self.periodic else self.eps * self.eps

    @property
    def cells(self) -> int:
        """Cells around a periodic axis."""
        side = math.degrees(math.acos((1.0 + math.cos(math.radians(self.eps))) / 2.0))
        return max(1, math.ceil(360.0 / (side * (1.0 - _MARGIN))))

    def place(self, v: Column) -> Column:
        """Position on an axis in cells; its floor is the cell."""
        if not self.periodic:
            return v / F.lit(self.eps / math.sqrt(2.0) * (1.0 - _MARGIN))
        return F.least(F.pmod(v + 180.0, F.lit(360.0)) / F.lit(360.0 / self.cells), F.lit(math.nextafter(self.cells, 0.0)))

    def around(self, cell: Column) -> Column:
        """Cells on an axis that neighbours of a cell's points can be in."""
        if not self.periodic:
            return F.sequence(cell - 2, cell + 2)
        reach = min(self.cells, math.floor(self.eps * self.cells / 360.0 * (1.0 + _MARGIN)) + 1)
        return F.array_distinct(F.transform(F.sequence(cell - reach, cell + reach), lambda c: F.pmod(c, F.lit(self.cells).cast("long"))))

    def spread(self) -> Column:
        """Coordinates _x and _y as an array of those whose differences make the distance."""
        if not self.periodic:
            return F.array("_x", "_y")
        return F.array(*[f(F.radians(c)) for c in ("_x", "_y") for f in (F.cos, F.sin)])

    def apart(self, a: str, b: str) -> Column:
        """Squared distance of two points, given as by ``spread``."""
        square = lambda k: (F.get(a, F.lit(k)) - F.get(b, F.lit(k))) ** 2
        return (square(0) + square(1)) + (square(2) + square(3)) if self.periodic else square(0) + square(1)

    def bounds(self, a: str, b: str) -> tuple[Column, Column]:
        """Least and largest squared distance of two boxes, struct columns of ``_SIDES``."""
        low, high = F.lit(0.0), F.lit(0.0)
        for axis in "xy":
            # differences of the boxes' values run from first to last
            first, last = F.col(f"{b}.{axis}0") - F.col(f"{a}.{axis}1"), F.col(f"{b}.{axis}1") - F.col(f"{a}.{axis}0")
            if self.periodic:
                circular = lambda d: F.abs(F.pmod(d + 180.0, F.lit(360.0)) - 180.0)
                meets = lambda turn: F.floor((last - turn) / 360.0) >= F.ceil((first - turn) / 360.0)  # noqa: E731, B023
                near = F.when(meets(0.0), 0.0).otherwise(F.least(circular(first), circular(last)))
                far = F.when(meets(180.0), 180.0).otherwise(F.greatest(circular(first), circular(last)))
                square = lambda d: 2.0 - 2.0 * F.cos(F.radians(d))
            else:
                near = F.greatest(first, -last, F.lit(0.0))
                far = F.greatest(F.abs(first), F.abs(last))
                square = lambda d: d * d
            low, high = low + square(near), high + square(far)
        return low, high


def _boxes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., box): bounding boxes."""
    sides = [F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1")]
    return points.groupBy(*keys).agg(*sides).select(*keys, F.struct(*_SIDES).alias("box"))


def _asking(points: DataFrame, metric: _Metric, columns: Sequence[Column | str]) -> DataFrame:
    """Some columns of points, once for each cell around them: _g, cx, cy."""
    rows = points.select("_g", *columns, metric.around(F.col("cx")).alias("_xs"), metric.around(F.col("cy")).alias("_ys"))
    return rows.withColumn("cx", F.explode("_xs")).withColumn("cy", F.explode("_ys")).drop("_xs", "_ys")


def _cell_links(cores: DataFrame, metric: _Metric) -> DataFrame:
    """(a, b), a < b: cells with core points within eps of each other.

    ``cores`` are core positions (_g, cx, cy, ux, uy, _x, _y, cell).
    """
    part = lambda halvings: [F.floor(F.col(u) * float(2**halvings)).cast("long") for u in ("ux", "uy")]

    def judged(pairs: DataFrame, halvings: int) -> DataFrame:
        """Pairs of boxes with ``near``: surely, surely not, or null."""
        low, high = metric.bounds("abox", "bbox")
        sure = F.when(high <= metric.limit * (1.0 - _MARGIN), True).when(low > metric.limit * (1.0 + _MARGIN), False)
        kept = pairs.withColumn("near", sure).where(F.coalesce("near", F.lit(True)))
        return written(kept.select("a", "b", "apart", "bpart", "near"), f"dbscan-parts{halvings}")

    def parts(halvings: int) -> DataFrame:
        """Boxes of the cells' parts after some halvings, with the part each was a round before."""
        own, before = part(halvings), part(max(0, halvings - _HALVINGS))
        rows = cores.select("cell", "_x", "_y", F.struct(*[c.alias(n) for c, n in zip(own, "xy")]).alias("part"), F.struct(*[c.alias(n) for c, n in zip(before, "xy")]).alias("up"))
        return _boxes(rows, ["cell", "up", "part"])

    whole = _boxes(cores.withColumn("part", F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"))), ["_g", "cx", "cy", "cell", "part"])
    left = _asking(whole, metric, [F.col("cell").alias("a"), F.col("part").alias("apart"), F.col("box").alias("abox")])
    right = whole.select("_g", "cx", "cy", F.col("cell").alias("b"), F.col("part").alias("bpart"), F.col("box").alias("bbox"))
    open_ = judged(left.join(right, ["_g", "cx", "cy"]).where("a < b"), 0)
    found = [open_.where("near").select("a", "b")]
    for turn in range(1, _ROUNDS):
        known = found[-1].distinct()
        left_over = open_.where("near IS NULL").join(known, ["a", "b"], "left_anti").drop("near")
        p = parts(turn * _HALVINGS)
        one = p.select(F.col("cell").alias("a"), F.col("up").alias("apart"), F.col("part").alias("anew"), F.col("box").alias("abox"))
        two = p.select(F.col("cell").alias("b"), F.col("up").alias("bpart"), F.col("part").alias("bnew"), F.col("box").alias("bbox"))
        finer = left_over.join(one, ["a", "apart"]).join(two, ["b", "bpart"])
        open_ = judged(finer.select("a", "b", F.col("anew").alias("apart"), F.col("bnew").alias("bpart"), "abox", "bbox"), turn * _HALVINGS)
        found.append(open_.where("near").select("a", "b"))
    # what stays open is settled by the points of those parts
    known = reduce(DataFrame.union, found).distinct()
    left_over = open_.where("near IS NULL").join(known, ["a", "b"], "left_anti").drop("near")
    last = part((_ROUNDS - 1) * _HALVINGS)
    points = cores.select("cell", F.struct(*[c.alias(n) for c, n in zip(last, "xy")]).alias("part"), "_e")
    one = points.select(F.col("cell").alias("a"), F.col("part").alias("apart"), F.col("_e").alias("ae"))
    two = points.select(F.col("cell").alias("b"), F.col("part").alias("bpart"), F.col("_e").alias("be"))
    near = metric.apart("ae", "be") <= F.lit(metric.limit)
    rest = left_over.join(one, ["a", "apart"]).join(two, ["b", "bpart"]).where(near).select("a", "b")
    return written(known.union(rest).distinct(), "dbscan-links")


def linked_roots(cells: DataFrame, links: DataFrame) -> DataFrame:
    """(cell, root): the smallest cell that each is linked with; links are pairs (a, b) in any order."""
    both = links.union(links.select("b", "a"))
    labels = written(cells.select("cell", F.col("cell").alias("root")), "labels")
    while True:
        # the smallest label among neighbours, then that label's own label: paths halve every round
        spread = both.join(labels.select(F.col("cell").alias("b"), "root"), "b").groupBy(F.col("a").alias("cell")).agg(F.min("root").alias("new"))
        nxt = labels.join(spread, "cell", "left").select("cell", F.least("root", "new").alias("root"))
        jump = nxt.join(nxt.select(F.col("cell").alias("root"), F.col("root").alias("far")), "root").select("cell", F.least("root", "far").alias("root"))
        jumped = written(jump, "labels")
        changed = jumped.join(labels.withColumnRenamed("root", "old"), "cell").where("root <> old").limit(1).count()
        labels = jumped
        if not changed:
            return labels


def dbscan_states(
    frames: DataFrame, x: str, y: str, key: str, state: str, *, eps: float, min_samples: int,
    group: Sequence[str] = (), periodic: bool = False, max_points: int | None = None,
) -> DataFrame:
    """(key, state) of every frame, by density clustering inside each group.

    ``key`` is a unique long that orders the frames. A point with ``min_samples``
    neighbours within eps, itself included, is a core point; connected core points are a
    cluster, numbered from 0 by first core point; other points take the lowest cluster of
    a core neighbour, else noise. With ``periodic`` both axes are angles, embedded as
    (cos, sin), and eps becomes the chord of eps degrees; eps must then be below 180.
    Frames with a missing value, and groups with fewer than two valid ones, are noise.
    Comparisons grow with the points of thin cells times ``min_samples``, not with the
    pairs of neighbours; ``max_points`` refuses more input.
    """
    if not eps > 0 or (periodic and eps >= 180):
        raise ValueError(f"eps must be positive, below 180 degrees on periodic axes; got {eps}")
    metric = _Metric(float(eps), periodic)
    g = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)]) if group else F.struct(F.lit(0).alias("g0"))
    # adding zero makes a negative zero a positive one, as grouping and joins have it
    every = frames.select(F.col(key).alias("_k"), g.alias("_g"), *[(F.col(v).try_cast("double") + 0.0).alias(n) for v, n in ((x, "_x"), (y, "_y"))])
    valid = every.where(binning.finite(F.col("_x")) & binning.finite(F.col("_y")))
    merged = valid.groupBy("_g", "_x", "_y").agg(F.count(F.lit(1)).alias("w"), F.min("_k").alias("first"))
    placed = merged.withColumns({"ux": metric.place(F.col("_x")), "uy": metric.place(F.col("_y")), "_e": metric.spread()})
    positions = written(placed.withColumns({"cx": F.floor("ux").cast("long"), "cy": F.floor("uy").cast("long")}), "dbscan-positions")
    if max_points is not None and (positions.agg(F.sum("w")).first()[0] or 0) > max_points:
        raise ValueError(f"density clustering of more than {max_points} points; use grid states")
    enough = positions.groupBy("_g").agg(F.sum("w").alias("n")).where("n >= 2").select("_g")
    full = positions.groupBy("_g", "cx", "cy").agg(F.sum("w").alias("n"))
    marked = written(positions.join(enough, ["_g"]).join(full, ["_g", "cx", "cy"]).withColumn("dense", F.col("n") >= min_samples).drop("n"), "dbscan-marked")
    thin = marked.where("NOT dense")
    asking = _asking(thin, metric, [F.col("first").alias("a"), F.col("_e").alias("ae")])
    near = metric.apart("ae", "_e") <= F.lit(metric.limit)
    others = marked.select("_g", "cx", "cy", "_e", "w")
    counted = asking.join(others, ["_g", "cx", "cy"]).where(near).groupBy("a").agg(F.sum("w").alias("n")).where(F.col("n") >= min_samples)
    more = thin.join(counted.select(F.col("a").alias("first")), "first", "left_semi")
    core = marked.where("dense").unionByName(more.select(*marked.columns))
    # a cell is named by its first core point
    named = core.groupBy("_g", "cx", "cy").agg(F.min("first").alias("cell"))
    cores = written(core.join(named, ["_g", "cx", "cy"]), "dbscan-cores")
    roots = linked_roots(cores.select("cell").distinct(), _cell_links(cores, metric))
    # cluster numbers by first core point, within each group; few rows: one for each cluster
    heads = roots.select("root").distinct().join(cores.select("_g", F.col("first").alias("root")), "root")
    number = heads.withColumn("cluster", F.row_number().over(Window.partitionBy("_g").orderBy("root")) - 1).select("root", "cluster")
    clusters = roots.join(number, "root").select("cell", "cluster")
    own = written(cores.join(clusters, "cell").select("_g", "cx", "cy", "_x", "_y", "_e", "first", "cluster"), "dbscan-clusters")
    border = _asking(thin.join(own.select("first"), "first", "left_anti"), metric, [F.col("_x").alias("ax"), F.col("_y").alias("ay"), F.col("_e").alias("ae")])
    taken = border.join(own.select("_g", "cx", "cy", "_e", "cluster"), ["_g", "cx", "cy"]).where(near).groupBy("_g", F.col("ax").alias("_x"), F.col("ay").alias("_y")).agg(F.min("cluster").alias("cluster"))
    labelled = own.select("_g", "_x", "_y", "cluster").unionByName(taken)
    out = every.join(labelled, ["_g", "_x", "_y"], "left")
    return out.select(F.col("_k").alias(key), F.coalesce(F.col("cluster").cast("string"), F.lit(NOISE)).alias(state))
