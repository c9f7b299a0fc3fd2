"""States over a population map: the majority state of each bin, and state centres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import is_state, natural_order
from .density import Edges, binned


def _natural_key(label: Column) -> Column:
    """Struct that orders labels naturally, null (no state) last."""
    digits = label.rlike("^[0-9]+$")
    return F.struct(
        F.when(label.isNull(), 2).when(digits, 0).otherwise(1).alias("kind"),
        F.coalesce(F.when(digits, label.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("number"),
        F.coalesce(label, F.lit("")).alias("label"),
    )


def majority_states(frames: DataFrame, x: str, y: str, state: str, x_edges: Edges, y_edges: Edges, group: Sequence[str] = ()) -> DataFrame:
    """(group..., xi, yi, bin, state, frames): the state most frames of a bin have.

    Noise and unset frames vote for no state, and blank the bin if they win; ties go to
    a state, then to the label that sorts first naturally. ``bin`` is yi * bins_x + xi.
    """
    b = binned(frames.select(*group, x, y, state), x, y, x_edges, y_edges)
    b = b.withColumn("_s", F.when(is_state(F.col(state)), F.col(state)))
    votes = b.groupBy(*group, "xi", "yi", "_s").agg(F.count(F.lit(1)).alias("frames"))
    best = F.min(F.struct((-F.col("frames")).alias("n"), _natural_key(F.col("_s")).alias("k")))
    won = votes.groupBy(*group, "xi", "yi").agg(best.alias("_b"))
    out = won.where(F.col("_b.k.kind") < 2)
    nx = len(x_edges) - 1
    return out.select(*group, "xi", "yi", (F.col("yi") * nx + F.col("xi")).alias("bin"), F.col("_b.k.label").alias(state), (-F.col("_b.n")).alias("frames"))


def state_centres(frames: DataFrame, x: str, y: str, state: str, x_edges: Edges, y_edges: Edges, group: Sequence[str] = (), periodic: bool = False) -> DataFrame:
    """(group..., state, x, y, frames): mean position of each state's frames on the map, circular on periodic axes."""
    b = binned(frames.select(*group, x, y, state), x, y, x_edges, y_edges).where(is_state(F.col(state)))

    def centre(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.degrees(F.atan2(F.avg(F.sin(F.radians(v))), F.avg(F.cos(F.radians(v))))) if periodic else F.avg(v)

    return b.groupBy(*group, state).agg(centre(x).alias("centre_x"), centre(y).alias("centre_y"), F.count(F.lit(1)).alias("frames"))


def state_labels(frames: DataFrame, state: str) -> DataFrame:
    """Every state label with its 0-based place in natural order.

    The number of distinct labels is that of clusters, so their order is one small sort.
    """
    from pyspark.sql import Window

    labels = frames.where(is_state(F.col(state))).select(state).distinct()
    return labels.withColumn("position", F.row_number().over(Window.orderBy(*natural_order(F.col(state)))) - 1)


def group_name(group: Sequence[str]) -> Column:
    """Readable name of a group: its keys, beads marked, joined by slashes."""
    if not group:
        return F.lit("all frames")
    parts = [F.concat(F.lit("bead " if c == "bead_id" else ""), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in group]
    return F.concat_ws(" / ", *parts)
