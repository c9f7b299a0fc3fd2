"""Transitions between states of ordered frames, in long form.

A matrix is rows (group..., src, dst, value) over all labels of its group, zeros
included. Matrices become wide only where a sink asks for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import energy
from ..functions.labels import is_state
from ..session import written
from .grouping import join_groups

#: Frames of a group that one task orders at most.
CHUNK_FRAMES = 1_000_000


def _pair_rows(frames: DataFrame, state: str, order: str, group: Sequence[str], lag: int, bridge_noise: bool, chunk_frames: int, chunk: str | None = None) -> DataFrame:
    """(group..., chunk, src, dst, at, later): the pairs inside chunks, and half pairs of frames at chunk ends.

    One window over the frames gives all of them. ``at`` is null in a whole pair; in a
    half pair it is the place of the later frame, counted from the chunk's first, and
    ``later`` tells whether the half is that frame. Each frame has one row that isn't
    ``later``.
    """
    if lag < 1:
        raise ValueError(f"lag must be at least 1; got {lag}")
    cut = F.floor(F.col(order).cast("long") / F.lit(chunk_frames)).cast("long") if chunk is None else F.col(chunk)
    rows = frames.select(*group, F.col(state).cast("string").alias("_s"), F.col(order).cast("long").alias("_o"), cut.alias("chunk"))
    if bridge_noise:
        rows = rows.where(is_state(F.col("_s")))
    w = Window.partitionBy(*group, "chunk").orderBy("_o")
    counted = F.count(F.lit(1)).over(Window.partitionBy(*group, "chunk"))
    placed = rows.withColumns({"_i": F.row_number().over(w), "_d": F.lead("_s", lag).over(w), "_n": counted})
    s, i, none = F.col("_s"), F.col("_i"), F.lit(None)

    def row(src: Column, dst: Column, at: Column, later: bool) -> Column:
        return F.struct(src.cast("string").alias("src"), dst.cast("string").alias("dst"), at.cast("long").alias("at"), F.lit(later).alias("later"))

    first = F.when(i > F.col("_n") - lag, row(s, none, i + lag, False)).otherwise(row(s, F.col("_d"), none, False))
    every = F.when(i <= lag, F.array(first, row(none, s, i, True))).otherwise(F.array(first))
    return placed.select(*group, "chunk", F.explode(every).alias("_p")).select(*group, "chunk", "_p.*")


def _across(halves: DataFrame, sizes: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., src, dst) of half pairs whose later frames are the same one.

    ``sizes`` are the chunks' numbers of frames. States are wrapped, so that an unset one
    differs from a half that is missing.
    """
    before = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = join_groups(halves, starts, group, ("chunk",)).withColumn("_key", F.col("_start") + F.col("at"))
    sides = [F.max(F.when(F.col("later") == late, F.struct(c))).alias(c) for c, late in (("src", False), ("dst", True))]
    met = placed.groupBy(*group, "_key").agg(*sides).where("src is not null and dst is not null")
    return met.select(*group, "src.src", "dst.dst")


def lag_pairs(frames: DataFrame, state: str, order: str, group: Sequence[str], *, lag: int = 1, bridge_noise: bool = True, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """(group..., src, dst): each frame's state and that of the frame ``lag`` later in its group.

    With ``bridge_noise`` noise and unset frames are taken out first, so the states on
    either side meet; without it pairs are made on all frames and those that touch noise
    are dropped. ``order`` is an integer unique within a group. A group is ordered in
    chunks of its order, so a long trajectory is many tasks; pairs across chunks are made
    of the few frames at the chunks' ends, by their place in the group.
    """
    rows = _pair_rows(frames, state, order, group, lag, bridge_noise, chunk_frames)
    sizes = rows.where("not later").groupBy(*group, "chunk").agg(F.count(F.lit(1)).alias("n"))
    across = _across(rows.where("at is not null"), sizes, group)
    pairs = rows.where("at is null").select(*group, "src", "dst").unionByName(across)
    return pairs.where(is_state(F.col("src")) & is_state(F.col("dst")))


def summaries(frames: DataFrame, state: str, order: str, group: Sequence[str], *, lag: int = 1, bridge_noise: bool = True, chunk_frames: int = CHUNK_FRAMES, chunk: str | None = None) -> DataFrame:
    """(group..., chunk, src, dst, at, later, count): what each chunk of a group's order has to tell of its transitions.

    Pairs inside the chunk are counted; the frames at its ends, ``lag`` on either side, are
    half pairs. A chunk's summary depends on its own frames alone, and ``merged`` joins
    those of any set of chunks, so frames that are added cost their own chunks only.
    ``chunk`` names a column that has the chunks already: frames that lie by group and
    chunk are then not moved again.
    """
    rows = _pair_rows(frames, state, order, group, lag, bridge_noise, chunk_frames, chunk)
    return rows.groupBy(*group, "chunk", "src", "dst", "at", "later").agg(F.count(F.lit(1)).alias("count"))


def merged(summaries_: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., src, dst, count) of the pairs in the chunks and across their ends, in the order of chunks."""
    sizes = summaries_.where("not later").groupBy(*group, "chunk").agg(F.sum("count").alias("n"))
    across = _across(summaries_.where("at is not null"), sizes, group).withColumn("count", F.lit(1).cast("long"))
    every = summaries_.where("at is null").select(*group, "src", "dst", "count").unionByName(across)
    return every.where(is_state(F.col("src")) & is_state(F.col("dst"))).groupBy(*group, "src", "dst").agg(F.sum("count").alias("count"))


def counts(frames: DataFrame, state: str, order: str, group: Sequence[str], *, lag: int = 1, bridge_noise: bool = True, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """(group..., src, dst, count) of the pairs that occur.

    Frames are read by one window: pairs are counted, and half pairs kept, in one
    aggregate that is written, a few rows for each group and chunk.
    """
    small = written(summaries(frames, state, order, group, lag=lag, bridge_noise=bridge_noise, chunk_frames=chunk_frames), "pairs")
    return merged(small, group)


def matrix_labels(counts_: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., label): the labels of each group's matrix."""
    both = counts_.select(*group, F.explode(F.array("src", "dst")).alias("label"))
    return both.distinct()


def dense_counts(counts_: DataFrame, group: Sequence[str]) -> DataFrame:
    """Counts of all pairs of a group's labels, 0 where none occurs."""
    labels = matrix_labels(counts_, group)
    src, dst = labels.withColumnRenamed("label", "src"), labels.withColumnRenamed("label", "dst")
    grid = join_groups(src, dst, group)
    joined = join_groups(grid, counts_, group, ("src", "dst"), "left")
    return joined.select(*group, "src", "dst", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def probabilities(matrix: DataFrame, group: Sequence[str]) -> DataFrame:
    """A matrix of counts with each row's shares; null in a row without counts."""
    total = F.sum("count").over(Window.partitionBy(*group, "src"))
    return matrix.withColumn("probability", F.when(total > 0, F.col("count") / total))


def rates(matrix: DataFrame, dt: float, lag: int = 1) -> DataFrame:
    """A matrix with probabilities, divided by the time of the lag."""
    if not dt > 0:
        raise ValueError(f"dt must be positive; got {dt}")
    if lag < 1:
        raise ValueError(f"lag must be at least 1; got {lag}")
    return matrix.withColumn("rate", F.col("probability") / F.lit(lag * dt))


def barriers(matrix: DataFrame, temperature: float, model: str = "eyring", *, transmission: float = 1.0, attempt_frequency: float | None = None, conversion: float = 1.0) -> DataFrame:
    """A matrix with rates and the barrier of each; null on the diagonal."""
    value = energy.barrier(F.col("rate"), model, temperature, transmission=transmission, attempt_frequency=attempt_frequency, conversion=conversion)
    return matrix.withColumn("barrier", F.when(F.col("src") != F.col("dst"), value))


def analyse(frames: DataFrame, state: str, order: str, group: Sequence[str], *, lag: int = 1, bridge_noise: bool = True, dt: float | None = None, temperature: float | None = None, model: str = "eyring", **barrier_options) -> DataFrame:
    """Counts, probabilities and, with a time step and a temperature, rates and barriers of every group.

    The frames are read once: their counts, a few rows for each group, are written before
    the joins that make matrices of them.
    """
    found = written(counts(frames, state, order, group, lag=lag, bridge_noise=bridge_noise), "counts")
    return matrices(found, group, lag=lag, dt=dt, temperature=temperature, model=model, **barrier_options)


def matrices(counts_: DataFrame, group: Sequence[str], *, lag: int = 1, dt: float | None = None, temperature: float | None = None, model: str = "eyring", **barrier_options) -> DataFrame:
    """Dense matrices of counted pairs: counts, probabilities and, with a time step and a temperature, rates and barriers."""
    out = probabilities(dense_counts(counts_, group), group)
    if dt is not None:
        out = rates(out, dt, lag)
        if temperature is not None:
            out = barriers(out, temperature, model, **barrier_options)
    return out


def averages(frames: DataFrame, matrix: DataFrame, group: Sequence[str], member: str, *, temperature: float | None = None, model: str = "eyring", **barrier_options) -> DataFrame:
    """Mean matrices over the members (beads) of each parent group.

    ``matrix`` is the dense result of ``analyse`` by ``group``, which includes
    ``member``. Counts: a pair a member lacks is 0, all members of the parent count.
    Probabilities and rates: a row whose state the member lacks takes no part; in a row
    it has, states it lacks are 0. Barriers come from the mean rates.
    """
    parent = [g for g in group if g != member]
    matrix = written(matrix, "matrix")
    members = frames.select(*group).distinct().groupBy(*parent).agg(F.count(F.lit(1)).alias("members"))
    own = matrix_labels(matrix, group)
    union = own.select(*parent, "label").distinct()
    grid = join_groups(union.withColumnRenamed("label", "src"), union.withColumnRenamed("label", "dst"), parent)
    # each member's rows against all states of the parent
    rows = join_groups(own.withColumnRenamed("label", "src"), union.withColumnRenamed("label", "dst"), parent)
    has = own.withColumnRenamed("label", "dst").withColumn("_has", F.lit(True))
    rows = join_groups(rows, has, group, ("dst",), "left")
    values = [c for c in ("probability", "rate") if c in matrix.columns]
    full = join_groups(rows, matrix, group, ("src", "dst"), "left")
    filled = full.select(*parent, "src", "dst", "count", *[F.when(F.col("_has").isNull(), F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in values])
    mean = filled.groupBy(*parent, "src", "dst").agg(F.sum("count").alias("total"), *[F.avg(c).alias(c) for c in values])
    out = join_groups(join_groups(grid, mean, parent, ("src", "dst"), "left"), members, parent)
    out = out.withColumn("count", F.coalesce("total", F.lit(0)) / F.col("members")).select(*parent, "src", "dst", "count", *values)
    if temperature is not None and "rate" in values:
        out = barriers(out, temperature, model, **barrier_options)
    return out


def aggregate(matrices: Sequence[DataFrame], *, temperature: float | None = None, model: str = "eyring", **barrier_options) -> DataFrame:
    """Mean of a list of matrices (src, dst, count, and probability and rate if they have them) over all their labels.

    Each matrix is a member as in ``averages``; an empty list is an error, one matrix
    alone gives its own values.
    """
    if not matrices:
        raise ValueError("there are no matrices to average")
    values = [c for c in ("count", "probability", "rate") if all(c in m.columns for m in matrices)]
    every = reduce(DataFrame.unionByName, [m.select("src", "dst", *values).withColumn("_member", F.lit(i)) for i, m in enumerate(matrices)])
    members = every.sparkSession.range(len(matrices)).select(F.col("id").cast("int").alias("_member"))
    return averages(members, every, ["_member"], "_member", temperature=temperature, model=model, **barrier_options)


def wide(matrix: DataFrame, group: Sequence[str], value: str, labels: Sequence[str]) -> DataFrame:
    """One row for each source state, one column for each destination in ``labels``."""
    return matrix.groupBy(*group, "src").pivot("dst", list(labels)).agg(F.first(value))
