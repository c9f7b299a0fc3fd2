"""The coordinate table: its schema, row numbers, union, sampling and records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

#: Columns every coordinate table starts with, in order.
CORE = T.StructType(
    [
        T.StructField("frame_id", T.LongType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("trajectory_id", T.StringType()),
        T.StructField("bead_id", T.StringType()),
        T.StructField("frame_number", T.LongType()),
        T.StructField("byte_offset", T.LongType()),
        T.StructField("atom_count", T.LongType()),
        T.StructField("comment_line", T.StringType()),
        T.StructField("local_frame_index", T.LongType()),
        T.StructField("global_frame_index", T.LongType()),
    ]
)
#: Low bits of ``monotonically_increasing_id`` that hold a row's place in its partition.
_PLACE_BITS = 33
#: Columns a coordinate table may end with.
OPTIONAL = {"energy": T.FloatType(), "step_number": T.LongType()}


def validated(frames: DataFrame, floats: Sequence[str] = ()) -> DataFrame:
    """frames with the core columns first and cast to their types; an error if one is missing.

    Other columns keep their order; those named in ``floats`` and the optional ones are
    cast, values that are no number becoming null.
    """
    lacking = [f.name for f in CORE if f.name not in frames.columns]
    if lacking:
        raise ValueError(f"the coordinate table lacks the columns {lacking}")
    kinds = {f.name: f.dataType for f in CORE} | OPTIONAL | {c: T.FloatType() for c in floats}
    order = [f.name for f in CORE] + [c for c in frames.columns if c not in CORE.names]
    text = {c for c, k in kinds.items() if isinstance(k, T.StringType)}
    return frames.select(*[(F.col(c).cast(kinds[c]) if c in text else F.col(c).try_cast(kinds[c])).alias(c) if c in kinds else F.col(c) for c in order])


def number_rows(frames: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """frames numbered from 0 in an order, without one task sorting them all.

    Rows are range-partitioned and sorted, their one shuffle; a row's id holds its
    partition and its place there, and each partition is numbered after those before it.
    Only a count for each partition meets in one place. The order must be unique for the
    numbers to be the same on every run.
    """
    spark = frames.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = frames.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the range bounds come from samples: the assignment is written once, then both steps read it
    placed = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("_id", _PLACE_BITS).alias("_p")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # as many rows as there are partitions
    local = placed.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return local.withColumn(name, F.col("_start") + F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1)).drop("_p", "_id", "_start")


def concatenated(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of the tables, matched by name; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def sample_exact(frames: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows (all, if fewer), the same for a seed whatever the partitioning: those whose key has the smallest digests."""
    drawn = F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]))
    return frames.orderBy(drawn, *key).limit(n)


def records(frames: DataFrame, name: str) -> DataFrame:
    """frames with a JSON record of all their columns; NaN and null are null."""
    kinds = dict(frames.dtypes)
    clean = [F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if kinds[c] in ("float", "double") else F.col(c) for c in frames.columns]
    return frames.withColumn(name, F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}))
