"""A population landscape of any table of ordered rows: of structures, or of texts.

    python -m jobs.landscape --source TABLE --target OUT --checkpoint WORK --config jobs/landscape.json

Two coordinates of each row are SQL expressions. They are measured once into a narrow
table (``checkpoint/frames``); then ``target`` gets, by group, every occupied bin of the
map with its count, its free energy above the group's most populated bin, the row nearest
to its centre, and its state: populated bins that touch are one state, others are noise.
The texts, or structures, themselves are read once and shuffled nowhere. A run writes
both folders anew, so it can be repeated at any time with the same result.

Config: ``format`` of the source, ``x`` and ``y`` (SQL expressions), ``order`` (columns
that tell rows apart), ``group`` (columns; the first partitions the output), ``x_domain``,
``y_domain`` (low and high), ``x_step``, ``y_step``, ``min_count`` of a populated bin,
``periodic``, ``unit`` and ``temperature`` of the energies.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.functions import binning
from basinflow.functions.labels import NOISE
from basinflow.operators import density, grid_states
from basinflow.operators.grouping import join_groups

from .common import LOG, main


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: Mapping[str, Any]) -> dict[str, int]:
    """Measures the source and writes its landscape; the rows read and the bins written."""
    group, order = list(config["group"]), list(config["order"])
    rows = spark.read.format(config.get("format", "parquet")).load(source)
    measured = rows.select(*group, *order, F.expr(config["x"]).cast("double").alias("x"), F.expr(config["y"]).cast("double").alias("y"))
    measured.write.mode("overwrite").parquet(f"{checkpoint}/frames")
    frames = spark.read.schema(measured.schema).parquet(f"{checkpoint}/frames")
    read = frames.count()
    LOG.info("%d rows read from %s", read, source)

    # the bins of all groups, a few rows for each: what follows reads them more than once
    bins = _bins(frames, config)
    bins.write.mode("overwrite").parquet(f"{checkpoint}/bins")
    out = _landscape(spark.read.schema(bins.schema).parquet(f"{checkpoint}/bins"), config)
    out.hint("rebalance", group[0]).write.mode("overwrite").partitionBy(group[0]).parquet(target)
    wrote = spark.read.schema(out.schema).parquet(target).count()
    LOG.info("%d bins written to %s", wrote, target)
    return {"read": read, "written": wrote}


def _edges(config: Mapping[str, Any]) -> tuple[list[float], list[float]]:
    return binning.stepped_edges(*config["x_domain"], config["x_step"]), binning.stepped_edges(*config["y_domain"], config["y_step"])


def _bins(frames: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """(group..., xi, yi, count, order..., x, y): each occupied bin and the row nearest to its centre, by one aggregate."""
    return density.representatives(frames, "x", "y", *_edges(config), list(config["order"]), list(config["group"]), count="count").drop("distance2")


def _landscape(bins: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """The bins with their free energy and state."""
    group = list(config["group"])
    nx, ny = (len(e) - 1 for e in _edges(config))
    energy = density.free_energy(bins, config.get("unit", "kT"), config.get("temperature"), group)
    states = grid_states.label_cells(bins.select(*group, "xi", "yi", "count"), nx, ny, int(config["min_count"]), group, bool(config.get("periodic", False)))
    named = states.select(*group, "xi", "yi", F.col("component").cast("string").alias("state"))
    return join_groups(energy, named, group, ("xi", "yi"), "left").withColumn("state", F.coalesce("state", F.lit(NOISE)))


def read_landscape(spark: SparkSession, source: str, target: str, config: Mapping[str, Any]) -> DataFrame:
    """The landscape that a run has left, with the source's own types of group and order."""
    kinds = dict(spark.read.format(config.get("format", "parquet")).load(source).dtypes)
    typed = lambda names: ", ".join(f"`{c}` {kinds[c]}" for c in names)
    out = spark.read.schema(f"{typed(config['group'])}, xi int, yi int, count long, {typed(config['order'])}, x double, y double, free_energy double, state string").parquet(target)
    return out.select(*config["group"], *[c for c in out.columns if c not in config["group"]])


if __name__ == "__main__":
    main(run, __doc__)
