"""Transition matrices of simulations that are still running, kept up to date by what is new.

    python -m jobs.transitions --source FRAMES --target OUT --checkpoint MARKS --config jobs/transitions.json

``source`` is a folder, or a pattern of files. A run takes the files that have appeared
there since the last one (a file stream with ``availableNow``; its checkpoint is the
mark), and leaves

- ``target/frames/batch=B/chunk=C``: the frames it has taken, their group, order and state alone,
- ``target/summaries/chunk=C``: of each chunk of the order, counted pairs and the frames at its ends,
- ``target/counts``: the pairs of every group, counted over all chunks,
- ``target/matrix``: counts, probabilities and rates of every group, by the partition column,
- ``target/current``: the config that the matrix was made with; empty while summaries are newer.

Files may come in any order. Only chunks that a batch has frames of are summarised anew,
by dynamic partition overwrite; matrices are merged from the summaries, which are a few
rows for each group and chunk, if summaries have changed since the last one was made. A
batch that is run again after a failure writes the same folders again. A frame that is delivered twice counts once; of two states the smaller stays.

Config: ``format`` and ``schema`` of the source (without a schema, that of the present
files), ``group`` (name to SQL expression), ``order`` (an SQL expression, an integer),
``state`` (an SQL expression), ``chunk_frames``, ``lag``, ``bridge_noise``, ``dt``,
``temperature``, ``partition_by`` (a group column), ``files_per_batch``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basinflow.operators import transitions

from .common import LOG, main


def _frames(rows: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """Group, order, state and chunk of each source row; rows without an order have no chunk and take part in nothing."""
    group = [F.expr(e).alias(c) for c, e in config["group"].items()]
    order = F.expr(config["order"]).cast("long")
    chunk = F.floor(order / F.lit(int(config["chunk_frames"]))).cast("long")
    return rows.select(*group, order.alias("frame_order"), F.expr(config["state"]).cast("string").alias("state"), chunk.alias("chunk"))


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: Mapping[str, Any]) -> dict[str, int]:
    """Takes what is new and renews the matrices; the rows read, of summaries renewed, and of the matrix."""
    group = list(config["group"])
    form = config.get("format", "parquet")
    schema = config.get("schema") or spark.read.format(form).load(source).schema
    lag, bridge = int(config.get("lag", 1)), bool(config.get("bridge_noise", True))
    log = {"read": 0, "summaries": 0, "matrix": 0}
    settings = json.dumps(dict(config), sort_keys=True)

    def mark(text: str) -> None:
        spark.range(1).select(F.lit(text).alias("settings")).write.mode("overwrite").parquet(f"{target}/current")

    def take(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        folder = f"{target}/frames/batch={number}"
        taken = _frames(batch, config)
        # one chunk's frames go to few files, a crowded chunk's to more
        taken.hint("rebalance", "chunk").write.mode("overwrite").partitionBy("chunk").parquet(folder)
        narrow = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema)
        new = here.read.schema(narrow).parquet(folder)
        read, low, high = new.agg(F.count(F.lit(1)), F.min("chunk"), F.max("chunk")).first()
        log["read"] += read
        if low is None:
            return
        frames = here.read.schema(f"batch long, {narrow}").parquet(f"{target}/frames")
        # the range prunes folders, the semi-join leaves the chunks that have new frames
        touched = frames.where(F.col("chunk").between(low, high)).join(new.select("chunk").distinct(), "chunk", "left_semi")
        # one exchange and one sort serve this and the summary: the least state of a frame stays
        before = F.lag("frame_order").over(Window.partitionBy(*group, "chunk").orderBy("frame_order", F.asc_nulls_last("state")))
        once = touched.withColumn("_before", before).where("_before is null or _before <> frame_order").drop("_before")
        made = transitions.summaries(once, "state", "frame_order", group, lag=lag, bridge_noise=bridge, chunk="chunk")
        mark("")
        # one file for a chunk, not one for each task and chunk
        made.hint("rebalance", "chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(f"{target}/summaries")
        wrote = here.read.schema(kept).parquet(f"{target}/summaries").where(F.col("chunk").between(low, high)).count()
        log["summaries"] += wrote
        LOG.info("batch %d: %d rows read; chunks %d to %d have %d summary rows now", number, read, low, high, wrote)

    columns = _group_columns(spark, schema, config)
    kept = f"{columns}, src string, dst string, at long, later boolean, count long, chunk long"
    # the folder exists from the first run on, whatever that finds
    spark.createDataFrame([], kept).write.mode("append").partitionBy("chunk").parquet(f"{target}/summaries")
    spark.createDataFrame([], "settings string").write.mode("append").parquet(f"{target}/current")
    reader = spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", int(config.get("files_per_batch", 1000)))
    writer = reader.load(source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()

    made_with = spark.read.schema("settings string").parquet(f"{target}/current").first()
    if made_with is None or made_with[0] != settings:
        temperature = config.get("temperature")
        every = spark.read.schema(kept).parquet(f"{target}/summaries")
        merged = transitions.merged(every, group)
        merged.write.mode("overwrite").parquet(f"{target}/counts")
        # written, since the matrix reads the counts several times
        counts = spark.read.schema(merged.schema).parquet(f"{target}/counts")
        matrix = transitions.matrices(counts, group, lag=lag, dt=config.get("dt"), temperature=temperature)
        by = config["partition_by"]
        matrix.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(f"{target}/matrix")
        mark(settings)
    log["matrix"] = spark.read.schema(f"{columns}, src string, dst string").parquet(f"{target}/matrix").count()
    LOG.info("%d rows read from %s, %s/matrix has %d rows", log["read"], source, target, log["matrix"])
    return log


def _group_columns(spark: SparkSession, schema: StructType | str, config: Mapping[str, Any]) -> str:
    kinds = _frames(spark.createDataFrame([], schema), config).schema
    return ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in config["group"])


def read_matrix(spark: SparkSession, target: str, schema: StructType | str, config: Mapping[str, Any]) -> DataFrame:
    """The matrix that runs have left, with the group columns' own types; ``schema`` is the source's."""
    values = "count long, probability double" + (", rate double" if config.get("dt") else "") + (", barrier double" if config.get("dt") and config.get("temperature") else "")
    out = spark.read.schema(f"{_group_columns(spark, schema, config)}, src string, dst string, {values}").parquet(f"{target}/matrix")
    return out.select(*config["group"], *[c for c in out.columns if c not in config["group"]])


if __name__ == "__main__":
    main(run, __doc__)
