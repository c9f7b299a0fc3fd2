"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u, v) of longs to (node, root), root the smallest node reachable.

    Nodes without an edge to another node are absent. Every round is a few
    aggregations and joins on node ids, its result a written table, so neither
    edges nor labels pass through the driver; the number of rounds grows with the
    logarithm of the graph's size. Null ends and loops are ignored.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now = scratch.keep(e, "edges")
    before = _state(now)
    if before[0] == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        nxt = scratch.keep(small, "edges")
        after = _state(nxt)
        scratch.drop(now)
        now = nxt
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """Number of edges and order-free sums, equal only if a round changed nothing."""
    h = F.xxhash64("u", "v")
    r = edges.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first()
    return r[0], r[1] or 0, r[2] or 0
