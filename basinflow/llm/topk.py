"""Exact top-k inner products with block-at-a-time pruning.

Vectors are documents, their dimensions terms with integer weights. Documents are
dealt to tiles of bounded size; in a tile they are ordered so that neighbours are alike
and cut into ranges, the blocks. A block knows each term's largest and smallest weight,
which bound the score any query can have in it. Per query the blocks are visited in the
order of that bound; visited blocks are scored in full through their forward index (the
block's matrix), until the bounds fall below the query's k-th score. The first tile is
searched before the others, which start from its k-th scores. Tiles' results are merged,
at most k of each tile for each query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK = 64
TILE_DOCUMENTS = 32_768
TILE_QUERIES = 4_096
#: Bytes of the vectors of a tile's documents or queries at most, whatever their width.
TILE_BYTES = 64 << 20


def ordered(x: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """Order of the rows of x in which ranges of ``size`` rows are alike.

    Halves are split at the median along the direction between two far rows.
    """
    out: list[np.ndarray] = []
    stack = [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = x[rows]
        far = part[np.argmax(((part - part[0]) ** 2).sum(axis=1))]
        other = part[np.argmax(((part - far) ** 2).sum(axis=1))]
        along = part @ (other - far)
        # halves are whole blocks, and equal projections keep their order
        order = np.argsort(along, kind="stable")
        half = max(size, (len(rows) // 2 + size - 1) // size * size)
        half = half if half < len(rows) else len(rows) // 2
        stack += [rows[order[half:]], rows[order[:half]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Tile:
    """Blocks of documents with their bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, size: int = BLOCK):
        by_id = np.lexsort((ids,))
        ids, x = ids[by_id], x[by_id]
        order = ordered(x, size)
        self.ids, self.x = ids[order], x[order]
        self.starts = np.arange(0, len(ids), size)
        self.ends = np.append(self.starts[1:], len(ids))
        self.high = np.maximum.reduceat(self.x, self.starts, axis=0) if len(ids) else x
        self.low = np.minimum.reduceat(self.x, self.starts, axis=0) if len(ids) else x

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Largest score each query (row of q) can have in each block."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, first: int = 4, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query row, document id, score) of each query's k best documents but itself, and how many blocks were scored.

        With ``least``, documents below a query's least score may be missing.
        """
        n = len(query_ids)
        bound = self.bounds(q)
        floor = np.full(n, -np.inf) if least is None else least
        order = np.argsort(-bound, axis=1, kind="stable")
        best = np.full((n, k), -np.inf)
        best_ids = np.full((n, k), np.iinfo(np.int64).max)
        at, step, scored = 0, first, 0
        blocks = len(self.starts)
        while at < blocks:
            turn = order[:, at : at + step]
            # a block that can only tie the k-th score may still hold a smaller id
            live = np.take_along_axis(bound, turn, 1) >= np.maximum(best[:, -1], floor)[:, None]
            if not live.any():
                break
            rows, cols = np.nonzero(live)
            which = turn[rows, cols]
            by_block = np.argsort(which, kind="stable")
            rows, which = rows[by_block], which[by_block]
            scored += len(rows)
            cut = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(cut, np.append(cut[1:], len(which))):
                own, s = rows[a:b], slice(self.starts[which[a]], self.ends[which[a]])
                score, ids = q[own] @ self.x[s].T, self.ids[s]
                ok = (score >= best[own, -1:]) & (ids[None, :] != query_ids[own][:, None])
                i, j = np.nonzero(ok)
                found.append((own[i], ids[j], score[i, j]))
            r, d, s = (np.concatenate(c) for c in zip(*found))
            touched = np.unique(r)
            r = np.concatenate([r, np.repeat(touched, k)])
            d, s = np.concatenate([d, best_ids[touched].ravel()]), np.concatenate([s, best[touched].ravel()])
            rank = np.lexsort((d, -s, r))
            r, d, s = r[rank], d[rank], s[rank]
            head = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            nth = np.arange(len(r)) - np.repeat(head, np.diff(np.append(head, len(r))))
            top = nth < k
            best[r[top], nth[top]], best_ids[r[top], nth[top]] = s[top], d[top]
            at += step
            step *= 2
        rows, cols = np.nonzero(best > -np.inf)
        return rows, best_ids[rows, cols], best[rows, cols], scored


def _integers(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values, float)
                if np.isfinite(x).all():
                    ids.append(i)
                    out.append(np.floor(scale * x).tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "x"])

    return run


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    raw = column.to_pylist()
    out = np.zeros((len(raw), width))
    for i, b in enumerate(raw):
        v = np.frombuffer(b)
        out[i, : len(v)] = v
    return out


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = 20,
    query_divisor: int = 20,
    scale: float = 64.0,
    tile_documents: int = TILE_DOCUMENTS,
    tile_queries: int = TILE_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query.

    Components become floor(scale * x). Queries are the rows whose id is divisible by
    ``query_divisor``; candidates are all rows but those of the query's own id; ties go
    to the smaller id. Null vectors, vectors with a null or non-finite component and rows
    without id take no part; a shorter vector counts as padded with zeros. A repeated id
    is searched once for each of its rows, and each of its rows is a candidate. Scores
    are exact while they stay below 2**53 in absolute value. An empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top-k")
    source = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("x"))
    rows = scratch.keep(source.mapInArrow(_integers(scale), "id long, x binary").withColumn("row", F.monotonically_increasing_id()), "integers")
    is_query = F.pmod(F.col("id"), F.lit(query_divisor)) == 0
    n, queries, width = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.max(F.length("x"))).first()
    most = max(1, TILE_BYTES // max(width or 8, 8))
    down, across, width = max(1, math.ceil(n / min(tile_documents, most))), max(1, math.ceil(queries / min(tile_queries, most))), (width or 0) // 8

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tile = Tile(np.asarray(left.column("id")), _matrix(left.column("x"), width))
        own, ids = np.asarray(right.column("query")), np.asarray(right.column("row"))
        if not len(tile.ids) or not len(own):
            r, d, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            least = np.asarray(right.column("least").fill_null(-np.inf))
            r, d, s, _ = tile.search(own, _matrix(right.column("q"), width), k, least=least)
        return pa.table({"row": ids[r], "query_id": own[r], "vec_id": d, "score": s.astype(np.int64)}, pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    def dealt(parts: int, seed: int):
        # by row: an id that many rows share is dealt to many tiles
        return F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(parts)).cast("int")

    docs = rows.select("id", "x", dealt(down, 1).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j"))
    # named anew: the two sides of a cogroup must not share columns, or unused ones are pruned wrongly
    asked = rows.where(is_query).select(F.col("id").alias("query"), F.col("x").alias("q"), F.col("row").alias("row"), dealt(across, 2).alias("j"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")

    def searched(which: Column, least: DataFrame | None) -> DataFrame:
        """Results of the tiles that a condition on i selects."""
        tiles = F.array(F.lit(0)) if least is None else F.sequence(F.lit(1), F.lit(down - 1))
        some = asked.withColumn("least", F.lit(None).cast("double")) if least is None else asked.join(least, "row", "left")
        some = some.withColumn("i", F.explode(tiles))
        return docs.where(which).groupBy("i", "j").cogroup(some.groupBy("i", "j")).applyInArrow(search, "row long, query_id long, vec_id long, score long")

    found = searched(F.col("i") == 0, None)
    if down > 1:
        found = scratch.keep(found, "first-tile")
        # a k-th score of one tile is a lower bound of that of all
        least = found.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k).drop("n")
        found = found.union(searched(F.col("i") > 0, least))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
