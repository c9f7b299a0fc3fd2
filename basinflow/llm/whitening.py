"""PCA whitening of embeddings by a tiled covariance.

The dimensions are cut into column blocks; a pair of blocks is a tile of the covariance
matrix. Every batch of rows becomes a row block, its column blocks are shuffled to the
tiles that need them, each task multiplies the pairs it gets and sums them per tile, and
a last aggregation sums the tasks' tiles. So no task holds more than a few blocks and
the tiles it was dealt, whatever the number of rows or dimensions; only the finished
matrix, whose size is that of the dimensions alone, is assembled on the driver, where
its eigenvectors are found.

Vectors are integers (quantised where they come from), so sums are exact: an entry is
centred as ``(n * x - S) / n``, an exact difference divided once, and multiplied after.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .common import Scratch

#: Dimensions of a column block.
TILE = 32
#: Entries of a row block.
BLOCK_ENTRIES = 1 << 20
#: Exact products stay below this.
_LIMIT = 1 << 62


def quantised(column: str, scale: float, offset: int) -> Column:
    """floor(scale * c) + offset of every entry, null if the vector is null, empty or holds null or non-finite entries."""
    c = F.col(column)
    whole = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    x = F.transform(c, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long") + F.lit(offset))
    return F.when(c.isNotNull() & (F.size(c) > 0) & whole, x)


@dataclass(frozen=True)
class Moments:
    """Rows, sums by dimension, and the covariance (divisor n) of centred vectors."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray


@dataclass(frozen=True)
class Whitening:
    """Unit eigenvectors in rows by falling eigenvalue; a component without variance has eigenvalue 0."""

    moments: Moments
    components: np.ndarray
    eigenvalues: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        trace = float(np.trace(self.moments.covariance))
        return self.eigenvalues / trace if trace > 0 else np.zeros_like(self.eigenvalues)


def _matrix(column: pa.Array, dims: int, kind: pa.DataType) -> np.ndarray:
    return column.flatten().cast(kind).to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _sums(vectors: DataFrame, dims: int, exact: bool) -> tuple[int, list]:
    """Number of rows and sums by dimension; exact sums of integers, else floating ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, most = 0, [0] * dims, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dims, pa.int64() if exact else pa.float64())
                # the halves of an integer sum without overflow
                parts = [x] if not exact else [x >> 32, x & 0xFFFFFFFF]
                sums = [p.sum(axis=0).tolist() for p in parts]
                total = [t + s for t, s in zip(total, sums[0] if not exact else [(h << 32) + low for h, low in zip(*sums)])]
                n, most = n + len(x), max(most, int(abs(x).max())) if exact else 0
        if n:
            yield pa.record_batch([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([str(t) if exact else repr(t) for t in total]), pa.array([most] * dims, pa.int64())], names=["d", "n", "s", "most"])

    kind = "decimal(38,0)" if exact else "double"
    rows = vectors.mapInArrow(run, "d int, n long, s string, most long").groupBy("d").agg(F.sum("n"), F.sum(F.col("s").cast(kind)), F.max("most")).collect()
    found = sorted(tuple(r) for r in rows)
    if not found:
        return 0, [0] * dims
    if exact and found[0][1] * max(1, found[0][3]) * 2 >= _LIMIT:
        raise OverflowError(f"{found[0][1]} vectors with entries up to {found[0][3]} exceed exact 64-bit arithmetic")
    return found[0][1], [int(r[2]) if exact else r[2] for r in found]


def moments(vectors: DataFrame, dims: int, exact: bool = True, tile: int = TILE, block_entries: int = BLOCK_ENTRIES) -> Moments:
    """Count, sums and covariance of a table of one array column of ``dims`` entries.

    ``exact`` is for integer vectors; floating ones are centred by their rounded mean.
    """
    n, sums = _sums(vectors, dims, exact)
    if n == 0:
        return Moments(0, tuple(sums), np.zeros((dims, dims)))
    blocks = math.ceil(dims / tile)
    rows = max(1, block_entries // dims)

    def column_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.column(0).slice(at, rows)
                x = _matrix(part, dims, pa.int64() if exact else pa.float64())
                centred = (x * n - np.array(sums, np.int64)) / n if exact else x - np.array(sums) / n
                cut = [np.ascontiguousarray(centred[:, b * tile : (b + 1) * tile]).tobytes() for b in range(blocks)]
                yield pa.record_batch([pa.array([row_block] * blocks, pa.int64()), pa.array(range(blocks), pa.int32()), pa.array(cut, pa.binary())], names=["row_block", "b", "data"])
                row_block += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by tile and row block: the column blocks of a pair follow each other
        at, total, left = None, None, None
        for batch in batches:
            for i, j, row_block, b, data in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (i, j):
                    if at is not None:
                        yield _tile_rows(at, tile, total)
                    at, total, left = (i, j), None, None
                x = np.frombuffer(data, np.float64).reshape(-1, min(tile, dims - b * tile))
                if i == j:
                    part = x.T @ x
                elif b == i:
                    left = (row_block, x)
                    continue
                else:
                    if left is None or left[0] != row_block:
                        raise RuntimeError(f"row block {row_block} of tile {at} lacks a column block")
                    part = left[1].T @ x
                total = part if total is None else total + part
        if at is not None:
            yield _tile_rows(at, tile, total)

    cut = vectors.mapInArrow(column_blocks, "row_block long, b int, data binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    paired = cut.select("row_block", "b", "data", other.alias("o")).select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "row_block", "b", "data")
    # a task gets few tiles where there are many, and all tasks share one where there are few
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, math.ceil(4 * tasks / (blocks * (blocks + 1) // 2)))
    dealt = paired.repartition(tasks, "i", "j", F.pmod(F.xxhash64("row_block"), F.lit(share))).sortWithinPartitions("i", "j", "row_block", "b")
    summed = dealt.mapInArrow(multiply, "r int, c int, v double").groupBy("r", "c").agg(F.sum("v").alias("v"))
    out = np.zeros((dims, dims))
    for r, c, v in summed.collect():
        out[r, c] = out[c, r] = v / n
    return Moments(n, tuple(sums), out)


def _tile_rows(at: tuple[int, int], tile: int, total: np.ndarray) -> pa.RecordBatch:
    r, c = np.indices(total.shape)
    return pa.record_batch([pa.array((r + at[0] * tile).ravel().astype(np.int32)), pa.array((c + at[1] * tile).ravel().astype(np.int32)), pa.array(total.ravel())], names=["r", "c", "v"])


def fit(vectors: DataFrame, dims: int) -> Whitening:
    """The eigenvectors of the covariance of integer vectors."""
    found = moments(vectors, dims)
    values, vectors_ = np.linalg.eigh(found.covariance)
    order = np.argsort(-values, kind="stable")
    values, components = values[order], vectors_.T[order]
    # what rounding leaves of a variance of zero is zero
    values = np.where(values > dims * np.finfo(float).eps * max(values[0], 0.0), values, 0.0) if dims else values
    lead = np.abs(components).argmax(axis=1) if dims else []
    signs = np.sign(components[np.arange(dims), lead]) if dims else np.zeros(0)
    return Whitening(found, components * signs[:, None], values)


def whiten(rows: DataFrame, column: str = "embedding", most: int = 8, scale: float = 1024.0, offset: int = 100_000) -> tuple[DataFrame, Whitening, float | None]:
    """rows with ``whitened`` (array of up to ``most`` components) and ``deviation``; the fit; the identity error.

    Entries become ``floor(scale * c) + offset``. Rows whose vector is null or empty or
    holds null or non-finite entries are left out, as are vectors of another length than
    most rows have (ties: the shorter); equal rows stay as they are, and null ids keep
    their row. The fit and the error cover all remaining rows. A component without
    variance has the whitened value null and takes no part in the error, which is null
    without any. ``deviation`` is the sum over dimensions of ``(n * x - S)^2``, exact, as
    decimal(38,0). Other columns stay, but for ones of the added names.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    kept = rows.drop("whitened", "deviation", "_x").withColumn("_x", quantised(column, scale, offset)).where("_x is not null")
    lengths = kept.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims = lengths[0][0] if lengths else 0
    kept = kept.where(F.size("_x") == dims)
    model = fit(kept.select("_x"), dims)
    n, sums = model.moments.n, model.moments.sums
    k = int(min(most, dims))
    usable = [i for i in range(k) if model.eigenvalues[i] > 0]
    project = (model.components[usable] / np.sqrt(model.eigenvalues[usable])[:, None]).T if usable else np.zeros((dims, 0))
    place = {c: i for i, c in enumerate(usable)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.num_columns - 1), dims, pa.int64()) if dims else np.zeros((batch.num_rows, 0), np.int64)
            z = x * n - np.array(sums, np.int64)
            found = (z / max(n, 1)) @ project
            columns = [pa.array(found[:, place[c]]) if c in place else pa.nulls(len(x), pa.float64()) for c in range(k)]
            ends = np.arange(len(x) + 1, dtype=np.int32) * k
            flat = pa.concat_arrays(columns).take(pa.array(np.arange(len(x) * k).reshape(k, -1).T.ravel())) if k else pa.array([], pa.float64())
            arrays = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(_squares(z), pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "whitened", "deviation"])

    schema = StructType([*kept.schema.fields[:-1], StructField("whitened", ArrayType(DoubleType())), StructField("deviation", StringType())])
    out = kept.mapInArrow(run, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
    out = scratch.keep(out, "whitened")
    if not usable or not n:
        return out, model, None
    again = moments(out.select(F.filter("whitened", lambda x: x.isNotNull()).alias("w")), len(usable), exact=False)
    return out, model, float(np.abs(again.covariance - np.eye(len(usable))).max())


def _squares(z: np.ndarray) -> list[str]:
    """Exact sums of squares of the rows, as decimal text."""
    if z.size == 0:
        return ["0"] * len(z)
    if int(np.abs(z).max()) ** 2 * z.shape[1] < _LIMIT:
        return (z * z).sum(axis=1).astype(str).tolist()
    return [str(s) for s in (z.astype(object) ** 2).sum(axis=1)]
