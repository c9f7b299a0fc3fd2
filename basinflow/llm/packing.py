"""Best-fit packing of tokenised documents with certified bin counts.

Documents become pieces of at most CAPACITY tokens. Pieces are dealt by hash to
partitions of bounded size, each packed best-fit decreasing. Dual-feasible functions
give each partition a lower bound on its bins; a partition that meets it is certified.
Partitions with a gap release their emptier bins, and all others their emptiest one;
released documents meet those of other partitions and are packed again, until one
partition is left or partitions stop getting fewer. A repacking that needs more bins
than it was given is not taken.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import DEFAULT_VOCABULARY, vocabulary_path, worker_tokenizer

CAPACITY = 4096
END_ID = 1
#: Pieces of a partition, on average.
PARTITION_PIECES = 20_000
#: Rounds of exchange after which partitions that don't get fewer are left as they are.
STALLED_ROUNDS = 4

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _tokenise(path: str | None, vocabulary: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path or vocabulary_path(vocabulary))
        end = np.array([END_ID], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[], [], [], [], [], []]
                for doc, ids in zip(part.column(0).to_pylist(), tokenizer.encode(part.column(1).fill_null("").to_pylist())):
                    ids += end
                    for k in range(0, len(ids), step):
                        raw = ids[k : k + step]
                        for c, v in zip(cols, (doc, k // step, k // 4, len(raw) // 4, zlib.crc32(raw), np.frombuffer(raw, "<i4") if with_ids else None)):
                            c.append(v)
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(cols[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(arrays, names=names)

    return run


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual-feasible functions.

    Uses the sum, the functions that drop items below a threshold and round those
    above its complement up to a bin, and the rounding functions u(k) for k to 64.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    total = int((count * size).sum())
    best = -(-total // capacity)
    number, weight = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(0, capacity // 2 + 1)
    below = np.where(t > 0, weight[t - 1], 0)
    large = number[capacity] - number[capacity - t]  # longer than capacity - t
    middle = weight[capacity - t] - below
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 65):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    open_rooms = 0  # bit r: some bin has room r
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = open_rooms >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        if r > size:
            if not room[r - size]:
                open_rooms |= 1 << (r - size)
            room[r - size].append(b)
    return bins, offsets, np.array(fill, np.int64)


def _pack_group(capacity: int, round_no: int, last: bool):
    """Packs one group; its columns but the last four are those of the pieces."""

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        old = table.column("sequence_id").to_numpy()
        group = int(table.column("part")[0].as_py())
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        if round_no:
            _, before = np.unique(old, return_inverse=True)
            if len(fill) > before.max() + 1:
                bins, offsets = before.reshape(-1), table.column("offset").to_numpy()
                fill = np.bincount(bins, lengths).astype(np.int64)
        bound = lower_bound(lengths, capacity)
        released = np.zeros(len(fill), bool)
        if not last:
            gap = len(fill) - bound
            released[np.argsort(fill, kind="stable")[: min(len(fill), 4 * gap + 1)]] = True
            if gap:
                released |= fill < 0.9 * capacity
            released &= fill < capacity
        seq = bins + (group << 24) + (round_no << 56)
        done = [c for c in table.column_names if c not in ("sequence_id", "offset", "part", "released", "round", "bins", "bound")]
        out = table.select(done)
        n = len(lengths)
        for name, values in (("sequence_id", seq), ("offset", offsets), ("part", np.full(n, group)), ("released", released[bins]), ("round", np.full(n, round_no, np.int32)), ("bins", np.full(n, len(fill))), ("bound", np.full(n, bound))):
            out = out.append_column(name, pa.array(values))
        return out

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    capacity: int = CAPACITY,
    vocabulary: str = DEFAULT_VOCABULARY,
    vocabulary_file: str | None = None,
    partition_pieces: int = PARTITION_PIECES,
    with_ids: bool = False,
) -> DataFrame:
    """Packs whole documents into sequences of at most ``capacity`` tokens.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset,
    and what certifies it: round (of packing, from 0), part, bins and bound (of its
    partition in that round); with ``with_ids`` also ids, the piece's tokens. A
    document is its text's ids and END_ID; null and empty texts are END_ID alone. Only
    a document longer than a sequence is cut. Rows that share an id, or have none, are
    packed like any other. Columns besides the two named are not read; an empty table
    gives an empty result. ``vocabulary_file``, a path every executor has, replaces
    the installed vocabulary.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    whole_pieces = scratch.keep(source.mapInArrow(_tokenise(vocabulary_file, vocabulary, capacity, with_ids), schema).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # lengths alone are packed; tokens join their places in the end
    pieces = whole_pieces.drop("ids")
    columns = pieces.columns
    types = _PIECES + ", _row long, sequence_id long, offset long, part long, released boolean, round int, bins long, bound long"

    whole = pieces.where(F.col("length") == capacity).select(
        "*", F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(-1).cast("long").alias("part"), F.lit(False).alias("released"), F.lit(0).alias("round"), F.lit(1).cast("long").alias("bins"), F.lit(1).cast("long").alias("bound"),
    )
    rest = pieces.where(F.col("length") < capacity)
    n = rest.count()
    parts = max(1, math.ceil(n / partition_pieces))
    deal = F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32", "_row"), F.lit(parts))
    todo = rest.withColumn("sequence_id", F.lit(-1).cast("long")).withColumn("offset", F.lit(-1).cast("long")).withColumn("part", deal)
    results = [whole]
    round_no, last, stalled = 0, False, 0
    while n:
        last = last or parts == 1
        packed = scratch.keep(todo.groupBy("part").applyInArrow(_pack_group(capacity, round_no, last), types), f"round{round_no}")
        results.append(packed.where("not released") if not last else packed)
        if last:
            break
        again = packed.where("released")
        n = again.count()
        # several former partitions meet in one, whole bins of each; partitions that exchange
        # without getting fewer than half are given a few rounds
        before, parts = parts, max(1, math.ceil(n / partition_pieces))
        stalled += parts > before // 2
        last = stalled > STALLED_ROUNDS
        round_no += 1
        todo = again.select(*columns, "sequence_id", "offset", F.pmod(F.xxhash64("part", F.lit(round_no)), F.lit(parts)).alias("part"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    if with_ids:
        out = out.join(whole_pieces.select("_row", "ids"), "_row")
    return out.drop("released", "_row")
