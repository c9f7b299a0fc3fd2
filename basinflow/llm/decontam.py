"""Benchmark passages inside documents by size-partitioned containment search.

A test item is the set of its word shingles. Items are partitioned by size; of an
item of a partition with up to u shingles, the sketch is its k smallest hashes, k one
more than the shingles a match may lack. A document that holds the threshold's
share of an item then holds one of its sketch hashes at least, so probing the sketch
index with a document's shingles misses no match whatever the document's length. The
share of the sketch that a document holds estimates the containment; pairs that may
reach the threshold are verified on the exact shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import Scratch

#: Bytes of shingle hashes that one pass over the documents broadcasts at most, about.
INDEX_BYTES = 32 << 20


def _item_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list = [None] * len(batch)
            for r, s in hashing.shingle_sets(_lowered(batch.column(1)), hashing.ALNUM, n):
                sets[r] = s.view(np.int64)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["item_id", "hashes"])

    return run


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(hashing.as_strings(column))


class ContainmentIndex:
    """Sketches and sets of some items, by size partition."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int):
        self.items, self.percent = items, percent
        self.need = np.array([-(-percent * len(s) // 100) for _, s in items], np.int64)
        hashes, owner = [], []
        for i, (_, s) in enumerate(items):
            upper = 1 << math.ceil(math.log2(len(s))) if len(s) > 1 else 1
            k = min(len(s), upper - -(-percent * upper // 100) + 1)
            k = max(k, len(s) - int(self.need[i]) + 1)
            hashes.append(np.sort(s)[:k])
            owner.append(np.full(k, i))
        self.sketch_size = np.array([len(h) for h in hashes], np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        o = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owner = h[order], o[order]
        self.keys, self.first = np.unique(self.hashes, return_index=True)
        self.last = np.append(self.first[1:], len(self.hashes))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def search(self, value: np.ndarray, number: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of rows of shingle hashes that hold an item."""
        if not len(self.keys):
            return
        maybe = np.flatnonzero(self.filter[(value >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.keys, value[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == value[maybe]
        maybe, at = maybe[hit], at[hit]
        if not len(maybe):
            return
        edge = np.concatenate([[0], np.cumsum(number)])
        row = np.searchsorted(edge, maybe, side="right") - 1
        for r in np.unique(row):
            found = np.unique(at[row == r])
            owners, hits = np.unique(np.concatenate([self.owner[self.first[k] : self.last[k]] for k in found]), return_counts=True)
            # the rest of the sketch is missing from the document
            lacking = np.array([len(self.items[i][1]) for i in owners]) - self.need[owners]
            owners = owners[self.sketch_size[owners] - hits <= lacking]
            if not len(owners):
                continue
            own = hashing.distinct(value[edge[r] : edge[r + 1]])
            for i in owners:
                s = self.items[i][1]
                p = np.searchsorted(own, s)
                p[p == len(own)] = 0
                shared = int((own[p] == s).sum())
                if shared >= self.need[i]:
                    yield int(r), int(i), shared


def _rows(batch: pa.RecordBatch, text: int, n: int, index: ContainmentIndex) -> Iterator[tuple[int, int, int]]:
    for at, hashes, counts in hashing.words(_lowered(batch.column(text)), hashing.ALNUM):
        value, number = hashing.shingles(hashes, counts, n)
        for r, i, shared in index.search(value, number):
            yield at + r, i, shared


def _passes(items: DataFrame, item_id_col: str, item_text_col: str, n: int, percent: int, index_bytes: int):
    """Broadcast indexes that hold all items together, each within the bound on average."""
    spark = items.sparkSession
    scratch = Scratch(spark, "decontamination")
    source = items.select(items[item_id_col].cast("long").alias("item_id"), items[item_text_col].cast("string").alias("text"))
    sets = scratch.keep(source.mapInArrow(_item_sets(n), "item_id long, hashes array<long>").where("size(hashes) > 0"), "items")
    total = sets.agg(F.sum(F.size("hashes"))).first()[0] or 0
    passes = max(1, math.ceil(total * 8 / index_bytes))
    for p in range(passes):
        mine = sets.where(F.pmod(F.xxhash64("item_id", "hashes"), F.lit(passes)) == p) if passes > 1 else sets
        rows = [(r[0], np.sort(np.array(r[1], np.int64).view(np.uint64))) for r in mine.collect()]
        yield spark.sparkContext.broadcast(ContainmentIndex(rows, percent))


def find_contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """Pairs of documents and the test items they contain.

    Returns (doc_id, item_id, n_item, n_shared): of the item's n_item distinct
    shingles, n_shared are in the document, 100 * n_shared >= percent * n_item. Words
    are runs of letters and digits in lower case; a text of fewer words than a shingle
    is one shingle, a text without words has none and neither contains nor is
    contained. Every row counts, rows with repeated or null ids too. Documents aren't
    shuffled: each pass scans them against a broadcast part of the items whose size is
    counted first, and more items make more passes. Extra columns are not read; an
    empty table on either side gives an empty result.
    """

    def search(shared_index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared_index.value
            for batch in batches:
                found = list(_rows(batch, 1, shingle_words, index))
                at = pa.array([r for r, _, _ in found], pa.int64())
                own = [index.items[i] for _, i, _ in found]
                yield pa.record_batch([batch.column(0).take(at), pa.array([i for i, _ in own], pa.int64()), pa.array([len(s) for _, s in own], pa.int64()), pa.array([k for _, _, k in found], pa.int64())], names=["doc_id", "item_id", "n_item", "n_shared"])

        return run

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = None
    for index in _passes(items, item_id_col, item_text_col, shingle_words, percent, index_bytes):
        part = source.mapInArrow(search(index), "doc_id long, item_id long, n_item long, n_shared long")
        out = part if out is None else out.union(part)
    return out


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    *,
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """The rows of docs, all columns as they are, that contain no test item."""
    at = docs.columns.index(text_col)

    def keep(shared_index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[r for r, _, _ in _rows(batch, at, shingle_words, shared_index.value)]] = False
                yield batch.filter(pa.array(clean))

        return run

    out = docs
    for index in _passes(items, item_id_col, item_text_col, shingle_words, percent, index_bytes):
        out = out.mapInArrow(keep(index), docs.schema)
    return out
