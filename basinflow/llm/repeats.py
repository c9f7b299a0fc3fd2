"""Long exact repeats between documents, found by run-length indexes of what may repeat.

A window is ``span`` bytes of one document. Of a window's ``key``-byte strings the one with
the least hash is its key (ties: the first), so equal windows have equal keys at equal
places. Documents are dealt to parts of some megabytes and written once, bucketed by
part; keys are dealt to buckets by their hash. Parts ask buckets two things:

1. which of their keys stand in other documents too; the answer is a number a key;
2. of the strings around those keys, which windows begin in a document of a smaller id.
   Equal strings of a part ask once. A bucket puts the strings of all parts into
   run-length Burrows-Wheeler indexes and streams them against these.

So a passage that fills a third of all documents reaches its bucket once a part. The
strings at its ends differ from document to document, though, under one key. Around a
key of very many documents parts therefore ask for every window by itself, dealt by the
window's own hash: equal ones ask once a part, and different ones go to different
buckets. No task holds more than a part, or a bucket's questions.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .hashing import mix
from .run_index import PAD, RunIndex

SPAN = 50
KEY = 20
#: Bytes of text of a part, on average.
PART_BYTES = 8 << 20
#: Files of parts at most; beyond, a file has several parts.
MOST_FILES = 50_000
#: Documents that make a key a common one.
COMMON = 1 << 14
#: Strings that go into one index.
INDEX_STRINGS = 1 << 14
_SLICE = 1 << 19
_MASK = np.uint64((1 << 48) - 1)
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


# ------------------------------------------------------------------ keys and the strings around them


def _byte_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; beyond the end are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, strides=(1,)).copy()


def _hashes(data: np.ndarray, key: int) -> np.ndarray:
    """Hash of the key-byte string at each place."""
    w = np.concatenate([_byte_words(data), np.zeros(key, np.uint64)])
    n = len(data)
    h = w[:n] * _C[0]
    for o, c in zip(sorted({min(8, key - 8), key - 8} - {0}), _C[1:]):
        h = h + mix(w[o : o + n]) * c
    return mix(h)


def keys_of(data: np.ndarray, offsets: np.ndarray, span: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that are the key of a window, ascending, and their 48-bit hashes; windows lie in one document."""
    places, hashes = [], []
    reach = span - key + 1
    for a in range(0, len(data), _SLICE):
        part = data[a : a + _SLICE + span - 1]
        n = min(_SLICE, len(part) - span + 1)
        if n <= 0:
            break
        h = _hashes(part, key)
        best = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if reach > width:
            best = np.minimum(best[: len(best) - (reach - width)], best[reach - width :])
        inside = np.ones(n, bool)
        ends = offsets[np.searchsorted(offsets, a, side="right") : np.searchsorted(offsets, a + n + span, side="left")] - a
        crossing = (ends[:, None] - np.arange(1, span)[None, :]).ravel()
        inside[crossing[(crossing >= 0) & (crossing < n)]] = False
        marked = np.zeros(len(part), bool)
        marked[(best[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)[inside]] = True
        at = np.flatnonzero(marked)
        places.append(at + a)
        hashes.append(h[at] & _MASK)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def strings_around(data: np.ndarray, offsets: np.ndarray, places: np.ndarray, span: int, key: int) -> np.ndarray:
    """Bytes of all windows that can hold the key at each place; beyond the document's ends are pads."""
    before, width = span - key, 2 * span - key
    padded = np.concatenate([np.full(before, PAD, np.uint8), data, np.full(span, PAD, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, width)[places].copy()
    row = np.searchsorted(offsets, places, side="right") - 1
    left, right = places - offsets[row], offsets[row + 1] - places
    short = np.flatnonzero((left < before) | (right < span))
    column = np.arange(width)[None, :]
    out[short] = np.where((column < before - left[short, None]) | (column >= before + right[short, None]), PAD, out[short])
    return out


def _rows_as_values(rows: np.ndarray) -> np.ndarray:
    rows = np.ascontiguousarray(rows)
    return rows.view(np.dtype((np.void, rows.shape[1]))).ravel()


def _window_hashes(windows: np.ndarray) -> np.ndarray:
    """48-bit hash of each row of bytes."""
    words = np.zeros((len(windows), -(-windows.shape[1] // 8) * 8), np.uint8)
    words[:, : windows.shape[1]] = windows
    h = np.zeros(len(windows), np.uint64)
    for word in words.view("<u8").T:
        h = mix(h * _C[0] + word * _C[1] + _C[2])
    return h & _MASK


def _group(*columns: np.ndarray) -> np.ndarray:
    """Number of each row's group of equal values in all columns."""
    _, out = np.unique(columns[0], return_inverse=True)
    for c in columns[1:]:
        _, n = np.unique(c, return_inverse=True)
        _, out = np.unique(out * (int(n.max(initial=0)) + 1) + n, return_inverse=True)
    return out


def _pack(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


# ------------------------------------------------------------------ what a bucket answers


def seen_before(strings: np.ndarray, group: np.ndarray, docs: np.ndarray, span: int, at_most: int = INDEX_STRINGS) -> np.ndarray:
    """Bits of each string's windows that begin, in a string of its group, in a document of a smaller id.

    Strings of a group that is too large for one index are split by window: the windows of
    either half share more bytes, and strings meet only where they agree in those.
    """
    windows = strings.shape[1] - span + 1
    full = np.uint32((1 << windows) - 1)
    if len(strings) == 0:
        return np.zeros(0, np.uint32)
    # equal strings: of the smallest document, one is asked for; the others repeat it whole
    alike = _group(_rows_as_values(strings), group)
    order = np.lexsort((docs, alike))
    head = np.ones(len(order), bool)
    head[1:] = alike[order][1:] != alike[order][:-1]
    first = order[head]
    bits = np.where(docs > docs[first][alike], full, np.uint32(0))
    rows, of, least = strings[first], group[first], docs[first]
    # strings that share no half of their windows' common bytes with another one of the group have no window in common
    related = np.zeros(len(rows), bool)
    for low, high in ((0, (windows - 1) // 2), ((windows - 1) // 2 + 1, windows - 1)):
        if low <= high:
            shared = _group(_rows_as_values(rows[:, high : low + span]), of)
            related |= np.bincount(shared)[shared] > 1
    found = np.zeros(len(rows), np.uint32)
    at = np.flatnonzero(related)
    at = at[np.argsort(of[at], kind="stable")]
    edges = np.append(np.flatnonzero(np.concatenate([[True], of[at][1:] != of[at][:-1]])), len(at)) if len(at) else np.zeros(1, np.int64)
    begin = 0
    while begin < len(edges) - 1:
        end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + at_most, side="right")) - 1)
        some = at[edges[begin] : edges[end]]
        if len(some) > at_most and windows > 1:
            half = windows // 2
            for low, high in ((0, half - 1), (half, windows - 1)):
                part = rows[some][:, low : high + span]
                context = _group(_rows_as_values(part[:, high - low : span]))
                found[some] |= seen_before(part, context, least[some], span, at_most) << np.uint32(low)
        else:
            lows, highs = (f.reduceat(least[some], edges[begin:end] - edges[begin]) for f in (np.minimum, np.maximum))
            sizes = np.diff(edges[begin : end + 1])
            source, target = least[some] < np.repeat(highs, sizes), least[some] > np.repeat(lows, sizes)
            if source.any() and target.any():
                index = RunIndex(rows[some[source]], least[some[source]], span)
                found[some[target]] |= index.seen(rows[some[target]], least[some[target]])
        begin = end
    return bits | np.where(docs == docs[first][alike], found[alike], np.uint32(0))


# ------------------------------------------------------------------ parts and buckets


#: What a bucket says of a key: it stands in other documents too, or in very many. Answers to questions have numbers of their own.
REPEATED, EVERYWHERE = 1, 2
KEYS, STRINGS, WINDOWS = 1, 2, 3


@dataclass(frozen=True)
class Questions:
    """Places that ask, the question of each, and of each question its string, hash, bucket and smallest document."""

    kind: int
    places: np.ndarray
    row: np.ndarray
    asked: np.ndarray
    strings: np.ndarray
    hashes: np.ndarray
    bucket: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, kind: int, places: np.ndarray, row: np.ndarray, strings: np.ndarray, hashes: np.ndarray, bucket: np.ndarray, ids: np.ndarray) -> Questions:
        """One question for each different string."""
        _, name = np.unique(_rows_as_values(strings), return_inverse=True)
        order = np.lexsort((ids[row], name, bucket))
        new = np.ones(len(order), bool)
        new[1:] = name[order][1:] != name[order][:-1]
        asked = np.empty(len(order), np.int64)
        asked[order] = np.cumsum(new) - 1
        first = order[new]
        return cls(kind, places, row, asked, strings[first], hashes[first], bucket[first], ids[row[first]])


class Part:
    """A part's documents, and the keys it asks for, by bucket and hash; without buckets, the documents alone."""

    def __init__(self, table: pa.Table, buckets: int, span: int, key: int):
        self.ids = table.column("id").fill_null(0).to_numpy()
        known = table.column("id").is_valid().to_numpy()
        body = pa.concat_arrays(table.column("body").cast(pa.large_binary()).chunks)
        _, off, data = body.buffers()
        off = np.frombuffer(off, np.int64, len(body) + 1, body.offset * 8)
        self.offsets = off - off[0]
        self.data = np.frombuffer(data, np.uint8, int(off[-1] - off[0]), int(off[0])) if data is not None else np.zeros(0, np.uint8)
        self.span, self.key, self.buckets = span, key, buckets
        if not buckets:
            return
        places, hashes = keys_of(self.data, self.offsets, span, key)
        row = np.searchsorted(self.offsets, places, side="right") - 1
        # a document without an id has no smaller one and is no other's
        places, hashes, row = (x[known[row]] for x in (places, hashes, row))
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((row, hashes, bucket))
        self.places, self.hashes, self.row, self.bucket = places[order], hashes[order], row[order], bucket[order]
        new = np.ones(len(order), bool)
        new[1:] = self.hashes[1:] != self.hashes[:-1]
        self.number = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        # documents of each key; a part tells up to 255
        another = new.copy()
        another[1:] |= self.row[1:] != self.row[:-1]
        self.documents = np.bincount(self.number, weights=another, minlength=len(self.first)).clip(0, 255).astype(np.uint8)

    def by_bucket(self, of: np.ndarray) -> Iterator[tuple[int, slice]]:
        """(bucket, places) of ascending bucket numbers."""
        edges = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), len(of)) if len(of) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            yield int(of[a]), slice(int(a), int(b))

    def questions(self, answers: dict[int, bytes]) -> list[Questions]:
        """What the part asks: strings around its repeated keys, and the windows around its common ones.

        Questions are in order of bucket, then string: every pass over a part numbers them alike.
        """
        code = np.zeros(len(self.first), np.uint8)
        for bucket, at in self.by_bucket(self.bucket[self.first]):
            if bucket in answers:
                code[at] = np.frombuffer(answers[bucket], np.uint8)
        code = code[self.number]
        at = np.flatnonzero(code == REPEATED)
        strings = strings_around(self.data, self.offsets, self.places[at], self.span, self.key)
        asked = Questions.of(STRINGS, self.places[at], self.row[at], strings, self.hashes[at], self.bucket[at], self.ids)
        at = np.flatnonzero(code == EVERYWHERE)
        begin = (self.places[at, None] - np.arange(self.span - self.key + 1)).ravel()
        row = np.repeat(self.row[at], self.span - self.key + 1)
        begin = np.unique(begin[(begin >= self.offsets[row]) & (begin + self.span <= self.offsets[row + 1])])
        row = np.searchsorted(self.offsets, begin, side="right") - 1
        windows = np.lib.stride_tricks.sliding_window_view(self.data, self.span)[begin] if len(begin) else np.zeros((0, self.span), np.uint8)
        hashes = _window_hashes(windows)
        return [asked, Questions.of(WINDOWS, begin, row, windows, hashes, (hashes % np.uint64(self.buckets)).astype(np.int64), self.ids)]


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    table = table.filter(pa.compute.equal(table.column("kind"), kind)) if table.num_rows else table
    return dict(zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist()))


ANSWER = "part int, bucket int, kind int, bits binary"
ASKED = "part int, bucket int, hashes binary, documents binary"
QUESTION = "part int, bucket int, kind int, hashes binary, strings binary, docs binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _cut(found: np.ndarray, table: pa.Table, sizes: list[int], kind: int) -> pa.Table:
    """The numbers found for a bucket's rows, dealt back to their parts; rows without any are left out."""
    rows, at = [], 0
    for part, bucket, n in zip(table.column("part").to_pylist(), table.column("bucket").to_pylist(), sizes):
        own = found[at : at + n]
        at += n
        if own.any():
            rows.append((part, bucket, kind, own.tobytes()))
    return _table(ANSWER, rows)


def find_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", span: int = SPAN, key: int = KEY, part_bytes: int = PART_BYTES, common: int = COMMON) -> DataFrame:
    """(id, n_bytes, spans, kept) of every row: byte ranges that repeat a document of a smaller id, and the bytes left.

    A byte is in ``spans`` (array of start, end; end excluded, touching ranges joined) if a
    ``span``-byte string covers it that also starts in a document with a smaller id.
    Strings are judged on the input, whole texts, as UTF-8; null is empty. Rows of one id
    are no smaller than each other; rows without an id neither lose bytes nor cost others
    any. Texts shorter than ``span`` are kept. Other columns stay behind. The bytes 254
    and 255, which UTF-8 hasn't, take part in no window.
    """
    if not 8 <= key <= min(24, span) or span - key > 31:
        raise ValueError("a key has 8 to 24 bytes, and its window 31 more at most")
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("body"))
    total = narrow.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    files = min(parts, MOST_FILES)
    name = f"repeats_{uuid.uuid4().hex}"
    # the number of a row, not its id or text, chooses its part: no hot id or text fills one
    dealt = narrow.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")).repartition(files, "part")
    dealt.write.bucketBy(files, "part").option("path", scratch.path("parts")).option("compression", "zstd").format("parquet").saveAsTable(name)
    # read where they lie: the groups of a part need no shuffle of its texts
    table = spark.table(name)
    grouped = table.groupBy("part")

    def ask(t: pa.Table) -> pa.Table:
        p, part = Part(t, parts, span, key), t.column("part")[0].as_py()
        hashes, buckets = p.hashes[p.first], p.bucket[p.first]
        return _table(ASKED, [(part, b, _pack(hashes[at]), p.documents[at].tobytes()) for b, at in p.by_bucket(buckets)])

    def tell(t: pa.Table) -> pa.Table:
        blocks = [_unpack(b) for b in t.column("hashes").to_pylist()]
        documents = np.frombuffer(b"".join(t.column("documents").to_pylist()), np.uint8)
        _, number = np.unique(np.concatenate(blocks), return_inverse=True)
        count = np.bincount(number, weights=documents)
        code = np.where(count >= common, EVERYWHERE, np.where(count > 1, REPEATED, 0)).astype(np.uint8)
        return _cut(code[number], t, [len(b) for b in blocks], KEYS)

    told = scratch.keep(grouped.applyInArrow(ask, ASKED).groupBy("bucket").applyInArrow(tell, ANSWER), "repeated")

    def inquire(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return _table(QUESTION, [])
        p, part = Part(t, parts, span, key), t.column("part")[0].as_py()
        asked = p.questions(_answers(answers, KEYS))
        return _table(QUESTION, [(part, b, q.kind, _pack(q.hashes[at]), q.strings[at].tobytes(), q.ids[at].astype("<i8").tobytes()) for q in asked for b, at in p.by_bucket(q.bucket)])

    def answer(t: pa.Table) -> pa.Table:
        kind = t.column("kind")[0].as_py()
        docs = t.column("docs").to_pylist()
        sizes = [len(d) // 8 for d in docs]
        ids = np.frombuffer(b"".join(docs), "<i8")
        strings = np.frombuffer(b"".join(t.column("strings").to_pylist()), np.uint8).reshape(len(ids), -1)
        hashes = _unpack(b"".join(t.column("hashes").to_pylist()))
        _, group = np.unique(hashes, return_inverse=True)
        return _cut(seen_before(strings, group, ids, span).astype("<u4"), t, sizes, kind)

    asked = grouped.cogroup(told.groupBy("part")).applyInArrow(inquire, QUESTION)
    answered = scratch.keep(asked.groupBy("bucket", "kind").applyInArrow(answer, ANSWER), "answers")

    def remove(t: pa.Table, answers: pa.Table) -> pa.Table:
        p = Part(t, parts if answers.num_rows else 0, span, key) if t.num_rows else None
        return _removed(p, t, answers)

    both = told.unionByName(answered)
    out = grouped.cogroup(both.groupBy("part")).applyInArrow(remove, "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    spark.sql(f"DROP TABLE {name}")
    return out.withColumnRenamed("id", id_column)


def _removed(p: Part | None, t: pa.Table, answers: pa.Table) -> pa.Table:
    if p is None:
        empty = pa.array([], pa.int64())
        return pa.table({"id": empty, "n_bytes": empty, "spans": pa.array([], pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))), "kept": pa.array([], pa.binary())})
    starts = np.zeros(len(p.data), bool)
    for q in p.questions(_answers(answers, KEYS)) if answers.num_rows else []:
        bits = _answers(answers, q.kind)
        found = np.zeros(len(q.ids), np.uint32)
        for bucket, own in p.by_bucket(q.bucket):
            if bucket in bits:
                found[own] = np.frombuffer(bits[bucket], "<u4")
        # of a part's equal strings, those of the smallest document have asked for all
        windows, back = (1, 0) if q.kind == WINDOWS else (p.span - p.key + 1, p.span - p.key)
        of = np.where(p.ids[q.row] > q.ids[q.asked], np.uint32((1 << windows) - 1), found[q.asked])
        low, high = p.offsets[q.row], p.offsets[q.row + 1]
        for w in range(windows):
            begin = q.places - back + w
            starts[begin[((of >> np.uint32(w)) & np.uint32(1)).astype(bool) & (begin >= low) & (begin + p.span <= high)]] = True
    begin = np.flatnonzero(starts)
    row = np.searchsorted(p.offsets, begin, side="right") - 1
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > begin[:-1] + p.span) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1 if len(begin) else first
    begin, end, row = begin[first], begin[last] + p.span, row[first]
    change = np.zeros(len(p.data) + 1, np.int8)
    change[begin] += 1
    change[end] -= 1
    stays = np.cumsum(change[:-1], dtype=np.int8) == 0
    gone = np.bincount(row, weights=end - begin, minlength=len(p.offsets) - 1).astype(np.int64)
    left = np.concatenate([[0], np.cumsum(np.diff(p.offsets) - gone)])
    spans = pa.StructArray.from_arrays([pa.array(begin - p.offsets[row]), pa.array(end - p.offsets[row])], ["start", "end"])
    edges = np.searchsorted(row, np.arange(len(p.offsets))).astype(np.int32)
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(p.offsets) - 1, [None, pa.py_buffer(left), pa.py_buffer(p.data[stays])])
    return pa.table({"id": t.column("id"), "n_bytes": pa.array(np.diff(p.offsets)), "spans": pa.ListArray.from_arrays(pa.array(edges), spans), "kept": kept.cast(pa.binary())})
