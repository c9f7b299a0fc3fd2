"""Multi-frame xyz text files.

A file is indexed in splits that each find their first frame: a row for each frame with
its byte offset. The index is small, can be kept as a Parquet table, and is what ranges, cuts and seeks are
planned on. Frames are then read by offset in runs of consecutive frames, so one long
file is many tasks, and a frame range reads only its own bytes.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import labels
from ..session import path_exists, ship_package, shared_path, written
from .files import discover, open_binary, stamp, stamps

INDEX_SCHEMA = "source_file string, file_size long, file_mtime double, frame_number long, byte_offset long, atom_count int, comment_line string"
FRAME_SCHEMA = "source_file string, frame_number long, byte_offset long, atom_count int, comment_line string, elements array<string>, coords array<float>"
#: Frames that one read covers at most.
RUN_FRAMES = 4096
#: Bytes of a file that one task indexes.
SPLIT_BYTES = 64 << 20
#: Runs that a task reads, on average, where there are many.
RUNS_OF_TASK = 16


def scan(stream: io.BufferedIOBase, name: str, at: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, int, str, int]]:
    """(number, byte offset, atom count, comment, offset behind it) of every frame from the stream's place on.

    The stream is at byte ``at``, between frames; frames that begin at ``stop`` or later
    are left. Blank lines between frames are skipped, and belong to the frame before.
    """
    number, frame = 0, None
    while True:
        line = stream.readline()
        if line and not line.strip():
            at += len(line)
            continue
        if frame is not None:
            yield *frame, at
        if not line or (stop is not None and at >= stop):
            return
        try:
            atoms = int(line)
        except ValueError:
            raise ValueError(f"{name}: no atom count at byte {at}: {line[:60]!r}") from None
        if atoms < 0:
            raise ValueError(f"{name}: negative atom count at byte {at}")
        comment = stream.readline()
        if not comment:
            raise ValueError(f"{name}: the file ends inside frame {number}")
        rows = list(islice(stream, atoms))
        if len(rows) < atoms:
            raise ValueError(f"{name}: the file ends inside frame {number}")
        frame = (number, at, atoms, comment.decode().rstrip("\r\n"))
        number, at = number + 1, at + len(line) + len(comment) + sum(map(len, rows))


def _is_atom(line: bytes) -> bool:
    fields = line.split()
    try:
        return len(fields) >= 4 and all(map(math.isfinite, map(float, fields[1:4])))
    except ValueError:
        return False


def likely_head(stream: io.BufferedIOBase, start: int, stop: int) -> int:
    """Offset in [start, stop) of what looks like a frame's first line, -1 if nothing does.

    A count, a line, as many atoms, and a count again or the file's end. A comment that is
    a number can look so too: whoever asks checks the answer against the frames before.
    """
    stream.seek(max(0, start - 1))
    at = max(0, start - 1)
    if start:
        at += len(stream.readline())
    while at < stop:
        line = stream.readline()
        if not line:
            return -1
        following = at + len(line)
        if line.strip().isdigit():
            stream.readline()
            rows = list(islice(stream, int(line)))
            behind = next((x for x in stream if x.strip()), b"0")
            if len(rows) == int(line) and all(map(_is_atom, rows)) and behind.strip().isdigit():
                return at
            stream.seek(following)
        at = following
    return -1


def parse_frame(stream: io.BufferedIOBase, name: str, dtype: type = np.float32) -> tuple[int, str, list[str], np.ndarray]:
    """Atom count, comment, elements and (atoms, 3) positions of the frame at the stream's place."""
    line = stream.readline()
    while line and not line.strip():
        line = stream.readline()
    try:
        atoms = int(line)
    except ValueError:
        raise ValueError(f"{name}: no atom count: {line[:60]!r}") from None
    comment = stream.readline().decode().rstrip("\r\n")
    rows = list(islice(stream, atoms))
    fast = _atoms_at_once(rows, atoms)
    if fast is not None:
        return atoms, comment, fast[0], fast[1].astype(dtype)
    elements, positions = [], np.empty((atoms, 3), dtype)
    for i in range(atoms):
        fields = rows[i].split() if i < len(rows) else []
        if len(fields) < 4:
            raise ValueError(f"{name}: atom line {i + 1} has fewer than 4 fields: {fields!r}")
        elements.append(fields[0].decode())
        try:
            positions[i] = [float(f) for f in fields[1:4]]
        except ValueError:
            raise ValueError(f"{name}: atom line {i + 1} has coordinates that are no numbers: {fields!r}") from None
    return atoms, comment, elements, positions


#: Stands between two atoms' fields when all are split at once; no field is one of these.
_MARK = b"\0"


def _atoms_at_once(rows: list[bytes], atoms: int) -> tuple[list[str], np.ndarray] | None:
    """Elements and positions of atom lines that all have as many fields; None if they haven't, or one is no number."""
    if len(rows) < atoms or not atoms:
        return None
    fields = b" \0 ".join(rows).split()
    width = (len(fields) + 1) // atoms
    if width < 5 or width * atoms != len(fields) + 1 or fields[width - 1 :: width].count(_MARK) != atoms - 1:
        return None
    positions = np.empty((atoms, 3))
    try:
        for k in range(3):
            positions[:, k] = list(map(float, fields[k + 1 :: width]))
    except ValueError:
        return None
    return _decoded(b" ".join(fields[::width])), positions


@lru_cache(maxsize=256)
def _decoded(elements: bytes) -> list[str]:
    """Names of a structure's elements; structures of a file mostly have the same, so they share the list."""
    return elements.decode().split(" ")


_PARTS = f"{INDEX_SCHEMA}, split long, place long, behind long"


def _scan_splits(spark: SparkSession, splits: DataFrame, guess: bool) -> DataFrame:
    """Index rows of the frames that begin in splits (source_file, size, mtime, split, start, stop), numbered in their split.

    With ``guess`` a split's first frame is looked for, but for a file's first split; one
    that can't be read from there has a row at byte -1, so that it is read again. Else a
    split begins at ``start``, and what can't be read is an error.
    """
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, mtime, split, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[tuple] = []
                try:
                    with open_binary(path) as raw:
                        stream = io.BufferedReader(raw, 1 << 20)
                        head = likely_head(stream, start, stop) if guess and start else start
                        if head >= 0:
                            stream.seek(head)
                            for row in scan(stream, path, head, stop):
                                rows.append(row)
                                if len(rows) == 10_000:
                                    yield _index_batch(path, size, mtime, split, rows)
                                    rows = []
                except ValueError:
                    if not guess or not start:
                        raise
                    rows = [(0, -1, 0, "", 0)]
                yield _index_batch(path, size, mtime, split, rows)

    spread = splits.select("source_file", "size", "mtime", "split", "start", "stop").repartition(max(1, splits.count()), "source_file", "split")
    return spread.mapInArrow(run, _PARTS)


def index_files(spark: SparkSession, files: Sequence[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Index of all frames of the files; a task reads ``split_bytes`` of one, and the frame that begins last in them.

    Every split looks for its first frame itself. Then the splits are held against each
    other: a split is right if its first frame begins where the frames before it end.
    The splits that aren't, be it that a comment looked like a frame, are read again from
    there, until all are right; so the result is that of one pass from the first byte.
    """
    wide = stamps(spark, files).select("source_file", "size", "mtime", F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes))).alias("split", "start"))
    splits = written(wide.select("source_file", "size", "mtime", F.col("split").cast("long").alias("split"), F.col("start").cast("long").alias("start"), (F.col("start") + split_bytes).cast("long").alias("stop"), F.when(F.col("split") == 0, F.lit(0)).cast("long").alias("read_from")), "splits")
    found = written(_scan_splits(spark, splits, True), "index")
    before = Window.partitionBy("source_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        heads = found.groupBy("source_file", "split").agg(F.min("byte_offset").alias("head"), F.max("behind").alias("behind"), F.count(F.lit(1)).alias("frames"))
        every = splits.join(heads, ["source_file", "split"], "left")
        # where a split's first frame begins, if those before are right; it may lie behind the split
        due = every.withColumn("due", F.coalesce(F.max("behind").over(before), F.lit(0))).withColumn("first_number", F.coalesce(F.sum("frames").over(before), F.lit(0)))
        # one that was read from where it is due has what there is, be it nothing
        unread = ~F.col("read_from").eqNullSafe(F.col("due"))
        wrong = unread & F.when(F.col("head").isNull(), F.col("due") < F.least("stop", "size")).otherwise(F.col("head") != F.col("due"))
        checked = written(due.withColumn("wrong", wrong), "splits")
        # the first split that is wrong is read from where it is due; those behind it are judged again
        again = checked.where("wrong").withColumn("n", F.row_number().over(Window.partitionBy("source_file").orderBy("split"))).where("n = 1").withColumn("start", F.col("due"))
        if again.isEmpty():
            numbered = found.join(checked.select("source_file", "split", "first_number"), ["source_file", "split"])
            return numbered.withColumn("frame_number", F.col("first_number") + F.col("place")).select(*[f.split()[0] for f in INDEX_SCHEMA.split(", ")])
        anew = _scan_splits(spark, again, False)
        now = again.select("source_file", "split", F.col("due").alias("now"))
        splits = written(checked.join(now, ["source_file", "split"], "left").withColumn("read_from", F.coalesce("now", "read_from")).select(*splits.columns), "splits")
        found = written(found.join(again.select("source_file", "split"), ["source_file", "split"], "left_anti").select(*anew.columns).unionByName(anew), "index")


def _index_batch(path: str, size: int, mtime: float, split: int, rows: list[tuple]) -> pa.RecordBatch:
    place, offset, atoms, comment, behind = zip(*rows) if rows else [()] * 5
    n = len(rows)
    same = [pa.array([v] * n, t) for v, t in ((path, pa.string()), (size, pa.int64()), (mtime, pa.float64()))]
    places = pa.array(place, pa.int64())
    return pa.record_batch([*same, places, pa.array(offset, pa.int64()), pa.array(atoms, pa.int32()), pa.array(comment, pa.string()), pa.array([split] * n, pa.int64()), places, pa.array(behind, pa.int64())], names=[c.split()[0] for c in _PARTS.split(", ")])


def cached_index(spark: SparkSession, files: Sequence[str], folder: str) -> DataFrame:
    """Index of the files from a Parquet sidecar table; only new or changed files are scanned.

    A kept file is one of the same path, size and time of change (to a millisecond).
    """
    folder = shared_path(spark, folder)
    now = stamps(spark, files).drop("place")
    same = (F.col("size") == F.col("file_size")) & (F.abs(F.col("mtime") - F.col("file_mtime")) < 1e-3)
    kept = spark.read.schema(INDEX_SCHEMA).parquet(folder) if path_exists(spark, folder) else None
    if kept is None:
        stale = list(files)
    else:
        known = kept.select("source_file", "file_size", "file_mtime").distinct()
        try:
            stale = [r[0] for r in now.join(known, (known["source_file"] == now["source_file"]) & same, "left_anti").select("source_file").collect()]
        except Exception as e:  # noqa: BLE001  a table that can't be read: scan all
            if "FAILED_READ_FILE" not in str(e) and "CANNOT_READ_FILE" not in str(e):
                raise
            kept, stale = None, list(files)
    if stale:
        index_files(spark, stale).write.mode("append" if kept is not None else "overwrite").parquet(folder)
    spark.catalog.refreshByPath(folder)
    table = spark.read.schema(INDEX_SCHEMA).parquet(folder)
    return table.join(now, "source_file").where(same).drop("size", "mtime")


def read_frames(index: DataFrame, run_frames: int = RUN_FRAMES, uniform: bool = True, with_elements: bool = True) -> DataFrame:
    """Frames of index rows (source_file, frame_number, byte_offset), read by offset.

    Rows are dealt in runs of neighbouring frames; in a run, frames are read in file
    order. With ``uniform`` frames of a file must have one atom count. Elements are a
    column only if they are asked for.
    """
    ship_package(index.sparkSession)
    run_of = F.floor(F.col("frame_number") / run_frames)
    # index rows are small, frames are not: the number of tasks follows the frames, and is given, so that small partitions aren't put together
    least = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = math.ceil(index.count() / run_frames)
    tasks = max(1, min(runs, max(least, math.ceil(runs / RUNS_OF_TASK))))
    dealt = index.select("source_file", "frame_number", "byte_offset").repartition(tasks, F.col("source_file"), run_of).sortWithinPartitions("source_file", "byte_offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream, expected = None, None, None
        for batch in batches:
            rows: list[tuple] = []
            for name, number, offset in zip(*(c.to_pylist() for c in batch.columns)):
                if name != path:
                    if stream is not None:
                        stream.close()
                    path, stream, expected = name, io.BufferedReader(open_binary(name), 1 << 20), None
                if stream.tell() != offset:
                    stream.seek(offset)
                atoms, comment, elements, positions = parse_frame(stream, name)
                if uniform and expected not in (None, atoms):
                    raise ValueError(f"{name}: frame {number} has {atoms} atoms, others {expected}")
                expected = atoms
                rows.append((name, number, offset, atoms, comment, elements, positions.ravel()))
                if len(rows) == 1000:
                    yield _frame_batch(rows, with_elements)
                    rows = []
            yield _frame_batch(rows, with_elements)
        if stream is not None:
            stream.close()

    return dealt.mapInArrow(run, FRAME_SCHEMA if with_elements else FRAME_SCHEMA.replace("elements array<string>, ", ""))


def _frame_batch(rows: list[tuple], with_elements: bool = True) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 7
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in columns[6]])]).astype(np.int32)
    flat = np.concatenate(columns[6]).astype(np.float32) if rows else np.zeros(0, np.float32)
    arrays = [pa.array(c, t) for c, t in zip(columns, types)]
    if with_elements:
        arrays.append(_element_lists(columns[5]))
    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
    return pa.record_batch(arrays, names=_frame_names(with_elements))


def _frame_names(with_elements: bool) -> list[str]:
    return [n for n in (c.split()[0] for c in FRAME_SCHEMA.split(", ")) if with_elements or n != "elements"]


def _element_lists(lists: Sequence[list[str]]) -> pa.Array:
    """Element lists as one array; neighbours that share a list share its place."""
    if lists and all(e is lists[0] for e in lists):
        n = len(lists[0])
        flat = pa.array(lists[0], pa.string()).take(pa.array(np.tile(np.arange(n), len(lists))))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * n), flat)
    return pa.array(lists, pa.list_(pa.string()))


def frame(index: DataFrame, source_file: str, number: int) -> tuple[int, str, list[str], np.ndarray]:
    """One frame by its number, double precision, read on the driver; an error if out of range."""
    row = index.where((F.col("source_file") == source_file) & (F.col("frame_number") == number)).select("byte_offset").first()
    if row is None:
        raise IndexError(f"{source_file} has no frame {number}")
    return frame_at(source_file, row[0])


def frame_at(source_file: str, offset: int) -> tuple[int, str, list[str], np.ndarray]:
    """One frame by its byte offset, double precision."""
    with open_binary(source_file) as raw:
        raw.seek(offset)
        return parse_frame(io.BufferedReader(raw), source_file, np.float64)


def metadata(index: DataFrame) -> DataFrame:
    """Index rows with what their comment lines tell."""
    c = F.col("comment_line")
    return index.withColumn("step_number", labels.comment_step(c)).withColumn("bead_comment", labels.comment_bead(c)).withColumn("energy", F.lit(None).cast("float"))


class _FilePartition(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = discover(options["path"])
        self.start, self.end = int(options.get("start_frame", 0)), options.get("end_frame")

    def partitions(self) -> list[InputPartition]:
        return [_FilePartition(f, self.start, None if self.end is None else int(self.end)) for f in self.files]

    def read(self, partition: _FilePartition) -> Iterator[pa.RecordBatch]:
        with open_binary(partition.path) as raw, open_binary(partition.path) as seeker:
            frames, rows = io.BufferedReader(seeker, 1 << 20), []
            for number, offset, *_ in scan(io.BufferedReader(raw, 1 << 20), partition.path):
                if partition.end is not None and number > partition.end:
                    break
                if number < partition.start:
                    continue
                if frames.tell() != offset:
                    frames.seek(offset)
                atoms, comment, elements, positions = parse_frame(frames, partition.path)
                rows.append((partition.path, number, offset, atoms, comment, elements, positions.ravel()))
                if len(rows) == 1000:
                    yield _frame_batch(rows)
                    rows = []
            yield _frame_batch(rows)


class XyzDataSource(DataSource):
    """``spark.read.format("xyz")``: frames of the files a pattern matches, a partition for each file.

    Options start_frame and end_frame (both included) restrict every file's frames.
    """

    @classmethod
    def name(cls) -> str:
        return "xyz"

    def schema(self) -> str:
        return FRAME_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format "xyz" known to the session."""
    ship_package(spark)
    spark.dataSource.register(XyzDataSource)
