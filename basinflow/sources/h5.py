"""HDF5 runs: bead positions, centroid positions and potential by frame.

h5py is imported where it is used, so the rest works without it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .xyz import frame_at

#: Byte offset of frames that are not text.
NO_OFFSET = -1
#: Bytes of positions that one read covers, about.
BLOCK_BYTES = 64 << 20

SCHEMA = "source_file string, trajectory_id string, bead_id string, frame_number long, byte_offset long, atom_count int, elements array<string>, coords array<float>, energy float, step_number long"


def _h5py():
    try:
        import h5py
    except ImportError:
        raise ImportError("reading HDF5 runs needs h5py") from None
    return h5py


def bead_label(index: int) -> str:
    """Id of a bead."""
    return f"bead_{index:02d}"


def bead_index(label: str) -> int:
    """Place of a bead in the file."""
    if not label.startswith("bead_") or not label[5:].isdigit():
        raise ValueError(f"no bead id: {label!r}")
    return int(label[5:])


def run_folder(path: str) -> str:
    """Simulation folder of ``<run>/hdf5/<file>``."""
    return os.path.dirname(os.path.dirname(path))


def elements_of(path: str) -> list[str]:
    """Elements, from the run's input structure."""
    return frame_at(os.path.join(run_folder(path), "input.xyz"), 0)[2]


def read_runs(spark: SparkSession, files: Sequence[str], source: str = "bead", start: int = 0, end: int | None = None) -> DataFrame:
    """Frames of the runs, beads one after the other or the centroid alone, in tasks of a bounded block."""
    if source not in ("bead", "centroid"):
        raise ValueError(f"positions come from bead or centroid; got {source!r}")
    ship_package(spark)
    h5py = _h5py()
    parts: list[tuple[str, int | None, int, int]] = []
    for path in files:
        with h5py.File(path, "r") as f:
            data = f["bead_positions"] if source == "bead" else f["positions"]
            frames, atoms = data.shape[0], data.shape[-2]
            beads = range(data.shape[1]) if source == "bead" else [None]
        stop = frames if end is None else min(frames, end + 1)
        step = max(1, BLOCK_BYTES // (atoms * 24))
        parts += [(path, b, a, min(a + step, stop)) for b in beads for a in range(start, stop, step)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h5 = _h5py()
        for batch in batches:
            for path, bead, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                elements = elements_of(path)
                with h5.File(path, "r") as f:
                    x = np.asarray(f["bead_positions"][a:b, bead] if bead is not None else f["positions"][a:b], np.float32)
                    energy = np.asarray(f["potential"][a:b], np.float32) if "potential" in f else np.full(b - a, np.nan, np.float32)
                if len(elements) != x.shape[1]:
                    raise ValueError(f"{path}: {x.shape[1]} atoms, its input structure has {len(elements)}")
                n = b - a
                number = pa.array(np.arange(a, b), pa.int64())
                yield pa.record_batch(
                    [
                        pa.array([path] * n, pa.string()), pa.array([os.path.basename(run_folder(path))] * n, pa.string()), pa.array([None if bead is None else bead_label(bead)] * n, pa.string()), number,
                        pa.array([NO_OFFSET] * n, pa.int64()), pa.array([x.shape[1]] * n, pa.int32()), pa.array([elements] * n, pa.list_(pa.string())), pa.array(list(x.reshape(n, -1)), pa.list_(pa.float32())), pa.array(energy), number,
                    ],
                    names=[c.split()[0] for c in SCHEMA.split(", ")],
                )

    plan = spark.createDataFrame(parts, "path string, bead int, a long, b long").repartition(max(1, len(parts)), "path", "bead", "a")
    return plan.mapInArrow(run, SCHEMA)


FRAMES = "source_file string, frame_number long, bead_id string, elements array<string>, coords array<double>"


def read_frames(rows: DataFrame) -> DataFrame:
    """Structures of (source_file, frame_number, bead_id, atom_count) rows in double precision, a file's rows in one task.

    A null bead is the centroid. A frame that can't be read, or with another number of
    atoms than its row says, is an error that names it.
    """
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, elements, coords = batch.select(["source_file", "frame_number", "bead_id"]), [], []
            for path, number, bead, atoms in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    e, x = frame(path, number, bead)
                except (OSError, KeyError, IndexError, ValueError) as why:
                    raise ValueError(f"{path}, frame {number}, {bead or 'centroid'}: {why}") from why
                if atoms is not None and len(x) != atoms or len(e) != len(x):
                    raise ValueError(f"{path}, frame {number}, {bead or 'centroid'}: {len(x)} atoms, {atoms} in the table, {len(e)} elements")
                elements.append(e)
                coords.append(x.reshape(-1))
            yield pa.record_batch([*keys.columns, pa.array(elements, pa.list_(pa.string())), pa.array(coords, pa.list_(pa.float64()))], names=[c.split()[0] for c in FRAMES.split(", ")])

    asked = rows.select("source_file", F.col("frame_number").cast("long").alias("frame_number"), "bead_id", F.col("atom_count").cast("long").alias("atom_count"))
    return asked.repartition("source_file").sortWithinPartitions("source_file", "frame_number").mapInArrow(run, FRAMES)


def frame(path: str, number: int, bead: str | None) -> tuple[list[str], np.ndarray]:
    """Elements and double-precision positions of one frame, of a bead or the centroid."""
    with _h5py().File(path, "r") as f:
        data = f["positions"] if bead is None else f["bead_positions"]
        if not 0 <= number < data.shape[0]:
            raise IndexError(f"{path} has no frame {number}")
        x = data[number] if bead is None else data[number, bead_index(bead)]
        return elements_of(path), np.asarray(x, float)
