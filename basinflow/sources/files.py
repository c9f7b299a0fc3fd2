"""Finding and opening input files, on local disks or any store Arrow reaches."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Suffixes that mark a file of a format; other files count only if no file has one.
SUFFIXES = {"xyz": (".xyz",), "hdf5": (".h5", ".hdf5")}
#: Suffixes of sidecar files, never input.
SIDECARS = (".frameindex.npz",)
_WILD = re.compile(r"[*?\[]")


def _local(pattern: str) -> set[str]:
    return {os.path.realpath(p) for p in glob.glob(os.path.expanduser(pattern), recursive=True) if os.path.isfile(p)}


def _stored(pattern: str) -> set[str]:
    """URIs of a store that match a pattern; the folder before its first wildcard is listed, in one recursive call."""
    from pyarrow import fs

    scheme, _, rest = pattern.partition("://")
    wild = _WILD.search(rest)
    cut = rest.rfind("/", 0, wild.start() if wild else len(rest))
    base, tail = rest[:cut], rest[cut + 1 :]
    system, root = fs.FileSystem.from_uri(f"{scheme}://{base or '/'}")
    matches = re.compile(glob.translate(tail, recursive=True, include_hidden=False, seps="/")).match
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    relative = [i.path[len(root) :].lstrip("/") for i in found if i.type == fs.FileType.File]
    return {f"{scheme}://{base}/{p}" for p in relative if matches(p)}


def discover(pattern: str, kind: str = "xyz") -> list[str]:
    """Files of a recursive pattern, sorted and each once; an error if there are none.

    A pattern with a scheme (``s3://bucket/runs/**/*.xyz``) is listed in its store and
    gives URIs; any other is local and gives resolved paths.
    """
    if kind not in SUFFIXES:
        raise ValueError(f"unknown format {kind!r}; one of {', '.join(SUFFIXES)}")
    found = sorted(_stored(pattern) if "://" in pattern else _local(pattern))
    found = [p for p in found if not p.endswith(SIDECARS)]
    typed = [p for p in found if p.lower().endswith(SUFFIXES[kind])]
    if not (typed or found):
        raise FileNotFoundError(f"no files match {pattern!r}")
    return typed or found


def open_binary(path: str) -> BinaryIO:
    """A seekable reader of a path or URI."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def stamp(path: str) -> tuple[int, float]:
    """Size and time of last change."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return int(info.size), info.mtime.timestamp() if info.mtime else 0.0


def stamps(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(place, source_file, size, mtime) of the files, in their order; executors ask the store."""
    from ..session import ship_package

    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, mtime = zip(*map(stamp, batch.column(1).to_pylist())) if batch.num_rows else ((), ())
            yield pa.record_batch([*batch.columns, pa.array(size, pa.int64()), pa.array(mtime, pa.float64())], names=["place", "source_file", "size", "mtime"])

    names = spark.createDataFrame(list(enumerate(files)), "place long, source_file string")
    return names.mapInArrow(run, "place long, source_file string, size long, mtime double")
