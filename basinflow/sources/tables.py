"""Ready-made coordinate tables: CSV, Parquet and NPZ."""

from __future__ import annotations

import json
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.table import CORE, OPTIONAL, validated


def _suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name[name.rfind(".") :].lower() if "." in name else ""


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A coordinate table by its path's suffix, validated.

    CSV is read as text and cast: inferred types would turn bead "00" into 0.
    """
    kind = _suffix(path)
    if kind == ".csv":
        frames = spark.read.option("header", True).csv(path)
        # CSV can't tell an empty text from none; a frame's comment is never none
        if "comment_line" in frames.columns:
            frames = frames.withColumn("comment_line", F.coalesce("comment_line", F.lit("")))
        known = {f.name for f in CORE} | set(OPTIONAL)
        numbers = [c for c in frames.columns if c not in known and not c.startswith("state_")]
        return validated(frames, numbers)
    if kind == ".parquet":
        return validated(spark.read.parquet(path))
    if kind == ".npz":
        return validated(read_npz(spark, path)[0])
    raise ValueError(f"a coordinate table is .csv, .parquet or .npz; got {path!r}")


def write_table(frames: DataFrame, path: str, metadata: Mapping | None = None) -> None:
    """Writes a coordinate table by its path's suffix; only NPZ takes metadata."""
    kind = _suffix(path)
    if metadata is not None and kind != ".npz":
        raise ValueError("only NPZ tables hold metadata")
    if kind == ".csv":
        frames.write.mode("overwrite").option("header", True).csv(path)
    elif kind == ".parquet":
        frames.write.mode("overwrite").parquet(path)
    elif kind == ".npz":
        write_npz(frames, path, metadata)
    else:
        raise ValueError(f"a coordinate table is .csv, .parquet or .npz; got {path!r}")


def write_npz(frames: DataFrame, path: str, metadata: Mapping | None = None) -> None:
    """One compressed archive of columns, for exchange of small tables: rows pass through the driver.

    Texts are codes into their sorted values, -1 for null; integers and booleans have a
    mask of nulls.
    """
    pdf = frames.toPandas()
    arrays: dict[str, np.ndarray] = {"__columns__": np.array(frames.columns), "__types__": np.array([f.dataType.simpleString() for f in frames.schema])}
    for f in frames.schema:
        col = pdf[f.name]
        if isinstance(f.dataType, T.StringType):
            values = np.array(sorted({str(v) for v in col.dropna()}), dtype=str)
            arrays[f"{f.name}.values"] = values
            arrays[f.name] = np.array([-1 if pd.isna(v) else np.searchsorted(values, str(v)) for v in col], np.int32)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            arrays[f.name] = col.to_numpy(np.float32 if isinstance(f.dataType, T.FloatType) else float, na_value=np.nan)
        else:
            null = col.isna().to_numpy()
            arrays[f"{f.name}.null"] = null
            arrays[f.name] = np.array([0 if n else v for v, n in zip(col, null)], bool if isinstance(f.dataType, T.BooleanType) else np.int64)
    if metadata is not None:
        arrays["__metadata__"] = np.array(json.dumps(dict(metadata), sort_keys=True))
    with open(path, "wb") as out:
        np.savez_compressed(out, **arrays)


def read_npz(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The archive's table and metadata."""
    with np.load(path, allow_pickle=False) as z:
        names, kinds = z["__columns__"].tolist(), z["__types__"].tolist()
        columns = []
        for name, kind in zip(names, kinds):
            a = z[name]
            if kind == "string":
                values = z[f"{name}.values"].tolist()
                columns.append([None if i < 0 else values[i] for i in a.tolist()])
            elif kind in ("float", "double"):
                columns.append([None if v != v else v for v in a.astype(float).tolist()])
            else:
                columns.append([None if n else v for v, n in zip(a.tolist(), z[f"{name}.null"].tolist())])
        meta = json.loads(str(z["__metadata__"])) if "__metadata__" in z else {}
    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    rows = list(zip(*columns))
    return spark.createDataFrame(rows, schema), meta


def coordinate_columns(frames: DataFrame) -> list[str]:
    """Names of the value columns of a table: neither core, optional nor state columns."""
    known = {f.name for f in CORE} | set(OPTIONAL)
    return [c for c in frames.columns if c not in known and not c.startswith("state_")]
