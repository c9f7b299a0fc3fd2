"""Transition counts of frames that arrive as a stream.

An extension of the batch operator for running simulations: frames of a group arrive in
order, possibly over many micro-batches, and each group keeps its last states as state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import is_state
from ..session import ship_package


def streamed_pairs(frames: DataFrame, state: str, order: str, group: Sequence[str], *, lag: int = 1) -> DataFrame:
    """(group..., src, dst) of a stream, noise bridged, as the pairs become known.

    A group's frames must arrive in order between micro-batches; inside one they are
    sorted. The state of a group is its last ``lag`` labels, so it doesn't grow with the
    stream.
    """
    if lag < 1:
        raise ValueError(f"lag must be at least 1; got {lag}")
    ship_package(frames.sparkSession)
    rows = frames.select(*group, F.col(state).cast("string").alias("_s"), F.col(order).cast("long").alias("_o")).where(is_state(F.col("_s")))
    out = T.StructType([*[rows.schema[g] for g in group], T.StructField("src", T.StringType()), T.StructField("dst", T.StringType())])
    kept = T.StructType([T.StructField("last", T.ArrayType(T.StringType()))])

    def step(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(parts)).sort_values("_o", kind="stable")["_s"].tolist()
        labels = (list(held.get[0]) if held.exists else []) + new
        held.update((labels[-lag:],))
        pairs = list(zip(labels, labels[lag:]))
        yield pd.DataFrame([(*key, a, b) for a, b in pairs], columns=[f.name for f in out])

    return rows.groupBy(*group).applyInPandasWithState(step, out, kept, "append", "NoTimeout")
