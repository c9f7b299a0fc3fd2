"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_by_class(rows: DataFrame, label: str, key: str, most: int, seed: int = 7) -> DataFrame:
    """About ``most`` rows of each value of label at most, chosen by a hash of key.

    Counts come first, one small aggregate; a class within the bound is kept whole.
    The choice depends on key alone, so a repeated run takes the same rows.
    """
    counts = rows.groupBy(label).count().collect()
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for value, n in counts:
        if value is not None:
            keep = keep | ((F.col(label) == F.lit(value)) & (draw < min(1.0, most / n)))
    return rows.where(keep)
