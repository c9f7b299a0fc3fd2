"""Null-safe keys for grouped operators: a null key is a group of its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_group(left: DataFrame, right: DataFrame, group: Sequence[str]) -> Column:
    """Join condition that treats null keys as equal."""
    out = F.lit(True)
    for c in group:
        out = out & left[c].eqNullSafe(right[c])
    return out


def join_groups(left: DataFrame, right: DataFrame, group: Sequence[str], others: Sequence[str] = (), how: str = "inner", small: bool = False) -> DataFrame:
    """left joined with right on null-safe group keys and plain other keys, keys once.

    ``small`` marks a right side whose size the operator has bounded.
    """
    marked = right.select(*[right[c].alias(f"_r_{c}") for c in (*group, *others)], *[c for c in right.columns if c not in (*group, *others)])
    cond = F.lit(True)
    for c in group:
        cond = cond & left[c].eqNullSafe(marked[f"_r_{c}"])
    for c in others:
        cond = cond & (left[c] == marked[f"_r_{c}"])
    return left.join(F.broadcast(marked) if small else marked, cond, how).drop(*[f"_r_{c}" for c in (*group, *others)])
