"""Edge-exact bins as Column expressions.

A value on an interior edge belongs to the upper bin, one on the last edge to the last
bin. Equal-width arithmetic alone misplaces values next to an edge, so the guess is
corrected by the edges themselves, which are literals computed once on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_edges(low: float, high: float, bins: int) -> list[float]:
    """bins + 1 equally spaced edges."""
    if bins < 1:
        raise ValueError(f"bins must be at least 1; got {bins}")
    if not high > low:
        raise ValueError(f"the range must have high > low; got {low}, {high}")
    return np.linspace(low, high, bins + 1).tolist()


def stepped_edges(low: float, high: float, step: float) -> list[float]:
    """Edges a step apart from low on until they cover high; the last may lie beyond it."""
    if not step > 0:
        raise ValueError(f"the step must be positive; got {step}")
    return np.arange(low, high + step, step).tolist()


def missing(value: Column) -> Column:
    """Null or NaN."""
    return value.isNull() | F.isnan(value)


def finite(value: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def on_range(value: Column, edges: Sequence[float]) -> Column:
    """Whether a double value is within the edges' range: neither null nor NaN, which sorts above all."""
    return (value >= F.lit(float(edges[0]))) & (value <= F.lit(float(edges[-1])))


def inner_index(value: Column, edges: Sequence[float]) -> Column:
    """0-based bin of a double value that is known to be within the edges' range."""
    n = len(edges) - 1
    low, high, width = edges[0], edges[-1], (edges[-1] - edges[0]) / n
    table = F.array(*[F.lit(float(e)) for e in edges])
    v = value
    guess = F.least(F.greatest(F.floor((v - F.lit(low)) / F.lit(width)).cast("int"), F.lit(0)), F.lit(n - 1))
    at = lambda i: F.get(table, i)
    return F.when(v < at(guess), guess - 1).when((guess < n - 1) & (v >= at(guess + 1)), guess + 1).otherwise(guess)


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """0-based bin of a double value; -1 off the edges' range or missing."""
    v = value.cast("double")
    return F.when(on_range(v, edges), inner_index(v, edges)).otherwise(F.lit(-1))


def clipped_index(value: Column, edges: Sequence[float]) -> Column:
    """Bin of a value, values off the range in the nearest edge bin; null if missing."""
    n = len(edges) - 1
    v = value.cast("double")
    inner = bin_index(v, edges)
    return F.when(missing(v), F.lit(None).cast("int")).when(v < F.lit(edges[0]), 0).when(v > F.lit(edges[-1]), n - 1).otherwise(inner)


def bin_centre(index: Column, edges: Sequence[float]) -> Column:
    """Centre of a bin."""
    centres = F.array(*[F.lit((a + b) / 2) for a, b in zip(edges, edges[1:])])
    return F.get(centres, index)
