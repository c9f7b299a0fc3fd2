"""Identifiers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOISE = "noise"


def _number(text: Column) -> Column:
    return F.when(text != "", text.cast("long"))


def comment_step(comment: Column) -> Column:
    """Step number in a frame's comment line, null if it has none."""
    return _number(F.regexp_extract(comment, r"Step:\s+(\d+)", 1))


def comment_bead(comment: Column) -> Column:
    """Bead number in a frame's comment line, null if it has none."""
    return _number(F.regexp_extract(comment, r"Bead:\s+(\d+)", 1))


def file_stem(path: Column) -> Column:
    """File name without folders and without its last suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def parent_folder(path: Column) -> Column:
    """Name of the folder that holds the file."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2))


def id_from_stem(path: Column, pattern: str) -> Column:
    """Group 1 of a pattern found in the file stem; an error where it is not found or empty."""
    found = F.regexp_extract(file_stem(path), pattern, 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no id in file name: "), path)).cast("string"))


def trajectory_id(path: Column, pattern: str | None = None) -> Column:
    """Group 1 of the pattern in the stem, without a pattern the parent folder's name."""
    return parent_folder(path) if pattern is None else id_from_stem(path, pattern)


def bead_id(path: Column, pattern: str | None = None) -> Column:
    """Group 1 of the pattern in the stem, null without a pattern."""
    return F.lit(None).cast("string") if pattern is None else id_from_stem(path, pattern)


def natural_order(label: Column) -> list[Column]:
    """Sort keys: numeric labels by value before texts, texts by themselves."""
    digits = label.rlike("^[0-9]+$")
    return [F.when(digits, 0).otherwise(1).asc(), F.when(digits, label.cast("decimal(38,0)")).asc(), F.when(~digits, label).asc()]


def is_state(label: Column) -> Column:
    """A label that is set and not noise."""
    return label.isNotNull() & (label != NOISE)
