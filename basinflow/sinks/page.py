"""Standalone page of a population map: no server, no network, the same bytes for the same data."""

from __future__ import annotations

import html
import os
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np

from ..functions import binning, energy
from ..operators import bonds
from . import palette, payload
from .template import PAGE


def navigation(pages: Sequence[tuple[str, str, str]], current: str) -> list[dict[str, Any]]:
    """Links between sibling pages (name, title, file); names unique, files plain names, the current one among them."""
    names = [n for n, _, _ in pages]
    if len(set(names)) != len(names):
        raise ValueError("page names must be unique")
    if current not in names:
        raise ValueError(f"the pages lack the current one, {current!r}")
    for _, _, f in pages:
        if os.path.basename(f) != f or not f:
            raise ValueError(f"a page's file must be a plain name; got {f!r}")
    return [{"name": n, "title": t, "file": f, "current": n == current} for n, t, f in pages]


def private_path(path: str, base: str) -> str:
    """A path relative to a folder it lies in, else the file's name alone."""
    rel = os.path.relpath(path, base)
    return os.path.basename(path) if rel.startswith("..") or os.path.isabs(rel) else rel


def pin_columns(records: Sequence[Mapping[str, Any]], labels: tuple[str, str]) -> list[dict[str, str]]:
    """Columns of pinned frames: the records' fields but their bins, if any record has a value; axes by their labels."""
    names = {"x": labels[0], "y": labels[1], "raw_x": f"{labels[0]} (unshifted)", "raw_y": f"{labels[1]} (unshifted)"}
    fields = [k for k in (records[0] if records else {}) if k not in ("xi", "yi")]
    return [{"key": k, "label": names.get(k, k.replace("_", " "))} for k in fields if any(r[k] is not None for r in records)]


def page_data(
    counts: np.ndarray, x_range: tuple[float, float], y_range: tuple[float, float], title: str, labels: tuple[str, str], *,
    frames: Sequence[Mapping[str, Any]] = (), structures: Mapping[str, Any] | None = None, xyz: Mapping[str, str] | None = None, states: Mapping[str, Any] | None = None,
    pages: Sequence[Mapping[str, Any]] | None = None, mode: str = "log", temperature: float | None = None, most_pins: int = 15,
    periodic: bool = False, axis_atoms: Mapping[str, Sequence[int]] | None = None, reference: str | None = None,
) -> dict[str, Any]:
    """What a page shows, ready for JSON.

    ``frames`` are records with xi, yi, x and y of each occupied bin's representative;
    ``structures`` is their packed block, or ``xyz`` their texts where elements differ.
    ``reference`` names the structure that the others are laid on.
    """
    if mode not in ("log", "count", "energy"):
        raise ValueError(f"unknown scale mode {mode!r}")
    units = [{"key": "kT", "k": None}, *({"key": u, "k": k} for u, k in energy.BOLTZMANN.items())]
    background = palette.WHITE
    colours = palette.categories(len(states["labels"]) if states else 1)
    return {
        "version": 2, "title": title, "labels": {"x": labels[0], "y": labels[1]}, "periodic": periodic,
        "grid": {"nx": counts.shape[0], "ny": counts.shape[1], "xe": binning.linear_edges(*x_range, counts.shape[0]), "ye": binning.linear_edges(*y_range, counts.shape[1])},
        "ticks": {"x": palette.ticks(*x_range, periodic), "y": palette.ticks(*y_range, periodic)},
        "colours": {"scale": palette.trimmed(palette.SCALE, background), "states": [{"fill": palette.css(c), "text": palette.css(palette.legible(c))} for c in colours]},
        "counts": payload.encode_grid(counts), "units": units, "frames": payload.encode_columns(frames) if frames else None, "columns": pin_columns(frames, labels),
        "structures": structures, "xyz": xyz, "reference": reference, "states": states, "pages": list(pages or []),
        "axis_atoms": {k: list(v) for k, v in (axis_atoms or {}).items()}, "radii": bonds.COVALENT_RADII | {"": bonds.OTHER_RADIUS, "tolerance": bonds.BOND_TOLERANCE},
        "settings": {"mode": mode, "temperature": temperature, "most_pins": most_pins},
    }


def render(data: Mapping[str, Any]) -> str:
    """The page's text; data can't close its script element."""
    return PAGE.replace("@TITLE@", html.escape(str(data["title"]))).replace("@DATA@", payload.canonical(data).replace("<", "\\u003c"))


def write(path: str, data: Mapping[str, Any]) -> None:
    """Writes the page."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(render(data))
