"""Pictures and pages of a run, from aggregates small enough for the driver."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import binning
from ..operators import density, overlay, structures
from ..sinks import page, payload, png
from ..sources import h5, xyz
from .config import Pair, Run, clustering_of


def edges_of(pair: Pair) -> tuple[list[float], list[float]]:
    """Edges of a pair's map."""
    return binning.linear_edges(*pair.x_range, pair.bins), binning.linear_edges(*pair.y_range, pair.bins)


def grid_of(cells: DataFrame, nx: int, ny: int) -> np.ndarray:
    """Counts [x, y] of ungrouped cells: at most nx * ny rows."""
    out = np.zeros((nx, ny), np.int64)
    for r in cells.select("xi", "yi", "count").collect():
        out[r[0], r[1]] = r[2]
    return out


def overlay_block(frames: DataFrame, pair: Pair, group: Sequence[str]) -> dict | None:
    """Majority states and centres of each group, labels in natural order; None without states."""
    if pair.state not in frames.columns:
        return None
    xe, ye = edges_of(pair)
    names = [r[0] for r in overlay.state_labels(frames, pair.state).orderBy("position").collect()]
    place = {n: i for i, n in enumerate(names)}
    keyed = frames.withColumn("_group", overlay.group_name(group))
    bins = overlay.majority_states(keyed, pair.x_feature, pair.y_feature, pair.state, xe, ye, ["_group"]).orderBy("_group", "bin").collect()
    centres = overlay.state_centres(keyed, pair.x_feature, pair.y_feature, pair.state, xe, ye, ["_group"], pair.periodic).collect()
    groups: dict[str, dict] = {}
    for r in keyed.select("_group").distinct().orderBy("_group").collect():
        groups[r[0]] = {"name": r[0], "bins": [], "states": [], "centres": []}
    for r in bins:
        groups[r["_group"]]["bins"].append(r["bin"])
        groups[r["_group"]]["states"].append(place[r[pair.state]])
    for r in sorted(centres, key=lambda r: place[r[pair.state]]):
        groups[r["_group"]]["centres"].append({"state": place[r[pair.state]], "x": r["centre_x"], "y": r["centre_y"], "frames": r["frames"]})
    return {"labels": names, "groups": list(groups.values())}


def overlay_dots(points: DataFrame, pair: Pair) -> list[tuple[float, float]]:
    """Every pixel of a pair's picture that holds overlay points, in fractions of the map: no more than the picture has."""
    (x0, x1), (y0, y1) = pair.x_range, pair.y_range
    w, h = png.picture_size(pair.bins, pair.bins)
    on = density.binned(points, pair.x_feature, pair.y_feature, *edges_of(pair))
    x, y = (F.col(c).cast("double") for c in (pair.x_feature, pair.y_feature))
    # the picture's rows run downwards
    px, py = F.floor((x - x0) / (x1 - x0) * (w - 1)), F.floor((1 - (y - y0) / (y1 - y0)) * (h - 1))
    return [((r[0] + 0.5) / (w - 1), 1 - (r[1] + 0.5) / (h - 1)) for r in on.select(px.alias("px"), py.alias("py")).distinct().collect()]


def write_density_picture(frames: DataFrame, pair: Pair, path: str, group: Sequence[str] = (), points: Sequence[DataFrame] = ()) -> None:
    """PNG of a pair's map, with the first group's state centres and all points of all overlays that have the pair's columns."""
    xe, ye = edges_of(pair)
    counts = grid_of(density.cells(frames, pair.x_feature, pair.y_feature, xe, ye), pair.bins, pair.bins)
    (x0, x1), (y0, y1) = pair.x_range, pair.y_range
    block = overlay_block(frames, pair, group)
    centres = [((c["x"] - x0) / (x1 - x0), (c["y"] - y0) / (y1 - y0), c["state"], block["labels"][c["state"]]) for c in (block["groups"][0]["centres"] if block and block["groups"] else [])]
    dots = [(*d, i) for i, p in enumerate(points) if {pair.x_feature, pair.y_feature} <= set(p.columns) for d in overlay_dots(p, pair)]
    png.write_png(path, png.density_picture(counts, pair.log_scale, centres, dots))


def square(matrix: DataFrame, group: Sequence[str], value: str) -> tuple[list[str], np.ndarray]:
    """Labels and square array of the first group's matrix."""
    first = matrix.select(*group).orderBy(*[F.col(g).asc_nulls_last() for g in group]).first()
    if first is None:
        return [], np.zeros((1, 1)) * np.nan
    for g, v in zip(group, first):
        matrix = matrix.where(F.col(g).eqNullSafe(F.lit(v)))
    rows = matrix.select("src", "dst", value).collect()
    names = sorted({r[0] for r in rows})
    place = {n: i for i, n in enumerate(names)}
    out = np.full((len(names), len(names)), np.nan)
    for s, d, v in rows:
        out[place[s], place[d]] = np.nan if v is None else v
    return names, out


def write_transition_picture(matrix: DataFrame, average: DataFrame | None, group: Sequence[str], path: str) -> None:
    """PNG of the first averaged matrix, else the first group's: counts, probabilities, rates and barriers as far as known."""
    use, keys = (average, [g for g in group if g != "bead_id"]) if average is not None else (matrix, list(group))
    values = [c for c in ("count", "probability", "rate", "barrier") if c in use.columns]
    use = use.persist()
    try:
        panels = [square(use, keys, v) for v in values]
    finally:
        use.unpersist()
    png.write_png(path, png.matrix_picture([m for _, m in panels], values, panels[0][0]))


#: A representative's fields that its record takes if the table has them.
_RECORD = ("frame_id", "trajectory_id", "bead_id", "frame_number", "step_number", "energy")


def _records(rows: Sequence[Row], pair: Pair) -> list[dict[str, Any]]:
    """A record of each representative: bin, frame, the values of both axes and, of shifted ones, the unshifted values."""
    out = []
    for r in rows:
        f = r.asDict()
        record = {"xi": f["xi"], "yi": f["yi"], **{k: f.get(k) for k in _RECORD}}
        for axis, name, feature in (("x", pair.x, pair.x_feature), ("y", pair.y, pair.y_feature)):
            record[axis] = float(f[feature])
            if feature != name:
                record[f"raw_{axis}"] = f.get(name)
        record["source_file"] = None if f.get("source_file") is None else page.private_path(f["source_file"], os.getcwd())
        out.append({k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in record.items()})
    return out


def read_structures(chosen: DataFrame, rows: Sequence[Row]) -> dict[str, tuple[str, list[str], np.ndarray]]:
    """Structures of representatives by bin, each from its file: text by byte offset, HDF5 runs by number and bead."""
    seekable = chosen.where("source_file is not null and byte_offset >= 0")
    read = xyz.read_frames(seekable.select("source_file", "frame_number", "byte_offset"), uniform=False)
    joined = seekable.select("xi", "yi", "source_file", "byte_offset").join(read, ["source_file", "byte_offset"])
    found = {(r[0], r[1]): (r[2], r[3], r[4]) for r in joined.select("xi", "yi", "comment_line", "elements", "coords").collect()}
    # frames of HDF5 runs have no comment
    binary = [r for r in rows if r["byte_offset"] == h5.NO_OFFSET and r["source_file"] is not None]
    if binary:
        got = {(r[0], r[1], r[2]): r for r in h5.read_frames(chosen.where((F.col("byte_offset") == h5.NO_OFFSET) & F.col("source_file").isNotNull())).collect()}
        for r in binary:
            *_, elements, coords = got[r["source_file"], r["frame_number"], r["bead_id"]]
            found[r["xi"], r["yi"]] = "", elements, coords
    cells = list(found)
    return {f"{cells[i][0]}_{cells[i][1]}": (found[cells[i]][0], list(found[cells[i]][1]), np.array(found[cells[i]][2], float).reshape(-1, 3)) for i in payload.winding(cells)}


def structure_block(found: Mapping[str, tuple[str, list[str], np.ndarray]], reference: str | None) -> tuple[dict[str, Any] | None, dict[str, str] | None]:
    """Structures laid on the reference's heavy atoms, packed; or as xyz texts, unmoved, where elements differ."""
    if not found:
        return None, None
    elements = next(iter(found.values()))[1]
    if reference not in found or any(e != elements for _, e, _ in found.values()):
        return None, {k: payload.xyz_text(*s) for k, s in found.items()}
    stacked = np.stack([x for *_, x in found.values()])
    fixed = found[reference][2] - found[reference][2].mean(axis=0)
    moved, _ = structures.superpose_all(stacked, fixed, structures.heavy_atoms(elements))
    laid = {k: (c, e, x) for (k, (c, e, _)), x in zip(found.items(), moved)}
    return payload.encode_structures(laid, payload.fitting_step(moved)), None


def write_page(frames: DataFrame, pair: Pair, run: Run, path: str, pages: Sequence[tuple[str, str, str]] = (), with_structures: bool = True) -> None:
    """Page of a pair's map: a representative frame and its structure for each occupied bin, and the states.

    The structures lie on that of the most populated bin, the first one in order on ties.
    """
    xe, ye = edges_of(pair)
    counts = grid_of(density.cells(frames, pair.x_feature, pair.y_feature, xe, ye), pair.bins, pair.bins)
    meta = ["source_file", "trajectory_id", "bead_id", "frame_number", "byte_offset", "atom_count", "step_number", "energy", pair.x, pair.y]
    keep = [c for c in dict.fromkeys(meta) if c in frames.columns and c not in (pair.x_feature, pair.y_feature)]
    chosen = density.representatives(frames, pair.x_feature, pair.y_feature, xe, ye, ["frame_id"], keep=keep).persist()
    try:
        rows = chosen.orderBy("xi", "yi").collect()
        found = read_structures(chosen, rows) if with_structures and {"source_file", "byte_offset"} <= set(chosen.columns) else {}
    finally:
        chosen.unpersist()
    top = max(rows, key=lambda r: counts[r["xi"], r["yi"]], default=None)
    reference = None if top is None else f"{top['xi']}_{top['yi']}"
    packed, texts = structure_block(found, reference)
    _, _, group = clustering_of(run.clustering, pair) if run.clustering else ("", {}, [])
    interactive = run.plots.get("interactive") or {}
    data = page.page_data(
        counts, pair.x_range, pair.y_range, pair.title, (pair.x_label, pair.y_label), frames=_records(rows, pair), structures=packed, xyz=texts,
        states=overlay_block(frames, pair, group), pages=page.navigation(pages, pair.name) if pages else None, mode=str(interactive.get("scale_mode", "log")),
        temperature=interactive.get("temperature", run.transitions.get("temperature")), most_pins=int(interactive.get("max_pinned", 15)), periodic=pair.periodic,
        axis_atoms={a: atoms for a, atoms in (("x", pair.x_atoms), ("y", pair.y_atoms)) if atoms}, reference=reference if packed else None,
    )
    page.write(path, data)
