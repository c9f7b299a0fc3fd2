"""Run configuration: parsed once into checked, immutable settings."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from ..operators.coordinates import ATOM_TYPES

TYPES = (*ATOM_TYPES, "collective", "external")


@dataclass(frozen=True)
class Dof:
    """A named scalar coordinate."""

    name: str
    type: str
    label: str
    domain: tuple[float, float]
    enabled: bool = True
    atoms: tuple[int, ...] | None = None
    convention: str = "signed"

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"dof {self.name!r}: unknown type {self.type!r}; one of {', '.join(TYPES)}")
        need = ATOM_TYPES.get(self.type)
        if need and (self.atoms is None or len(self.atoms) != need):
            raise ValueError(f"dof {self.name!r}: a {self.type} needs {need} atoms")
        if not self.domain[0] < self.domain[1]:
            raise ValueError(f"dof {self.name!r}: domain must be low < high")


@dataclass(frozen=True)
class Pair:
    """Two coordinates that span a landscape."""

    name: str
    x: str
    y: str
    x_label: str
    y_label: str
    title: str
    x_domain: tuple[float, float]
    y_domain: tuple[float, float]
    x_feature: str
    y_feature: str
    periodic: bool
    bins: int
    x_range: tuple[float, float]
    y_range: tuple[float, float]
    log_scale: bool = True
    colormap: str = "viridis"
    x_atoms: tuple[int, ...] | None = None
    y_atoms: tuple[int, ...] | None = None

    @property
    def state(self) -> str:
        """Column of the pair's states."""
        return f"state_{self.name}"


@dataclass(frozen=True)
class Input:
    """Where frames come from and which of them count."""

    pattern: str
    format: str = "xyz"
    trajectory_pattern: str | None = None
    bead_pattern: str | None = None
    positions: str | None = None
    start: int = 0
    end: int | None = None
    bond_cutoff: float | None = None
    cache_dir: str = ""
    index_dir: str | None = None

    def __post_init__(self) -> None:
        if self.format not in ("xyz", "hdf5"):
            raise ValueError(f"data.format must be xyz or hdf5; got {self.format!r}")
        for key, p in (("trajectory_id_pattern", self.trajectory_pattern), ("bead_id_pattern", self.bead_pattern)):
            if p is None:
                continue
            if self.format == "hdf5":
                raise ValueError(f"data.{key}: an hdf5 run names itself by its folder; remove the setting")
            try:
                groups = re.compile(p).groups
            except re.error as e:
                raise ValueError(f"data.{key} is no valid pattern: {e}") from None
            if groups < 1:
                raise ValueError(f"data.{key} {p!r} needs a group; group 1 is the id")
        if self.format == "hdf5":
            if self.positions not in ("bead", "centroid"):
                raise ValueError(f"data.positions_source must be bead or centroid; got {self.positions!r}")
            if self.bond_cutoff is not None:
                raise ValueError("bond_break can't be used with hdf5 runs")
        elif self.positions is not None:
            raise ValueError("data.positions_source is for hdf5 runs only")
        if self.start < 0 or (self.end is not None and self.end < self.start):
            raise ValueError(f"frame_range must be 0 <= start_frame <= end_frame; got {self.start}, {self.end}")
        if self.bond_cutoff is not None and not self.bond_cutoff > 0:
            raise ValueError(f"bond_break.cutoff must be positive; got {self.bond_cutoff}")


@dataclass(frozen=True)
class Run:
    """Everything a run needs."""

    input: Input
    dofs: tuple[Dof, ...]
    shifts: Mapping[str, float]
    pairs: tuple[Pair, ...]
    run_dir: str
    clustering: Mapping[str, Any] = field(default_factory=dict)
    transitions: Mapping[str, Any] = field(default_factory=dict)
    outputs: Mapping[str, Any] = field(default_factory=dict)
    plots: Mapping[str, Any] = field(default_factory=dict)
    overlays: tuple[Mapping[str, Any], ...] = ()


def _two(values: Sequence, what: str) -> tuple[float, float]:
    if len(values) != 2:
        raise ValueError(f"{what} must be two numbers; got {values!r}")
    a, b = float(values[0]), float(values[1])
    if not a < b:
        raise ValueError(f"{what} must be low < high; got {values!r}")
    return a, b


def _atoms(value: Sequence) -> tuple[int, ...]:
    return tuple(map(int, value))


_NEEDED = object()
#: Fields of a coordinate: how a value is read, and what stands for one that isn't set.
_DOF_FIELDS: dict[str, tuple[Callable[[Any], Any], Any]] = {
    "name": (str, _NEEDED),
    "type": (str, _NEEDED),
    "domain": (lambda v: _two(v, "the range"), _NEEDED),
    "label": (str, None),
    "enabled": (bool, True),
    "atoms": (_atoms, None),
    "convention": (str, "signed"),
}


def _read_fields(raw: Any, fields: Mapping[str, tuple[Callable[[Any], Any], Any]], what: str) -> dict[str, Any]:
    """The fields' values in a mapping, each read and checked."""
    if not isinstance(raw, Mapping):
        raise ValueError(f"{what}: a mapping is expected, not {raw!r}")
    found: dict[str, Any] = {}
    for key, (read, default) in fields.items():
        value = raw.get(key)
        if value is None and default is _NEEDED:
            raise ValueError(f"{what}: {key} is missing")
        try:
            found[key] = default if value is None else read(value)
        except (TypeError, ValueError) as why:
            raise ValueError(f"{what}: {key} can't be {value!r}: {why}") from why
    return found


def dofs_of(config: Mapping[str, Any], include_disabled: bool = False) -> tuple[Dof, ...]:
    """Coordinates of a config; each needs a name, a type and a domain."""
    read = [_read_fields(raw, _DOF_FIELDS, f"dof {i + 1}") for i, raw in enumerate(config.get("dof") or [])]
    every = [Dof(**f | {"label": f["label"] if f["label"] is not None else f["name"]}) for f in read]
    return tuple(every) if include_disabled else tuple(d for d in every if d.enabled)


def shifts_of(config: Mapping[str, Any]) -> dict[str, float]:
    """Degrees by column: a number, or a mapping with ``shift``; unset ones are left out."""
    out = {}
    for column, raw in (config.get("coordinate_transforms") or {}).items():
        value = raw.get("shift") if isinstance(raw, Mapping) else raw
        if value is not None:
            out[str(column)] = float(value)
    return out


def pair_transforms_of(raw: Sequence | None) -> list[tuple[str, float]]:
    """(type, value) of a list of pair transforms."""
    out = []
    for entry in raw or []:
        if not isinstance(entry, Mapping) or "type" not in entry:
            raise ValueError(f"a pair transform needs a type; got {entry!r}")
        out.append((str(entry["type"]), float(entry.get("value", 0.0))))
    return out


def pairs_of(config: Mapping[str, Any]) -> tuple[Pair, ...]:
    """Coordinate pairs of a config; names must be those of coordinates, labels and domains are theirs unless set."""
    by_name = {d.name: d for d in dofs_of(config, include_disabled=True)}
    shifts = shifts_of(config)
    plots = config.get("plots") or {}
    density = plots.get("density") or {}
    raw = config.get("coordinate_pairs") or []
    entries = [{"name": k, **v} for k, v in raw.items()] if isinstance(raw, Mapping) else raw
    out = []
    for entry in entries:
        if not isinstance(entry, Mapping):
            raise ValueError(f"a coordinate pair must be a mapping; got {entry!r}")
        name = str(entry["name"])
        for axis in ("x", "y"):
            if str(entry[axis]) not in by_name:
                raise KeyError(f"coordinate pair {name!r}: no dof {entry[axis]!r}; there are {sorted(by_name)}")
        x, y = by_name[str(entry["x"])], by_name[str(entry["y"])]
        bins = entry.get("bins", density.get("bins", 180))
        if isinstance(bins, bool) or not isinstance(bins, int) or bins < 1:
            raise ValueError(f"coordinate pair {name!r}: bins must be a positive whole number; got {bins!r}")
        domains = {a: _two(entry[f"{a}_domain"], f"{a}_domain") if f"{a}_domain" in entry else d.domain for a, d in (("x", x), ("y", y))}
        ranges = {a: _two(entry.get(f"{a}_range") or density.get(f"{a}_range") or domains[a], f"{a}_range") for a in ("x", "y")}
        labels = {a: str(entry.get(f"{a}_label", d.label)) for a, d in (("x", x), ("y", y))}
        feature = {a: f"{d.name}_shifted" if d.name in shifts else d.name for a, d in (("x", x), ("y", y))}
        out.append(Pair(
            name, x.name, y.name, labels["x"], labels["y"], str(entry.get("title", f"{labels['x']} vs {labels['y']}")), domains["x"], domains["y"], feature["x"], feature["y"],
            x.type == "dihedral" and y.type == "dihedral", bins, ranges["x"], ranges["y"], bool(entry.get("log_scale", density.get("log_scale", True))), str(entry.get("colormap", density.get("colormap", "viridis"))), x.atoms, y.atoms,
        ))
    return tuple(out)


def clustering_of(config: Mapping[str, Any], pair: Pair, scheme: str | None = None) -> tuple[str, dict[str, Any], list[str]]:
    """Scheme, parameters and grouping of a pair's states: the pair's section over the default one."""
    section = config.get("clustering", config) or {}
    scheme = scheme or str(section.get("algorithm", "grid"))
    merged = {**(section.get("default") or {}), **(section.get(pair.name) or {})}
    group = section.get("groupby")
    group = [group] if isinstance(group, str) else [str(g) for g in group or []]
    if scheme == "grid":
        params = {"step": merged.get("bin_size"), "min_count": merged.get("min_count")}
    elif scheme == "dbscan":
        params = {"eps": merged.get("eps", section.get("eps")), "min_samples": merged.get("min_samples", section.get("min_samples")), "periodic": bool(merged.get("periodic", False))}
    else:
        raise ValueError(f"unknown clustering algorithm {scheme!r}; grid or dbscan")
    lacking = [k for k, v in params.items() if v is None]
    if lacking:
        raise ValueError(f"clustering of {pair.name!r} by {scheme} needs {lacking}")
    return scheme, params, group


def parse(config: Mapping[str, Any]) -> Run:
    """A config's settings, all checked."""
    data, cache = config.get("data") or {}, config.get("cache") or {}
    if not config.get("run_dir"):
        raise ValueError("run_dir is not set")
    if not data.get("path_pattern"):
        raise ValueError("data.path_pattern is not set")
    run_dir, kind = str(config["run_dir"]), str(data.get("format") or "xyz").lower()
    frames, bonds = config.get("frame_range") or {}, config.get("bond_break") or {}
    source = Input(
        str(data["path_pattern"]), kind, data.get("trajectory_id_pattern"), data.get("bead_id_pattern"), data.get("positions_source") or ("bead" if kind == "hdf5" else None),
        int(frames.get("start_frame") or 0), None if frames.get("end_frame") is None else int(frames["end_frame"]), float(bonds.get("cutoff", 2.0)) if bonds.get("enabled") else None,
        str(cache.get("trajectory_cache_dir") or f"{run_dir}/.cache"), cache.get("index_cache_dir"),
    )
    dofs = dofs_of(config)
    bad = [d.name for d in dofs if d.type not in ATOM_TYPES]
    if bad:
        raise ValueError(f"dofs {bad} have types that can't be computed from atoms")
    shifts = shifts_of(config)
    unknown = [c for c in shifts if c not in {d.name for d in dofs}]
    if unknown:
        raise ValueError(f"coordinate_transforms names {unknown}, which are no enabled dofs")
    for v in shifts.values():
        if not math.isfinite(v):
            raise ValueError("a shift must be a finite number of degrees")
    return Run(source, dofs, shifts, pairs_of(config), run_dir, config.get("clustering") or {}, config.get("transitions") or {}, config.get("outputs") or {}, config.get("plots") or {}, tuple(config.get("scatter_overlays") or ()))
