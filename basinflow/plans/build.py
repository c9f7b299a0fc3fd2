"""From trajectory files to the coordinate table, and on to states and transitions."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import asdict, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import bonds, coordinates, dbscan, grid_states, table, transitions
from ..session import written
from ..sources import h5, xyz
from ..sources.files import discover, stamps
from . import manifest
from .config import Input, Pair, Run, clustering_of

VERSION = 3


def _settings(run: Run) -> str:
    """What, beside its files, a trajectory's rows depend on, as a digest."""
    source = run.input
    return manifest.digest(
        {
            "version": VERSION, "format": source.format, "positions": source.positions, "range": [source.start, source.end], "cutoff": source.bond_cutoff,
            "dofs": [[d.name, d.type, d.atoms, d.domain] for d in run.dofs],
        }
    )


def _members(spark: SparkSession, run: Run) -> DataFrame:
    """(source_file, trajectory_id, bead_id, file_rank, trajectory_rank, part, digest) of every file of a run.

    Trajectories are ranked by their first file, files by their place in their trajectory.
    The digest covers a trajectory's files, with sizes and times, beads and settings.
    """
    source = run.input
    files = discover(source.pattern, source.format)
    path = F.col("source_file")
    if source.format == "hdf5":
        ids = stamps(spark, files).join(spark.createDataFrame([(f, os.path.basename(h5.run_folder(f))) for f in files], "source_file string, trajectory_id string"), "source_file").withColumn("bead_id", F.lit(None).cast("string"))
    else:
        ids = stamps(spark, files).withColumns({"trajectory_id": labels.trajectory_id(path, source.trajectory_pattern), "bead_id": labels.bead_id(path, source.bead_pattern)})
    ids = written(ids, "files")
    member = F.struct("place", "source_file", "size", F.round(F.col("mtime") * 1000).cast("long").alias("at"), "bead_id")
    key = F.coalesce("trajectory_id", F.lit(""))
    parts = ids.groupBy("trajectory_id").agg(F.sort_array(F.collect_list(member)).alias("m"), F.min("place").alias("trajectory_rank"))
    facts = F.concat_ws("\n", F.lit(_settings(run)), key, F.to_json(F.transform("m", lambda f: f.dropFields("place")), {"ignoreNullFields": "false"}))
    each = parts.select("trajectory_id", "trajectory_rank", manifest.part_names(key).alias("part"), F.sha2(facts, 256).alias("digest"), F.posexplode("m").alias("file_rank", "f"))
    return each.select("f.source_file", "trajectory_id", "f.bead_id", "file_rank", "trajectory_rank", "part", "digest")


def _coordinates(spark: SparkSession, run: Run, members: DataFrame) -> DataFrame:
    """Coordinates of the members' frames, cut where a bond breaks; positions stay behind.

    All files are indexed and read together: tasks are runs of frames, whatever files
    and trajectories they are of.
    """
    source = run.input
    files = [r[0] for r in members.select("source_file").collect()]
    # a row for each file; the join's side is chosen by its size
    listed = members.drop("trajectory_rank", "digest")
    specs = {d.name: (d.type, d.atoms or ()) for d in run.dofs}
    if source.format == "hdf5":
        frames = h5.read_runs(spark, files, source.positions or "bead", source.start, source.end)
        frames = frames.withColumn("comment_line", F.lit("")).drop("elements", "trajectory_id")
        listed = listed.drop("bead_id")
    else:
        index = xyz.cached_index(spark, files, f"{source.index_dir or source.cache_dir}/index")
        index = bonds.frame_range(index, "frame_number", source.start, source.end)
        frames = xyz.read_frames(index, with_elements=False)
        frames = frames.withColumn("step_number", labels.comment_step(F.col("comment_line"))).withColumn("energy", F.lit(None).cast("float")).withColumn("comment_line", F.lit(""))
        if source.bond_cutoff is not None:
            first = index.groupBy("source_file").agg(F.min(F.struct("frame_number", "byte_offset")).alias("f")).select("source_file", "f.*")
            reference = bonds.reference_bonds(xyz.read_frames(first), ["source_file"], "elements", "coords")
            frames = frames.join(reference, "source_file", "left").withColumn("_broken", bonds.broken_by("coords", "bonds", source.bond_cutoff)).drop("bonds")
    out = coordinates.add_coordinates(frames, "coords", specs).join(listed, "source_file").withColumn("local_frame_index", F.col("frame_number"))
    if source.bond_cutoff is not None and "_broken" in out.columns:
        # written without positions: the cut reads the frames twice
        out = written(out, "uncut")
        out = bonds.cut_at_break(out.withColumnRenamed("_broken", "_gone"), F.col("_gone"), "frame_number", ["source_file"], ["trajectory_id"]).drop("_gone")
    return out


def coordinate_table(spark: SparkSession, run: Run) -> tuple[DataFrame, list[str]]:
    """The coordinate table, and the trajectories that had to be built.

    Trajectories whose files and settings are unchanged come from the cache; all others
    are built by one job, which writes a folder for each.
    """
    members = written(_members(spark, run), "members")
    wanted = members.select("part", "digest", "trajectory_rank", "trajectory_id").distinct()
    store = manifest.Store(spark, f"{run.input.cache_dir}/trajectories")
    stale = written(store.missing(wanted), "stale")
    built = [r[0] for r in stale.orderBy("trajectory_rank").select("trajectory_id").collect()]
    if built:
        store.write(_coordinates(spark, run, members.join(stale.select("part"), "part", "left_semi")), stale)
    frames = store.read(wanted.drop("trajectory_id"))
    frames = frames.withColumn("_bead", F.coalesce("bead_id", F.lit("")))
    frames = table.number_rows(frames, ["trajectory_rank", "file_rank", "_bead", "frame_number"], "frame_id").drop("_bead", "trajectory_rank", "file_rank")
    frames = coordinates.add_shifted(frames.withColumn("global_frame_index", F.col("frame_id")), run.shifts)
    tail = [c for c in ("energy", "step_number") if c in frames.columns]
    names = [d.name for d in run.dofs]
    shifted = [c for c in frames.columns if c.endswith("_shifted")]
    core = [f.name for f in table.CORE]
    return table.validated(frames.select(*core, *names, *tail, *shifted), names), built


def table_key(spark: SparkSession, run: Run) -> str:
    """What a run's coordinate table depends on, as a digest: results made of it are kept under that."""
    parts = _members(spark, run).select("trajectory_rank", "part", "digest").distinct()
    # an order-free sum of hashes: no list of all parts is made
    h = F.xxhash64("trajectory_rank", "part", "digest")
    found = parts.agg(F.count(F.lit(1)), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first()
    return manifest.digest([list(found), dict(run.shifts)])


def overlay_table(spark: SparkSession, run: Run, entry: Mapping[str, Any]) -> DataFrame:
    """Coordinate table of a second data set, all its frames, grouped by folder; sampled to ``max_points`` if set."""
    label = str(entry.get("label", entry["path"]))
    source = Input(str(entry["path"]), bond_cutoff=run.input.bond_cutoff, cache_dir=f"{run.run_dir}/overlays/{manifest.part_name(label)}")
    frames, _ = coordinate_table(spark, replace(run, input=source, pairs=(), overlays=()))
    most = entry.get("max_points")
    return frames if most is None else table.sample_exact(frames, int(most), ["frame_id"])


def assign_states(frames: DataFrame, pair: Pair, config: Mapping[str, Any], scheme: str | None = None, group: Sequence[str] | None = None) -> DataFrame:
    """frames with the pair's state column."""
    scheme, params, configured = clustering_of(config, pair, scheme)
    group = list(configured if group is None else group)
    lacking = [c for c in (pair.x_feature, pair.y_feature, *group) if c not in frames.columns]
    if lacking:
        raise ValueError(f"states of {pair.name!r} need the columns {lacking}")
    if scheme == "grid":
        groups = frames.select(*group).distinct().count() if group else 1
        return grid_states.assign_grid_states(frames, pair.x_feature, pair.y_feature, pair.state, step=float(params["step"]), min_count=int(params["min_count"]), x_domain=pair.x_domain, y_domain=pair.y_domain, group=group, periodic=pair.periodic, groups_at_most=groups)
    found = dbscan.dbscan_states(frames, pair.x_feature, pair.y_feature, "frame_id", pair.state, eps=float(params["eps"]), min_samples=int(params["min_samples"]), group=group, periodic=params["periodic"])
    return frames.drop(pair.state).join(found, "frame_id", "left")


def assign_all_states(frames: DataFrame, run: Run, group: Sequence[str] | None = None) -> DataFrame:
    """frames with the states of every pair."""
    for pair in run.pairs:
        frames = assign_states(frames, pair, run.clustering, group=group)
    return frames


def transition_group(frames: DataFrame, group: Sequence[str] | None = None) -> list[str]:
    """Grouping of transitions: trajectories, and beads if there are any."""
    if group is not None:
        if not group:
            raise ValueError("transitions need a group")
        return list(group)
    if "trajectory_id" not in frames.columns:
        raise ValueError("transitions need a trajectory_id column")
    beads = "bead_id" in frames.columns and not frames.where("bead_id is not null").limit(1).isEmpty()
    return ["trajectory_id", "bead_id"] if beads else ["trajectory_id"]


def analyse_transitions(frames: DataFrame, pair: Pair, settings: Mapping[str, Any], group: Sequence[str] | None = None, average_beads: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Matrices of every group, and their averages over beads if groups have them."""
    group = transition_group(frames, group)
    options = {"lag": int(settings.get("lag", 1)), "bridge_noise": bool(settings.get("skip_noise_intermediates", True)), "dt": None if settings.get("dt") is None else float(settings["dt"])}
    temperature = None if settings.get("temperature") is None else float(settings["temperature"])
    barrier = {"model": str(settings.get("barrier_model", "eyring")), "transmission": float(settings.get("transmission_coefficient", 1.0)), "attempt_frequency": settings.get("attempt_frequency"), "conversion": float(settings.get("energy_conv_factor", 1.0))}
    matrix = transitions.analyse(frames, pair.state, "global_frame_index", group, temperature=temperature, **options, **barrier)
    if not average_beads or "bead_id" not in group:
        return matrix, None
    return matrix, transitions.averages(frames, matrix, group, "bead_id", temperature=temperature, **barrier)


def transitions_of(spark: SparkSession, run: Run, pair: Pair, frames: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None, bool]:
    """A pair's matrices and bead averages, and whether they are kept ones.

    They are kept in the cache by the table's key, the pair, the settings of its states
    and of the transitions, and made anew if any of them changes.
    """
    group = transition_group(frames)
    wanted = json.loads(json.dumps({"table": key, "pair": asdict(pair), "states": clustering_of(run.clustering, pair), "transitions": dict(run.transitions), "group": group}, sort_keys=True, default=str))
    store = manifest.Store(spark, f"{run.input.cache_dir}/transitions")
    made: dict[str, DataFrame | None] = {}

    def make(kind: str) -> DataFrame:
        if not made:
            made.update(zip(("matrix", "average"), analyse_transitions(frames, pair, run.transitions)))
        return made[kind]

    kinds = ("matrix", "average")[: 2 if "bead_id" in group else 1]
    found = {k: manifest.kept(store, f"{pair.name} {k}", wanted, lambda k=k: make(k)) for k in kinds}
    return found["matrix"][0], found["average"][0] if "average" in found else None, all(old for _, old in found.values())
