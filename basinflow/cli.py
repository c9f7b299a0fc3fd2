"""Command line: ``python -m basinflow.cli COMMAND --config FILE``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .operators import grid_states
from .plans import build, config, outputs
from .plans.timing import StageTimer
from .sources import tables

COMMANDS = {
    "extract-coordinates": "build the coordinate table",
    "plot-densities": "a picture of each pair's population map",
    "cluster-states": "assign states and report them",
    "compute-transitions": "matrices and pictures of state transitions",
    "build-interactive": "a standalone page for each pair",
    "run-all": "everything",
}


def load(path: str) -> config.Run:
    """Settings of a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return config.parse(yaml.safe_load(f) or {})


def _group(run: config.Run, pair: config.Pair) -> list[str]:
    return config.clustering_of(run.clustering, pair)[2] if run.clustering else []


def execute(spark: SparkSession, command: str, run: config.Run, skip_transitions: bool = False, say=print) -> StageTimer:
    """Runs a command; returns and reports the times of its stages."""
    plots = os.path.join(run.run_dir, "plots")
    os.makedirs(plots, exist_ok=True)
    timer = StageTimer()
    with timer.stage("coordinate table"):
        frames, built = build.coordinate_table(spark, run)
        frames = table_ = frames.persist()
        number = frames.count()
    timer.count("coordinate table", number)
    say(f"coordinate table: {number} frames, built {len(built)} trajectories, {timer.total:.1f} s")
    every = command == "run-all"
    dots: list = []
    try:
        if every or command == "extract-coordinates":
            for key, suffix in (("save_csv", "csv"), ("save_parquet", "parquet")):
                if run.outputs.get(key):
                    path = os.path.join(run.run_dir, f"coordinates.{suffix}")
                    with timer.stage("tables"):
                        tables.write_table(frames, path)
                    say(f"wrote {path}")
        if every or command == "plot-densities":
            dots = [build.overlay_table(spark, run, e) for e in run.overlays]
            for pair in run.pairs:
                path = os.path.join(plots, f"density_{pair.name}.png")
                with timer.stage("pictures"):
                    outputs.write_density_picture(frames, pair, path, points=dots)
                say(f"wrote {path}")
        if command in ("plot-densities", "extract-coordinates"):
            return timer
        if run.clustering:
            # every picture, matrix and page reads the states
            frames = build.assign_all_states(frames, run).persist()
        elif command != "build-interactive":
            raise ValueError("the config has no clustering section")
        if every or command == "cluster-states":
            for pair in run.pairs:
                with timer.stage("states"):
                    say(f"{pair.name}: {grid_states.state_totals(frames, pair.state).first().asDict()}")
                if every:
                    with timer.stage("pictures"):
                        outputs.write_density_picture(frames, pair, os.path.join(plots, f"states_{pair.name}.png"), _group(run, pair), points=dots)
        if (every and not skip_transitions) or command == "compute-transitions":
            key = build.table_key(spark, run)
            for pair in run.pairs:
                with timer.stage("transitions"):
                    group = build.transition_group(frames)
                    matrix, average, kept = build.transitions_of(spark, run, pair, frames, key)
                    matrix.write.mode("overwrite").parquet(os.path.join(run.run_dir, f"transitions_{pair.name}.parquet"))
                    outputs.write_transition_picture(matrix, average, group, os.path.join(plots, f"transition_{pair.name}.png"))
                say(f"{pair.name}: {matrix.select(*group).distinct().count()} groups{', kept' if kept else ''}")
        if every or command == "build-interactive":
            pages = [(p.name, p.title, f"density_{p.name}.html") for p in run.pairs]
            for pair in run.pairs:
                path = os.path.join(plots, f"density_{pair.name}.html")
                with timer.stage("pages"):
                    outputs.write_page(frames, pair, run, path, pages if len(pages) > 1 else ())
                say(f"wrote {path}")
        return timer
    finally:
        table_.unpersist()
        frames.unpersist()
        for line in timer.report():
            say(line)


def main(args: list[str] | None = None) -> int:
    """Entry point."""
    parser = argparse.ArgumentParser(prog="basinflow", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, text in COMMANDS.items():
        p = sub.add_parser(name, help=text)
        p.add_argument("--config", required=True)
        if name == "run-all":
            p.add_argument("--skip-transitions", action="store_true")
    got = parser.parse_args(args)
    run = load(got.config)
    spark = SparkSession.builder.appName("basinflow").getOrCreate()
    execute(spark, got.command, run, getattr(got, "skip_transitions", False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
