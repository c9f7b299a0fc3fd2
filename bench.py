"""Headline queries and a whole run, timed: one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query is run
once to warm up and then timed in full: every result row is computed. The run goes from
one xyz file of ``BENCH_FRAMES`` made-up frames of 21 atoms to a page: cold, with nothing
cached, and warm, with the coordinate table in the cache. Rates of the parsing steps alone
are measured on some of its frames.
"""

from __future__ import annotations

import io
import json
import math
import os
import shutil
import tempfile
import time

import numpy as np

from basinflow import catalog, cli
from basinflow.plans import config
from basinflow.session import local_session
from basinflow.sources import xyz

HEADLINE = [
    "density_cells",
    "density_cells_by_group",
    "representatives",
    "free_energy_units",
    "dof_dihedral",
    "pair_pipeline",
    "grid_states_periodic",
    "overlay_majority",
    "overlay_centres_circular",
    "transition_counts",
    "transition_probabilities",
    "averaged_probabilities",
    "bond_graph",
    "table_row_numbers",
]
ATOMS = 21
_ELEMENTS = "CCCCCCCCCOOOOHHHHHHHH"


def made_up(frames: int, seed: int = 1) -> np.ndarray:
    """Frames of a chain that turns about two of its bonds between four wells."""
    rng = np.random.default_rng(seed)
    k = np.arange(ATOMS)
    base = np.stack([1.2 * k * 0.9, 0.8 * (k % 2), 0.5 * np.sin(k)], 1)
    x = base + rng.normal(0, 0.03, (frames, ATOMS, 3))
    well = rng.integers(0, 4, frames)
    wells = np.radians([[-120, 60], [60, -150], [150, 150], [-30, -60]])[well] + rng.normal(0, 0.25, (frames, 2))
    for turn, (a, b) in enumerate(((4, 5), (11, 12))):
        axis = x[:, b] - x[:, a]
        axis /= np.linalg.norm(axis, axis=1, keepdims=True)
        rest, origin = x[:, b + 1 :], x[:, b][:, None]
        c, s = np.cos(wells[:, turn])[:, None, None], np.sin(wells[:, turn])[:, None, None]
        v, u = rest - origin, axis[:, None]
        x[:, b + 1 :] = origin + v * c + np.cross(np.broadcast_to(u, v.shape), v) * s + u * (v * u).sum(axis=2, keepdims=True) * (1 - c)
    return x


def write_frames(path: str, frames: int) -> None:
    """One xyz file of made-up frames."""
    line = "\n".join(f"{e} %.6f %.6f %.6f" for e in _ELEMENTS)
    with open(path, "w", encoding="utf-8") as f:
        for at in range(0, frames, 20_000):
            n = min(20_000, frames - at)
            for i, x in enumerate(made_up(n, at).reshape(n, -1).tolist(), at):
                f.write(f"{ATOMS}\n# Step: {i}\n{line % tuple(x)}\n")


def run_times(spark, frames: int) -> dict[str, float]:
    """Seconds from an xyz file to a page, cold and warm, and frames a second."""
    folder = tempfile.mkdtemp(prefix="basinflow-bench-")
    try:
        write_frames(f"{folder}/run.xyz", frames)
        settings = {
            "run_dir": f"{folder}/out",
            "data": {"path_pattern": f"{folder}/*.xyz"},
            "dof": [
                {"name": "phi", "type": "dihedral", "atoms": [3, 4, 5, 6], "domain": [-180, 180]},
                {"name": "psi", "type": "dihedral", "atoms": [10, 11, 12, 13], "domain": [-180, 180]},
            ],
            "coordinate_pairs": [{"name": "pp", "x": "phi", "y": "psi", "bins": 180}],
            "clustering": {"algorithm": "grid", "default": {"bin_size": 30.0, "min_count": max(2, frames // 265)}},
        }
        out = {}
        for kind in ("cold", "warm"):
            began = time.perf_counter()
            timer = cli.execute(spark, "build-interactive", config.parse(settings), say=lambda _: None)
            out[f"xyz_to_page_{kind}"] = round(time.perf_counter() - began, 3)
            out |= {f"{kind}: {k}": round(v, 3) for k, v in timer.seconds.items()}
        out["page_mb"] = round(os.path.getsize(f"{folder}/out/plots/density_pp.html") / 1e6, 2)
        out["frames_per_sec"] = round(frames / out["xyz_to_page_cold"])
        with open(f"{folder}/run.xyz", "rb") as f:
            some = b"".join(f.readline() for _ in range(5000 * (ATOMS + 2)))
        began = time.perf_counter()
        n = sum(1 for _ in xyz.scan(io.BufferedReader(io.BytesIO(some)), "bench"))
        out["micro_scan_frames_per_sec"] = round(n / (time.perf_counter() - began))
        stream = io.BufferedReader(io.BytesIO(some))
        began = time.perf_counter()
        for _ in range(n):
            xyz.parse_frame(stream, "bench")
        out["micro_parse_frames_per_sec"] = round(n / (time.perf_counter() - began))
        return out
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    frames = int(os.environ.get("BENCH_FRAMES", 211_762))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def run(name: str) -> float:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    times = {}
    for name in HEADLINE:
        run(name)
        times[name] = round(min(run(name) for _ in range(2)), 4)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    value = round(math.fsum(times.values()), 3)
    whole = run_times(spark, frames)
    times |= {k: whole.pop(k) for k in ("xyz_to_page_cold", "xyz_to_page_warm")}
    out = {
        "metric": "total time of the headline queries",
        "value": value,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cpus,
        "lineitem_rows_per_sec": {k: round(rows / times[k]) for k in ("density_cells", "representatives", "grid_states_periodic")},
        "run": {"frames": frames, "atoms": ATOMS} | whole,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
