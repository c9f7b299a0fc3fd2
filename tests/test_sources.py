import importlib.util
import json
import os
import shutil
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from basinflow import cli
from basinflow.functions import labels
from basinflow.operators import bonds, structures, table
from basinflow.plans import build, config, manifest, outputs, timing
from basinflow.sinks import page, palette, payload, png, template
from basinflow.sources import h5, tables, xyz
from basinflow.sources.files import discover


def write_xyz(path, frames, comment="# Step: {s}  Bead: 0", elements=None):
    with open(path, "w") as f:
        for i, x in enumerate(frames):
            f.write(f"{len(x)}\n{comment.format(s=10 * i)}\n")
            for k, p in enumerate(x):
                f.write(f"{(elements or ['C'] * len(x))[k]} {p[0]:.6f} {p[1]:.6f} {p[2]:.6f} extra\n")
    return str(path)


def helix(n, break_at=None, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(8)
    base = np.stack([1.3 * np.cos(t), 1.3 * np.sin(t), 0.4 * t], 1)
    out = base + rng.normal(0, 0.02, (n, 8, 3))
    if break_at is not None:
        out[break_at:, -1] += 5
    return out


def test_index_offsets_and_random_access(spark, tmp_path):
    frames = helix(5)
    path = write_xyz(tmp_path / "a.xyz", frames)
    index = xyz.index_files(spark, [path]).orderBy("frame_number").collect()
    assert [r.frame_number for r in index] == [0, 1, 2, 3, 4] and index[0].byte_offset == 0
    assert all(a.byte_offset < b.byte_offset for a, b in zip(index, index[1:])) and all(r.atom_count == 8 for r in index)
    atoms, comment, elements, x = xyz.frame_at(path, index[3].byte_offset)
    assert (atoms, comment, elements[0]) == (8, "# Step: 30  Bead: 0", "C") and np.allclose(x, frames[3], atol=1e-6)
    df = xyz.index_files(spark, [path])
    assert np.allclose(xyz.frame(df, path, 4)[3], frames[4], atol=1e-6)
    with pytest.raises(IndexError):
        xyz.frame(df, path, 5)
    meta = xyz.metadata(df).orderBy("frame_number").collect()
    assert [r.step_number for r in meta] == [0, 10, 20, 30, 40] and meta[0].bead_comment == 0 and meta[0].energy is None


@pytest.mark.parametrize("run_frames", [2, 4096])
def test_frames_read_in_runs(spark, tmp_path, run_frames):
    a, b = helix(7), helix(3, seed=1)
    paths = [write_xyz(tmp_path / "a.xyz", a), write_xyz(tmp_path / "b.xyz", b)]
    got = xyz.read_frames(xyz.index_files(spark, paths), run_frames).orderBy("source_file", "frame_number").collect()
    assert np.allclose([r.coords for r in got], np.concatenate([a, b]).reshape(10, -1), atol=1e-5)


def test_format_with_range(spark, tmp_path):
    write_xyz(tmp_path / "a.xyz", helix(6))
    xyz.register(spark)
    got = spark.read.format("xyz").option("start_frame", 1).option("end_frame", 3).load(str(tmp_path / "*.xyz")).orderBy("frame_number").collect()
    assert [r.frame_number for r in got] == [1, 2, 3] and len(got[0].coords) == 24


@pytest.mark.parametrize("text, what", [("x\nc\n", "atom count"), ("2\nc\nC 0 0 0\n", "ends inside"), ("1\n", "ends inside"), ("1\nc\nC 0 0\n", "fewer than 4"), ("1\nc\nC 0 0 z\n", "no numbers")])
def test_bad_files_are_errors(spark, tmp_path, text, what):
    path = tmp_path / "bad.xyz"
    path.write_text(text)
    with pytest.raises(Exception, match=what):
        xyz.read_frames(xyz.index_files(spark, [str(path)])).collect()


@pytest.mark.parametrize("tail, what", [("x\nc\n", "atom count"), ("2\nc\nC 0 0 0\n", "ends inside")])
def test_a_bad_end_of_a_later_split_is_an_error(spark, tmp_path, tail, what):
    path = tmp_path / "bad.xyz"
    path.write_text("1\nc\nC 0 0 0\n" * 6 + tail)
    with pytest.raises(Exception, match=what):
        xyz.index_files(spark, [str(path)], split_bytes=40).collect()


def test_blank_lines_between_frames(spark, tmp_path):
    path = tmp_path / "a.xyz"
    path.write_text("1\nc\nC 0 0 0\n\n\n1\nd\nC 1 1 1\n\n")
    got = xyz.read_frames(xyz.index_files(spark, [str(path)])).orderBy("frame_number").collect()
    assert [r.comment_line for r in got] == ["c", "d"]


def test_changing_atom_count_is_an_error(spark, tmp_path):
    path = tmp_path / "a.xyz"
    path.write_text("1\nc\nC 0 0 0\n2\nd\nC 1 1 1\nC 0 0 0\n")
    index = xyz.index_files(spark, [str(path)])
    with pytest.raises(Exception, match="atoms"):
        xyz.read_frames(index).collect()
    assert xyz.read_frames(index, uniform=False).count() == 2


def test_index_cache_rescans_changed_files_only(spark, tmp_path):
    path, folder = write_xyz(tmp_path / "a.xyz", helix(2)), str(tmp_path / "index")
    assert xyz.cached_index(spark, [path], folder).count() == 2
    before = set(os.listdir(folder))
    assert xyz.cached_index(spark, [path], folder).count() == 2 and set(os.listdir(folder)) == before
    write_xyz(path, helix(3))
    os.utime(path, (1, 1))
    assert xyz.cached_index(spark, [path], folder).count() == 3


def test_discovery(tmp_path):
    for name in ("b.xyz", "a.XYZ", "a.xyz.frameindex.npz", "c.txt"):
        (tmp_path / name).write_text("")
    assert [os.path.basename(p) for p in discover(str(tmp_path / "*"))] == ["a.XYZ", "b.xyz"]
    assert [os.path.basename(p) for p in discover(str(tmp_path / "*.txt"))] == ["c.txt"]
    with pytest.raises(FileNotFoundError):
        discover(str(tmp_path / "nothing*"))


def test_ids_from_names(spark):
    df = spark.createDataFrame([("/d/sim/run.pos_03.xyz",)], "p string")
    row = df.select(labels.trajectory_id(F.col("p"), r"^(.+)_\d+$"), labels.bead_id(F.col("p"), r"_(\d+)$"), labels.trajectory_id(F.col("p")), labels.bead_id(F.col("p"))).first()
    assert tuple(row) == ("run.pos", "03", "sim", None)
    with pytest.raises(Exception, match="no id"):
        df.select(labels.trajectory_id(F.col("p"), r"(zzz)")).collect()


def core_row(**kw):
    row = {"frame_id": 0, "source_file": "f", "trajectory_id": "t", "bead_id": "00", "frame_number": 0, "byte_offset": 0, "atom_count": 8, "comment_line": "", "local_frame_index": 0, "global_frame_index": 0, "phi": 1.5, "energy": None, "step_number": 10}
    return row | kw


@pytest.mark.parametrize("suffix", ["csv", "parquet", "npz"])
def test_table_round_trip(spark, tmp_path, suffix):
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in table.CORE] + ["phi float", "energy float", "step_number long"])
    rows = [core_row(), core_row(frame_id=1, bead_id=None, phi=None, step_number=None)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    path = str(tmp_path / f"t.{suffix}")
    tables.write_table(df, path, {"k": 1} if suffix == "npz" else None)
    back = tables.read_table(spark, path).orderBy("frame_id")
    assert [r.asDict() for r in back.collect()] == rows
    assert tables.coordinate_columns(back) == ["phi"]
    if suffix == "npz":
        assert tables.read_npz(spark, path)[1] == {"k": 1}
    else:
        with pytest.raises(ValueError):
            tables.write_table(df, path, {"k": 1})
    with pytest.raises(ValueError):
        table.validated(df.drop("atom_count"))


def test_bonds_by_cells_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = {k: rng.uniform(-3, 3, (40, 3)) for k in ("a", None)} | {"one": np.zeros((1, 3)), "same": np.zeros((3, 3)), "odd": np.array([[0, 0, 0], [np.nan, 0, 0], [0.5, 0, np.inf], [0.5, 0, 0]])}
    x["a"] = np.round(x["a"] * 2) / 2
    e = {k: [("C", "H", "Xx", "I")[i % 4] for i in range(len(v))] for k, v in x.items()}
    df = spark.createDataFrame([(k, e[k], v.ravel().tolist()) for k, v in x.items()] + [("none", [], []), ("null", None, None)], "k string, e array<string>, c array<double>")
    far = {k: np.linalg.norm(v[:, None] - v[None], axis=2) for k, v in x.items()}
    pairs = lambda ok: sorted(((k, i, j) for k, d in far.items() for i in range(len(d)) for j in range(i + 1, len(d)) if ok(k, i, j, d[i, j])), key=str)
    got = bonds.near_atoms(bonds.atom_rows(df, ["k"], "c"), ["k"], 1.5).collect()
    assert sorted(((r.k, r.i, r.j) for r in got), key=str) == pairs(lambda k, i, j, d: d < 1.5)
    r = lambda k, i: bonds.COVALENT_RADII.get(e[k][i], bonds.OTHER_RADIUS)
    want = pairs(lambda k, i, j, d: d < (r(k, i) + r(k, j)) * bonds.BOND_TOLERANCE)
    found = {row.k: [(b.i, b.j) for b in row.bonds] for row in bonds.reference_bonds(df, ["k"], "e", "c").collect()}
    assert found == {k: sorted((i, j) for w, i, j in want if w == k) for k in [*x, "none", "null"]}
    with pytest.raises(ValueError):
        bonds.near_atoms(bonds.atom_rows(df, ["k"], "c"), ["k"], 0.0)


def test_bonds(spark):
    pair = spark.createDataFrame([(["C", "C", "H"], [0.0, 0.0, 0.0, 1.4, 0.0, 0.0, 5.0, 0.0, 0.0])], "e array<string>, c array<double>").withColumn("k", F.lit(1))
    assert [tuple(b) for b in bonds.reference_bonds(pair, ["k"], "e", "c").first().bonds] == [(0, 1)]
    frames = spark.createDataFrame([(b, i, [0.0, 0.0, 0.0, 1.4 if i < k else 5.0, 0.0, 0.0]) for b, k in (("x", 5), ("y", 8)) for i in range(10)], "bead_id string, f long, coords array<double>").withColumn("t", F.lit(0))
    first = {r.bead_id: r.first_broken for r in bonds.first_broken_frame(frames, "coords", [(0, 1)], 2.0, "f", ["bead_id"]).collect()}
    assert first == {"x": 5, "y": 8}
    cut = bonds.cut_at_break(frames, bonds.broken("coords", [(0, 1)], 2.0), "f", ["bead_id"], ["t"])
    assert sorted((r.bead_id, r.f) for r in cut.collect()) == [(b, i) for b in "xy" for i in range(5)]
    assert bonds.first_broken_frame(frames, "coords", [(0, 1)], 6.0, "f", ["bead_id"]).first().first_broken is None
    assert not frames.where(bonds.broken("coords", [], 2.0)).collect()
    with pytest.raises(ValueError):
        bonds.frame_range(frames, "f", 3, 2)


CONFIG = {
    "dof": [
        {"name": "phi", "type": "dihedral", "atoms": [0, 1, 2, 3], "domain": [-180, 180], "label": "Phi"},
        {"name": "psi", "type": "dihedral", "atoms": [4, 5, 6, 7], "domain": [-180, 180]},
        {"name": "d", "type": "distance", "atoms": [0, 7], "domain": [0, 10]},
        {"name": "off", "type": "collective", "domain": [0, 1], "enabled": False},
    ],
    "coordinate_pairs": {"pp": {"x": "phi", "y": "psi", "bins": 12}, "pd": {"x": "phi", "y": "d"}},
    "coordinate_transforms": {"phi": 90, "psi": {"shift": None}},
    "clustering": {"algorithm": "grid", "groupby": ["trajectory_id"], "default": {"bin_size": 30.0, "min_count": 2}, "pd": {"bin_size": 60.0}},
    "transitions": {"lag": 1, "dt": 0.5, "temperature": 300.0},
    "plots": {"density": {"bins": 24}},
}


def full(tmp_path, pattern, **kw):
    return CONFIG | {"run_dir": str(tmp_path / "out"), "data": {"path_pattern": pattern}} | kw


def test_config(tmp_path):
    run = config.parse(full(tmp_path, "x"))
    pp, pd_ = run.pairs
    assert pp.periodic and not pd_.periodic and pp.bins == 12 and pd_.bins == 24
    assert pp.x_feature == "phi_shifted" and pp.y_feature == "psi" and pp.title == "Phi vs psi" and pp.state == "state_pp"
    assert config.clustering_of(run.clustering, pd_) == ("grid", {"step": 60.0, "min_count": 2}, ["trajectory_id"])
    assert [d.name for d in run.dofs] == ["phi", "psi", "d"]
    assert config.pair_transforms_of([{"type": "shift_x", "value": 3}, {"type": "fold_sign_symmetry"}]) == [("shift_x", 3.0), ("fold_sign_symmetry", 0.0)]


@pytest.mark.parametrize(
    "change",
    [
        {"run_dir": ""}, {"data": {}}, {"data": {"path_pattern": "x", "format": "pdb"}}, {"data": {"path_pattern": "x", "trajectory_id_pattern": "("}}, {"data": {"path_pattern": "x", "trajectory_id_pattern": "a"}},
        {"data": {"path_pattern": "x", "positions_source": "bead"}}, {"data": {"path_pattern": "x", "format": "hdf5"}, "bond_break": {"enabled": True}}, {"frame_range": {"start_frame": 3, "end_frame": 2}}, {"bond_break": {"enabled": True, "cutoff": 0}},
        {"dof": [{"name": "a", "type": "dihedral", "atoms": [0, 1, 2, 3]}]}, {"dof": [{"name": "a", "type": "spin", "domain": [0, 1]}]}, {"dof": [{"name": "a", "type": "collective", "domain": [0, 1]}], "coordinate_pairs": []},
        {"coordinate_pairs": {"p": {"x": "phi", "y": "nope"}}}, {"coordinate_pairs": {"p": {"x": "phi", "y": "psi", "bins": 1.5}}}, {"coordinate_transforms": {"zzz": 3}},
    ],
)
def test_bad_configs(tmp_path, change):
    with pytest.raises((ValueError, KeyError)):
        config.parse(full(tmp_path, "x") | change)


def test_build_with_beads_breaks_and_cache(spark, tmp_path):
    for bead, k in (("00", 6), ("01", 8)):
        write_xyz(tmp_path / f"run.pos_{bead}.xyz", helix(10, k, int(bead)))
    (tmp_path / "other").mkdir()
    write_xyz(tmp_path / "other" / "run.neg_00.xyz", helix(4))
    cfg = full(tmp_path, str(tmp_path / "**" / "*.xyz"), bond_break={"enabled": True, "cutoff": 3.0}, frame_range={"start_frame": 1})
    cfg["data"] |= {"trajectory_id_pattern": r"^(.+)_\d+$", "bead_id_pattern": r"_(\d+)$"}
    run = config.parse(cfg)
    frames, built = build.coordinate_table(spark, run)
    rows = frames.orderBy("frame_id").collect()
    assert sorted(built) == ["run.neg", "run.pos"]
    assert [(r.trajectory_id, r.bead_id, r.frame_number) for r in rows if r.trajectory_id == "run.pos"] == [("run.pos", b, i) for b in ("00", "01") for i in range(1, 6)]
    assert [r.frame_id for r in rows] == list(range(len(rows))) and len(rows) == 13
    assert frames.columns[:10] == [f.name for f in table.CORE] and {"phi", "phi_shifted", "step_number"} <= set(frames.columns)
    assert rows[0].comment_line == "" and rows[0].global_frame_index == rows[0].frame_id
    assert build.coordinate_table(spark, run)[1] == []
    write_xyz(tmp_path / "other" / "run.neg_00.xyz", helix(5))
    os.utime(tmp_path / "other" / "run.neg_00.xyz", (5, 5))
    assert build.coordinate_table(spark, run)[1] == ["run.neg"]
    states = build.assign_all_states(frames, run)
    assert {"state_pp", "state_pd"} <= set(states.columns)
    matrix, average = build.analyse_transitions(states, run.pairs[1], run.transitions)
    assert "barrier" in matrix.columns and average is not None
    over = build.overlay_table(spark, run, {"path": str(tmp_path / "other" / "*.xyz"), "max_points": 2})
    assert over.count() == 2


@pytest.mark.parametrize("scheme", ["grid", "dbscan"])
def test_command_line(spark, tmp_path, scheme):
    write_xyz(tmp_path / "a.xyz", helix(30))
    cfg = full(tmp_path, str(tmp_path / "*.xyz"), outputs={"save_csv": True, "save_parquet": True})
    cfg["clustering"] = {"algorithm": scheme, "default": {"bin_size": 30.0, "min_count": 2, "eps": 20.0, "min_samples": 3}}
    cfg["scatter_overlays"] = [{"path": str(tmp_path / "*.xyz"), "label": "again", "max_points": 5}]
    run, said = config.parse(cfg), []
    cli.execute(spark, "run-all", run, say=said.append)
    plots = tmp_path / "out" / "plots"
    for name in ("density_pp.png", "states_pp.png", "transition_pp.png", "density_pp.html", "density_pd.html"):
        assert (plots / name).stat().st_size > 100
    assert any("frames" in s for s in said) and (tmp_path / "out" / "coordinates.csv").exists()
    text = (plots / "density_pp.html").read_text()
    data = json.loads(text.split('<script id="data" type="application/json">')[1].split("</script>")[0])
    assert payload.decode_grid(data["counts"]).sum() == 30 and data["xyz"] is None
    records, found = payload.decode_columns(data["frames"]), payload.decode_structures(data["structures"])
    assert {f"{r['xi']}_{r['yi']}" for r in records} == set(found) and len(records) == len(found)
    assert all(r["x"] is not None and r["raw_x"] is not None and r["step_number"] == 10 * r["frame_number"] and r["source_file"] == "a.xyz" for r in records)
    assert {c["key"] for c in data["columns"]} >= {"frame_id", "step_number", "x", "y", "raw_x"} and not {"energy", "bead_id"} & {c["key"] for c in data["columns"]}
    assert [p["current"] for p in data["pages"]] == [True, False] and data["axis_atoms"] == {"x": [0, 1, 2, 3], "y": [4, 5, 6, 7]} and data["periodic"]
    # structures lie on the reference: the same shape as in the file, up to the step
    given = {r["xi"] * 1000 + r["yi"]: helix(30)[r["frame_number"]] for r in records}
    for r in records:
        x = found[f"{r['xi']}_{r['yi']}"][2]
        inside = lambda p: np.linalg.norm(p[:, None] - p[None], axis=2)
        assert np.allclose(inside(x), inside(given[r["xi"] * 1000 + r["yi"]]), atol=4e-3)
    ref = found[data["reference"]][2]
    assert np.allclose(ref.mean(axis=0), 0, atol=1e-3) and all(np.sqrt(((s[2] - ref) ** 2).sum(axis=1).mean()) < 0.15 for s in found.values())
    again: list = []
    cli.execute(spark, "compute-transitions", run, say=again.append)
    assert sum(s.endswith(", kept") for s in again) == 2 and any(s.startswith("transitions: ") for s in again)


def test_every_overlay_point_is_drawn(spark, tmp_path, monkeypatch):
    write_xyz(tmp_path / "a.xyz", helix(3))
    run = config.parse(full(tmp_path, str(tmp_path / "*.xyz")))
    pair = run.pairs[0]
    (x0, x1), (y0, y1) = pair.x_range, pair.y_range
    at = lambda x, y: (F.lit(x0 + x * (x1 - x0)).alias(pair.x_feature), F.lit(y0 + y * (y1 - y0)).alias(pair.y_feature))
    main = spark.range(1).select(*at(0.5, 0.5))
    many = spark.range(0, 30_000, 1, 1).select(*at(0.1, 0.2)).union(spark.range(1).select(*at(0.9, 0.8)))
    other, lacking = spark.range(1).select(*at(0.3, 0.4)), spark.range(1)
    seen = []
    monkeypatch.setattr(png, "write_png", lambda path, rgb: seen.append(rgb))
    outputs.write_density_picture(main, pair, "", points=[many, other, lacking])
    outputs.write_density_picture(main, pair, "")
    h, w, _ = seen[0].shape
    assert png.picture_size(pair.bins, pair.bins) == (w, h)
    for x, y, k in ((0.1, 0.2, 0), (0.9, 0.8, 0), (0.3, 0.4, 1)):
        cx, cy = int(x * (w - 1)), int((1 - y) * (h - 1))
        assert any((seen[0][b, a] == png.OVERLAY_COLOURS[k]).all() for a in (cx - 1, cx, cx + 1) for b in (cy - 1, cy, cy + 1))
    assert 20 <= (seen[0] != seen[1]).any(axis=2).sum() <= 27


ARRAY_FILES = """
import numpy as np


class File(dict):
    def __init__(self, path, mode):
        with np.load(path) as f:
            super().__init__({k: f[k] for k in f.files})

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass
"""


@pytest.fixture(scope="module")
def write_h5(spark, tmp_path_factory):
    """Writes arrays as an HDF5 file; without h5py, an archive of arrays that a stand-in for it reads, in workers too."""
    if importlib.util.find_spec("h5py"):
        import h5py

        def write(path, **arrays):
            with h5py.File(path, "w") as f:
                for k, v in arrays.items():
                    f.create_dataset(k, data=v)

        return write
    module = tmp_path_factory.mktemp("stand-in") / "h5py.py"
    module.write_text(ARRAY_FILES)
    spark.sparkContext.addPyFile(str(module))

    def write(path, **arrays):
        with open(path, "wb") as f:
            np.savez(f, **arrays)

    return write


def test_page_of_hdf5_frames_holds_structures(spark, tmp_path, write_h5, monkeypatch):
    (tmp_path / "sim" / "hdf5").mkdir(parents=True)
    beads = np.random.default_rng(0).normal(size=(5, 2, 3, 3))
    path = str(tmp_path / "sim" / "hdf5" / "t.hdf5")
    write_h5(path, bead_positions=beads, positions=beads.mean(axis=1))
    write_xyz(tmp_path / "sim" / "input.xyz", beads[0, :1], elements=["C", "O", "H"])
    write_xyz(tmp_path / "a.xyz", helix(3))
    run = config.parse(full(tmp_path, str(tmp_path / "*.xyz")))
    pair = run.pairs[0]
    (x0, x1), (y0, y1) = pair.x_range, pair.y_range
    places = [(3, "bead_01", 3), (0, "bead_00", 3), (4, None, 3)]
    rows = [(i, path, "sim", b, n, -1, a, x0 + (i + 0.5) * (x1 - x0) / pair.bins, y0 + 0.5 * (y1 - y0) / pair.bins) for i, (n, b, a) in enumerate(places)]
    frames = spark.createDataFrame(rows, f"frame_id long, source_file string, trajectory_id string, bead_id string, frame_number long, byte_offset long, atom_count long, {pair.x_feature} double, {pair.y_feature} double")
    seen = []
    monkeypatch.setattr(page, "write", lambda path, data: seen.append(data))
    outputs.write_page(frames, pair, run, "")
    want = [beads[3, 1], beads[0, 0], beads[4].mean(axis=0)]
    found = payload.decode_structures(seen[0]["structures"])
    assert list(found) == ["0_0", "1_0", "2_0"] and seen[0]["reference"] == "0_0"
    sides = lambda p: np.linalg.norm(p - np.roll(p, 1, axis=0), axis=1)
    for (comment, elements, got), x in zip(found.values(), want):
        assert comment == "" and elements == ["C", "O", "H"] and np.allclose(sides(got), sides(x), atol=4e-3)
    # elements that differ: texts, as in the files
    mixed = {"0_0": ("", ["C"], np.ones((1, 3))), "0_1": ("", ["O"], np.ones((1, 3)))}
    assert outputs.structure_block(mixed, "0_0") == (None, {k: payload.xyz_text(*s) for k, s in mixed.items()}) and outputs.structure_block({}, None) == (None, None)
    with pytest.raises(Exception, match="frame 9, bead_01"):
        h5.read_frames(frames.limit(1).withColumn("frame_number", F.lit(9))).collect()
    with pytest.raises(Exception, match="3 atoms, 4 in the table"):
        h5.read_frames(frames.limit(1).withColumn("atom_count", F.lit(4))).collect()


def test_command_line_arguments(tmp_path):
    with pytest.raises(SystemExit):
        cli.main(["run-all"])
    (tmp_path / "c.yaml").write_text("run_dir: x\n")
    with pytest.raises(ValueError):
        cli.load(str(tmp_path / "c.yaml"))


@pytest.mark.parametrize("step", [0.001, 0.01, 0.1])
def test_structure_codec(step):
    rng = np.random.default_rng(1)
    given = {f"{i}_{i + 1}": (f"c{i}", ["C", "O", "H"], rng.uniform(-5, 5, (3, 3))) for i in range(20)}
    back = payload.decode_structures(json.loads(json.dumps(payload.encode_structures(given, step))))
    assert list(back) == list(given)
    for k, (c, e, x) in given.items():
        assert back[k][:2] == (c, e) and np.abs(back[k][2] - x).max() <= step / 2 + 1e-12
    assert payload.decode_structures(payload.encode_structures({})) == {}


def test_codec_errors():
    one = {"a": ("", ["C"], [[0, 0, 0]])}
    for step in (0, -1, True, float("nan")):
        with pytest.raises(ValueError):
            payload.encode_structures(one, step)
    with pytest.raises(ValueError):
        payload.encode_structures(one | {"b": ("", ["O"], [[0, 0, 0]])})
    with pytest.raises(ValueError):
        payload.encode_structures({"a": ("", ["C"], [[99, 0, 0]])}, 0.001)
    for bad in (np.zeros(3, int), np.array([[-1]]), np.array([[0.5]])):
        with pytest.raises(ValueError):
            payload.encode_grid(bad)
    for decode in (payload.decode_structures, payload.decode_columns, payload.decode_grid):
        with pytest.raises(ValueError):
            decode({"format": "other"})


def test_column_and_grid_codecs():
    rows = [{"s": "a" if i % 3 else None, "n": i, "u": f"u{i}"} for i in range(12)]
    assert payload.decode_columns(payload.encode_columns(rows)) == rows and payload.decode_columns(payload.encode_columns([])) == []
    for top in (5, 70_000):
        a = np.arange(12).reshape(3, 4) * top
        assert (payload.decode_grid(payload.encode_grid(a)) == a).all()


def test_page_is_deterministic_and_safe(tmp_path):
    data = page.page_data(np.array([[1, 0], [2, 3]]), (0, 1), (0, 1), "</script><b>", ("x", "y"), frames=[{"xi": 0, "yi": 0, "x": 0.1, "y": 0.2, "f": "</script>"}])
    text = page.render(data)
    assert text == page.render(data) and text.count("</script>") == 3
    with pytest.raises(ValueError):
        page.navigation([("a", "A", "a.html"), ("a", "A", "b.html")], "a")
    with pytest.raises(ValueError):
        page.navigation([("a", "A", "x/a.html")], "a")
    with pytest.raises(ValueError):
        page.navigation([("a", "A", "a.html")], "b")
    assert page.private_path("/a/b/c.xyz", "/a") == "b/c.xyz" and page.private_path("/z/c.xyz", "/a") == "c.xyz"


def test_png(tmp_path):
    path = str(tmp_path / "m.png")
    png.write_png(path, png.density_picture(np.array([[0, 5], [1, 0]]), centres=[(0.5, 0.5, 1)], points=[(0.1, 0.9)]))
    assert open(path, "rb").read(8) == b"\x89PNG\r\n\x1a\n"
    assert png.matrix_picture([np.eye(3), np.full((3, 3), np.nan)]).shape[2] == 3


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_store_commits(spark, tmp_path, scheme):
    store = manifest.Store(spark, f"{scheme}{tmp_path}/cache")
    parts = lambda *p: spark.createDataFrame(list(p), "part string, digest string")
    rows = lambda *r: spark.createDataFrame(list(r), "part string, v long")
    one, two = ("a", "1"), ("b", "1")
    assert {r.part for r in store.missing(parts(one, two)).collect()} == {"a", "b"}
    store.write(rows(("a", 1), ("a", 2)), parts(one, two))
    # a part without rows is committed too
    assert store.missing(parts(one, two)).isEmpty() and sorted(r.v for r in store.read(parts(one, two)).collect()) == [1, 2]
    assert store.read(parts(two)).columns == ["v"] and store.read(parts(two)).isEmpty()
    # rows that no commit names aren't read
    rows(("a", 9)).write.partitionBy("part").parquet(f"{scheme}{tmp_path}/cache/rows/version=lost")
    assert [r.v for r in store.read(parts(one)).orderBy("v").collect()] == [1, 2]
    store.write(rows(("a", 7)), parts(("a", "2")))
    assert [r.part for r in store.missing(parts(one, two)).collect()] == ["a"] and [r.v for r in store.read(parts(("a", "2"))).collect()] == [7]
    with pytest.raises(FileNotFoundError, match="'a'"):
        store.read(parts(one))
    for folder in (tmp_path / "cache" / "rows").glob("version=*/part=a"):
        shutil.rmtree(folder)
    assert [r.part for r in store.missing(parts(("a", "2"), two)).collect()] == ["a"]
    with pytest.raises(FileNotFoundError, match="'a'"):
        store.read(parts(("a", "2")))


def test_kept_tables(spark, tmp_path):
    store = manifest.Store(spark, f"file://{tmp_path}/cache")
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert manifest.kept(store, "x", {"a": (1, 2)}, make)[0].count() == 3
    found, old = manifest.kept(store, "x", {"a": (1, 2)}, make)
    assert old and found.count() == 3 and len(made) == 1
    assert not manifest.kept(store, "x", {"a": (1, 3)}, make)[1] and not manifest.kept(store, "y", {"a": (1, 3)}, make)[1]
    assert manifest.part_name("a/b") != manifest.part_name("a_b")
    names = ["a/b", "x" * 99, "ü"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", manifest.part_names(F.col("n"))).collect()
    assert all(r[1] == manifest.part_name(r[0]) for r in got)


def test_cache_by_uri_equals_a_local_one(spark, tmp_path):
    for k in range(3):
        write_xyz(tmp_path / f"t{k}" / "x.xyz", helix(6 + k)) if (tmp_path / f"t{k}").mkdir() is None else None
    cfg = full(tmp_path, str(tmp_path / "t*" / "*.xyz"))
    found = []
    for cache in (f"{tmp_path}/local", f"file://{tmp_path}/uri"):
        run = config.parse(cfg | {"cache": {"trajectory_cache_dir": cache}})
        first, built = build.coordinate_table(spark, run)
        assert len(built) == 3 and build.coordinate_table(spark, run)[1] == []
        found.append(sorted(map(tuple, first.collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) == 6 + 7 + 8
    # a folder that has gone is made again, and only that
    gone = next((tmp_path / "uri" / "trajectories" / "rows").glob("version=*/part=t1-*"))
    shutil.rmtree(gone)
    again, built = build.coordinate_table(spark, run)
    assert built == ["t1"] and sorted(map(tuple, again.collect()), key=repr) == found[0]
    # a trajectory that comes before the others leaves their rows alone
    (tmp_path / "t").mkdir()
    write_xyz(tmp_path / "t" / "x.xyz", helix(2))
    more, built = build.coordinate_table(spark, run)
    assert built == ["t"] and [r.trajectory_id for r in more.orderBy("frame_id").limit(3).collect()] == ["t", "t", "t0"]


def test_hdf5_names():
    assert h5.bead_label(3) == "bead_03" and h5.bead_index("bead_03") == 3
    with pytest.raises(ValueError):
        h5.bead_index("x")


def test_row_numbers_union_and_sample(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = {r.id: r.n for r in table.number_rows(df, ["k", "id"], "n").collect()}
    want = {r.id: i for i, r in enumerate(sorted(df.collect(), key=lambda r: (r.k, r.id)))}
    assert got == want
    assert table.concatenated([spark.range(2).select("id"), spark.range(2).withColumn("x", F.lit(1))]).count() == 4
    a = sorted(r.id for r in table.sample_exact(df, 20, ["id"]).collect())
    assert len(a) == 20 and a == sorted(r.id for r in table.sample_exact(df.repartition(9), 20, ["id"]).collect())
    assert table.sample_exact(df, 5000, ["id"]).count() == 1000
    rec = table.records(spark.createDataFrame([(1, float("nan"), None)], "a long, b double, c string"), "r").first().r
    assert json.loads(rec) == {"a": 1, "b": None, "c": None}


def test_npz_converter(spark, tmp_path):
    from basinflow.sources.convert import npz_to_xyz

    rng = np.random.default_rng(0)
    r = rng.normal(size=(5, 3, 3))
    source, target = str(tmp_path / "a.npz"), str(tmp_path / "a.xyz")
    np.savez(source, z=np.array([6, 8, 1], np.uint8), R=r, E=np.arange(5.0).reshape(5, 1))
    assert npz_to_xyz(source, target, stride=2) == 3
    got = xyz.read_frames(xyz.index_files(spark, [target])).orderBy("frame_number").collect()
    assert got[0].elements == ["C", "O", "H"] and np.allclose([g.coords for g in got], r[::2].reshape(3, -1), atol=1e-5)
    assert xyz.metadata(xyz.index_files(spark, [target])).orderBy("frame_number").collect()[1].step_number == 2
    for bad in ({"stride": 0}, {"sha256": "0"}):
        with pytest.raises(ValueError):
            npz_to_xyz(source, target, **bad)


def structures_of(n, seed=0):
    rng = np.random.default_rng(seed)
    return {f"{i // 5}_{i % 5}": (f"c{i}", ["C", "O", "H"], rng.uniform(-5, 5, (3, 3))) for i in range(n)}


@pytest.mark.skipif(shutil.which("node") is None, reason="needs a JavaScript engine")
def test_the_pages_decoders_equal_ours(tmp_path):
    given = structures_of(23)
    rows = [{"xi": i, "yi": 0, "x": 10.0 * i, "y": 350.0 if i == 2 else 0.0, "name": "ab"[i % 2], "gone": None} for i in range(4)]
    counts = np.array([[1, 70_000], [2, 0]])
    edges = [0.0, 0.02, 0.04, 0.06, 0.08, 0.1]
    values = [0.0, 0.02, 0.0199, 0.06, 0.1, 0.11, -0.1, 0.08]
    ask = {"s": payload.encode_structures(given, 0.01), "c": payload.encode_columns(rows), "g": payload.encode_grid(counts), "edges": edges, "values": values, "xyz": payload.xyz_text(*given["1_1"])}
    script = template.CODEC + """
    (async () => {
      const a = JSON.parse(require("fs").readFileSync(process.argv[2], "utf8"));
      const s = await decodeStructures(a.s), rows = await decodeColumns(a.c), count = decodeGrid(a.g);
      const link = await pinsToLink(["0_0", "11_7"]);
      process.stdout.write(JSON.stringify({
        s: [...s].map(([k, v]) => [k, v.comment, v.elements, [...v.x]]), rows, counts: [[count(0, 0), count(0, 1)], [count(1, 0), count(1, 1)]],
        bins: a.values.map((v) => binOf(v, a.edges)), near: [nearest(rows, 11, 0, 1, 1, false).xi, nearest(rows, 20, -8, 1, 1, true).xi, nearest([], 0, 0, 1, 1, true)],
        link, pins: await pinsFromLink(link), bad: await pinsFromLink("zz"), xyz: writeXyz(parseXyz(a.xyz)),
      }));
    })();
    """
    (tmp_path / "t.js").write_text(script)
    (tmp_path / "a.json").write_text(json.dumps(ask))
    got = json.loads(subprocess.run(["node", str(tmp_path / "t.js"), str(tmp_path / "a.json")], capture_output=True, text=True, check=True, timeout=60).stdout)
    for (key, comment, elements, x), (k, (c, e, y)) in zip(got["s"], given.items()):
        assert (key, comment, elements) == (k, c, e) and np.allclose(np.reshape(x, (3, 3)), y, atol=0.005 + 1e-9)
    assert got["rows"] == rows and got["counts"] == counts.tolist()
    assert got["bins"] == [0, 1, 0, 3, 4, -1, -1, 4] and got["near"] == [1, 2, None]
    assert got["pins"] == ["0_0", "11_7"] and got["bad"] == [] and got["xyz"] == ask["xyz"] and not set("+/=") & set(got["link"])
    view = template.PAGE.split("<script>")[1].split("</script>")[0]
    (tmp_path / "v.js").write_text(template.CODEC + view.replace('"use strict";', ""))
    subprocess.run(["node", "--check", str(tmp_path / "v.js")], check=True, timeout=60)


def test_colours_and_ticks():
    assert palette.contrast(palette.WHITE, (0, 0, 0)) == pytest.approx(21.0) and palette.contrast((9, 9, 9), (9, 9, 9)) == 1.0
    many = palette.categories(12)
    assert len(set(many)) == 12 and all(palette.contrast(palette.legible(c), c) >= 4.5 for c in many)
    scale = palette.trimmed(palette.SCALE, palette.WHITE)
    assert len(scale) == len(palette.SCALE) and scale[0] == palette.SCALE[0] and all(palette.contrast(c, palette.WHITE) >= 1.2 for c in scale)
    assert palette.trimmed([palette.WHITE, palette.WHITE], palette.WHITE) == [palette.WHITE, palette.WHITE]
    assert palette.ticks(-180, 180, True) == [45.0 * k for k in range(-4, 5)]
    assert palette.ticks(0, 0.1, False) == [0.0, 0.02, 0.04, 0.06, 0.08, 0.1] and palette.css((255, 0, 16)) == "#ff0010"


def test_pictures_in_memory_and_labels():
    counts = np.array([[0, 5], [1, 0]])
    data = png.density_png(counts, centres=[(0.5, 0.5, 1, "12")])
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and data == png.encode(png.density_picture(counts, centres=[(0.5, 0.5, 1, "12")])) != png.density_png(counts)
    m = np.array([[0.5, np.nan], [0.25, 1e-7]])
    plain, labelled = png.matrix_picture([m]), png.matrix_picture([m, m], ["count", "rate"], ["0", "state b"])
    assert labelled.shape[0] > plain.shape[0] and labelled.shape[1] > 2 * plain.shape[1]
    big = np.eye(11)
    assert (png.matrix_picture([big], labels=[str(i) for i in range(11)])[18 : 18 + 11 * 22, -11 * 22 - 12 :].reshape(-1, 3) != 0).any()
    assert (png.text_mask("1A?").sum() > 0) and png.text_mask("").shape == (10, 0)
    small = np.full((4, 4, 3), 255, np.uint8)
    png.draw_text(small, -3, -3, "88")
    png.draw_text(small, 3, 3, "88")
    assert (small != 255).any()


def test_stage_timer():
    timer = timing.StageTimer()
    with timer.stage("a", items=10):
        pass
    with pytest.raises(KeyError), timer.stage("b"):
        raise KeyError
    with timer.stage("a"):
        pass
    assert timer.calls == {"a": 2, "b": 1} and timer.items == {"a": 10, "b": 0} and timer.total == sum(timer.seconds.values())
    assert len(timer.report()) == 2 and any("us each of 10" in line for line in timer.report())


def test_discovery_by_uri(tmp_path):
    for name in ("a/x.xyz", "a/b/y.xyz", "a/b/z.txt", "c/w.xyz"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("0\n\n")
    root = f"file://{tmp_path}"
    assert discover(f"{root}/**/*.xyz") == [f"{root}/a/b/y.xyz", f"{root}/a/x.xyz", f"{root}/c/w.xyz"]
    assert discover(f"{root}/a/*.xyz") == [f"{root}/a/x.xyz"] and discover(f"{root}/c/w.xyz") == [f"{root}/c/w.xyz"]
    assert discover(f"{root}/a/b/?.txt") == [f"{root}/a/b/z.txt"]
    with pytest.raises(FileNotFoundError):
        discover(f"{root}/nothing/*.xyz")


def test_atom_lines_of_any_width(tmp_path):
    import io

    good = b"2\nc\nC 1 2 3\nHe  4.5\t-5 6e1\n"
    wide = b"2\nc\nC 1 2 3 0.1 F\nHe 4.5 -5 6e1 0.2 T\n"
    mixed = b"2\nc\nC 1 2 3\nHe 4.5 -5 6e1 extra more\n"
    uneven = b"3\nc\nC 1 2 3 4\nC 1 2 3\nC 1 2 3 4 5 6\n"
    for data in (good, wide, mixed):
        atoms, comment, elements, x = xyz.parse_frame(io.BytesIO(data), "f")
        assert (atoms, comment, elements, x.tolist()) == (2, "c", ["C", "He"], [[1, 2, 3], [4.5, -5, 60]]) and x.dtype == np.float32
    assert xyz.parse_frame(io.BytesIO(uneven), "f")[3].tolist() == [[1, 2, 3]] * 3
    assert xyz.parse_frame(io.BytesIO(b"0\n\n"), "f")[2:][0] == []
    for bad, what in ((b"2\nc\nC 1 2 3\nC 1 2\n", "line 2 has fewer"), (b"1\nc\nC 1 x 3\n", "no numbers"), (b"2\nc\nC 1 2 3\n", "line 2 has fewer")):
        with pytest.raises(ValueError, match=what):
            xyz.parse_frame(io.BytesIO(bad), "f")


def test_structures_laid_on_a_reference_at_once():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(7, 5, 3))
    got, rmsd = structures.superpose_all(x, x[3], np.array([0, 1, 2, 4]))
    for i in range(7):
        one, r = structures.superpose(x[i], x[3], np.array([0, 1, 2, 4]))
        assert np.allclose(got[i], one) and np.isclose(rmsd[i], r)


def test_a_run_whose_frames_are_all_cut(spark, tmp_path):
    x = helix(3)
    write_xyz(tmp_path / "a.xyz", x)
    run = config.parse(full(tmp_path, str(tmp_path / "*.xyz"), bond_break={"enabled": True, "cutoff": 0.1}))
    frames, built = build.coordinate_table(spark, run)
    assert frames.count() == 0 and len(built) == 1 and "phi_shifted" in frames.columns and build.coordinate_table(spark, run)[1] == []
    assert build.table_key(spark, run) == build.table_key(spark, run)


@pytest.mark.parametrize("split", [90, 400])
def test_split_index_equals_one_pass(spark, tmp_path, split):
    """Also with blank lines, comments that look like counts, frames without atoms and ones longer than splits."""
    rng = np.random.default_rng(split)
    paths = []
    for k in range(3):
        out = []
        for i in range(split // 20):
            n = int(rng.choice([0, 1, 3, 4, 40])) if k else 4
            # a comment that counts the atoms behind the first: such a frame hides a likely one
            comment = ("3" if n == 4 else str(max(0, n - 1))) if rng.random() < 0.3 else f"# Step: {i}"
            atoms = [f"{rng.choice(['C', '12', 'H'])} {i} {j} 3" for j in range(n)]
            out += [str(n), comment, *atoms, *[""] * int(rng.integers(3) * (k > 0))]
        path = tmp_path / f"f{k}.xyz"
        path.write_text(("\n\n" if k == 2 else "") + "\n".join(out) + "\n" * (k < 2))
        paths.append(str(path))
    (tmp_path / "none.xyz").write_text("\n")
    got = xyz.index_files(spark, [*paths, str(tmp_path / "none.xyz")], split).select("source_file", "frame_number", "byte_offset", "atom_count", "comment_line").collect()
    want = []
    for p in paths:
        with open(p, "rb") as f:
            want += [(p, *row[:4]) for row in xyz.scan(f, p)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_split_index_reports_damage(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("1\nc\nC 1 2 3\nx\nc\nC 1 2 3\n1\nc\nC 1 2 3\n")
    with pytest.raises(Exception, match="no atom count at byte 12"):
        xyz.index_files(spark, [str(tmp_path / "a.xyz")], 10).collect()
