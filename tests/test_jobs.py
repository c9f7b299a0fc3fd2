"""The jobs on copies of small tables: growing input, repeated and broken runs, odd rows."""

import json
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from basinflow.operators import transitions as operators
from jobs import catalog, landscape, transitions

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CONFIG = {"group": {"run": "run", "bead": "bead"}, "order": "step", "state": "state", "chunk_frames": 10, "lag": 2, "dt": 0.5, "partition_by": "bead"}
SCHEMA = "run string, bead int, step long, state string, extra string"


def frames(steps, runs=("a", "b")):
    states = ["1", "2", "noise", "2", "3", None, "1"]
    return [(r, b, s, states[(s * 3 + len(r) + (b or 0) + s * s) % 7], "x") for r in runs for b in (0, 1, None) for s in steps]


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def matrix(spark, target):
    schema = spark.createDataFrame([], SCHEMA).schema
    return sorted((tuple(r) for r in transitions.read_matrix(spark, str(target), schema, CONFIG).collect()), key=repr)


def whole(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).dropDuplicates()
    got = operators.analyse(df, "state", "step", ["run", "bead"], lag=2, dt=0.5)
    return sorted((tuple(r) for r in got.select("run", "bead", "src", "dst", "count", "probability", "rate").collect()), key=repr)


def test_growing_input_takes_only_what_is_new(spark, tmp_path):
    source, target, marks = (f"{tmp_path}/{n}" for n in ("in", "out", "marks"))
    parts = [frames(range(0, 37)), frames(range(60, 95)), frames(range(37, 60)), frames(range(30, 45), ("a", "cc"))]
    for k, part in enumerate(parts):
        put(spark, source, part)
        log = transitions.run(spark, source, target, marks, CONFIG)
        assert log["read"] == len(part)
        # the third part fills a gap, the last repeats frames that were there
        assert matrix(spark, target) == whole(spark, sum(parts[: k + 1], []))
    before = sorted(os.listdir(f"{target}/frames"))
    again = transitions.run(spark, source, target, marks, CONFIG)
    assert again["read"] == again["summaries"] == 0 and sorted(os.listdir(f"{target}/frames")) == before
    assert matrix(spark, target) == whole(spark, sum(parts, []))


def test_chunks_without_new_frames_stay(spark, tmp_path):
    source, target, marks = (f"{tmp_path}/{n}" for n in ("in", "out", "marks"))
    put(spark, source, frames(range(0, 35)))
    transitions.run(spark, source, target, marks, CONFIG)
    kept = {f: os.stat(f"{target}/summaries/chunk=1/{f}").st_mtime_ns for f in os.listdir(f"{target}/summaries/chunk=1")}
    put(spark, source, frames(range(35, 38)))
    transitions.run(spark, source, target, marks, CONFIG)
    assert kept == {f: os.stat(f"{target}/summaries/chunk=1/{f}").st_mtime_ns for f in os.listdir(f"{target}/summaries/chunk=1")}


def test_a_run_after_a_failure_gives_the_same(spark, tmp_path, monkeypatch):
    source, target, marks = (f"{tmp_path}/{n}" for n in ("in", "out", "marks"))
    rows = frames(range(0, 25))
    put(spark, source, rows)

    def broken(*a, **k):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(operators, "summaries", broken)
        with pytest.raises(Exception, match="lost"):
            transitions.run(spark, source, target, marks, CONFIG)
    transitions.run(spark, source, target, marks, CONFIG)
    assert matrix(spark, target) == whole(spark, rows)


def test_a_chunk_is_one_file_and_the_matrix_is_made_when_summaries_change(spark, tmp_path, monkeypatch):
    """As many tasks as on larger input; files must not be their product with chunks."""
    source, target, marks = (f"{tmp_path}/{n}" for n in ("in", "out", "marks"))
    put(spark, source, frames(range(0, 45), [f"r{i}" for i in range(8)]))
    set_ = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in set_}
    try:
        for k, v in set_.items():
            spark.conf.set(k, v)
        transitions.run(spark, source, target, marks, CONFIG)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {c: sum(f.endswith(".parquet") for f in os.listdir(f"{target}/summaries/{c}")) for c in os.listdir(f"{target}/summaries") if c.startswith("chunk=")} == {f"chunk={c}": 1 for c in range(5)}

    def made():
        return {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{target}/matrix") for f in names if f.startswith("part-")}

    before = made()
    rows = spark.read.parquet(f"{target}/matrix").count()
    assert transitions.run(spark, source, target, marks, CONFIG) == {"read": 0, "summaries": 0, "matrix": rows} and made() == before
    # other settings of the matrix make it anew, and so does a run after one that lost it
    transitions.run(spark, source, target, marks, {**CONFIG, "dt": 0.25})
    assert made().keys().isdisjoint(before)
    put(spark, source, more := frames(range(40, 60), ["r0"]))

    def broken(*a, **k):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(operators, "matrices", broken)
        with pytest.raises(Exception, match="lost"):
            transitions.run(spark, source, target, marks, CONFIG)
    assert transitions.run(spark, source, target, marks, CONFIG)["read"] == 0
    assert matrix(spark, target) == whole(spark, frames(range(0, 45), [f"r{i}" for i in range(8)]) + more)


def test_of_two_states_of_a_frame_the_smaller_stays(spark, tmp_path):
    source, target, marks = (f"{tmp_path}/{n}" for n in ("in", "out", "marks"))
    rows = [("a", 0, s, str(s % 3), "x") for s in range(25)]
    put(spark, source, rows + [("a", 0, 4, None, "x"), ("a", 0, 5, "9", "y"), ("a", 0, 20, None, None)])
    put(spark, source, [("a", 0, 5, "7", "z"), ("a", 0, 6, "0", "x")])
    transitions.run(spark, source, target, marks, CONFIG)
    assert matrix(spark, target) == whole(spark, rows)


def test_transitions_of_nothing_and_of_odd_rows(spark, tmp_path):
    source, target, marks = (f"{tmp_path}/{n}" for n in ("in", "out", "marks"))
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    assert transitions.run(spark, source, target, marks, CONFIG)["matrix"] == 0
    put(spark, source, [(None, None, None, "1", "x"), (None, 1, 3, "1", None), (None, 1, 4, "2", None), (None, 1, 5, "2", None)])
    transitions.run(spark, source, target, marks, CONFIG)
    assert [r[:5] for r in matrix(spark, target) if r[4]] == [(None, 1, "1", "2", 1)]


@pytest.mark.parametrize("bridge", [True, False])
@pytest.mark.parametrize("lag", [1, 2, 3, 4, 5])
def test_summaries_merge_to_a_full_count(spark, lag, bridge):
    """Summaries made of chunks apart equal one count of all frames, whatever the chunk's size."""
    rows = spark.createDataFrame(frames(range(0, 48)), SCHEMA)
    group = ["run", "bead"]
    full = {tuple(r) for r in operators.counts(rows, "state", "step", group, lag=lag, bridge_noise=bridge).collect()}
    for size in (3, 16):
        apart = [operators.summaries(rows.where(F.floor(F.col("step") / size) % 2 == k), "state", "step", group, lag=lag, bridge_noise=bridge, chunk_frames=size) for k in (0, 1)]
        assert {tuple(r) for r in operators.merged(apart[0].unionByName(apart[1]), group).collect()} == full


LAND = {"group": ["kind"], "order": ["id"], "x": "x", "y": "length(text)", "x_domain": [0.0, 10.0], "y_domain": [0.0, 6.0], "x_step": 1.0, "y_step": 2.0, "min_count": 2}


def test_landscape_runs_again_with_the_same_result(spark, tmp_path):
    rows = [("a", i, float(i % 4), "word"[: i % 5], None) for i in range(60)] + [("b", 1, 3.0, "x", 1), ("b", 2, None, "x", 2), (None, 3, 4.0, None, 3), (None, 4, 4.5, "", 4), (None, 4, 4.5, "", 4), ("c", None, 99.0, "xy", 5)]
    spark.createDataFrame(rows, "kind string, id long, x double, text string, count int").write.parquet(f"{tmp_path}/in")
    got = []
    for _ in range(2):
        assert landscape.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/work", LAND)["read"] == len(rows)
        out = landscape.read_landscape(spark, f"{tmp_path}/in", f"{tmp_path}/out", LAND)
        got.append(sorted(tuple(r) for r in out.where("kind is not null").collect()) + [tuple(r) for r in out.where("kind is null").collect()])
    assert got[0] == got[1]
    assert (None, 4, 0, 2, 4, 4.5, 0.0, 0.0, "0") in got[0]
    assert ("b", 3, 0, 1, 1, 3.0, 1.0, 0.0, "noise") in got[0] and not any(r[0] == "c" for r in got[0])
    assert sum(r[3] for r in got[0] if r[0] == "a") == 60


def test_landscape_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "kind string, id long, x double, text string").write.parquet(f"{tmp_path}/in")
    assert landscape.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/work", LAND) == {"read": 0, "written": 0}
    assert landscape.read_landscape(spark, f"{tmp_path}/in", f"{tmp_path}/out", LAND).count() == 0


def test_command_line(tmp_path):
    """In a process and a session of its own, from a JSON source."""
    os.makedirs(f"{tmp_path}/in")
    with open(f"{tmp_path}/in/one.json", "w", encoding="utf-8") as f:
        f.writelines(json.dumps({"run": "a", "bead": 0, "step": s, "state": str(s % 2)}) + "\n" for s in range(6))
    with open(f"{tmp_path}/config.json", "w", encoding="utf-8") as f:
        json.dump({**CONFIG, "format": "json", "schema": "run string, bead int, step long, state string", "lag": 1}, f)
    args = [x for n, p in (("source", "in"), ("target", "out"), ("checkpoint", "marks"), ("config", "config.json")) for x in (f"--{n}", f"{tmp_path}/{p}")]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "jobs.transitions", *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "6 rows read" in done.stderr
    found = duckdb.sql(f"select src, dst, count from '{tmp_path}/out/matrix/*/*.parquet' where count > 0 order by src").fetchall()
    assert found == [("0", "1", 3), ("1", "0", 2)]
    shutil.rmtree(f"{tmp_path}/out")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = catalog.queries()[name](spark, sf)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    key = sorted(names)
    assert sorted(repr([r[c] for c in key]) for r in got.collect()) == sorted(repr([dict(zip(names, r))[c] for c in key]) for r in want.fetchall())
