import math

import pytest

from basinflow.operators import transitions


def frames(spark, *groups, noise="noise"):
    rows = []
    for g, seq in enumerate(groups):
        rows += [("t", f"{g:02d}", i, s if s != "-" else noise) for i, s in enumerate(seq)]
    return spark.createDataFrame(rows, "trajectory_id string, bead_id string, f long, s string")


GROUP = ["trajectory_id", "bead_id"]


def counted(spark, seq, **kw):
    return {r.src + r.dst: r["count"] for r in transitions.counts(frames(spark, seq), "s", "f", GROUP, **kw).collect()}


def test_lags(spark):
    assert counted(spark, "ABABA") == {"AB": 2, "BA": 2}
    assert counted(spark, "ABABA", lag=2) == {"AA": 2, "BB": 1}
    with pytest.raises(ValueError):
        counted(spark, "AB", lag=0)


def test_noise_bridged_or_not(spark):
    assert counted(spark, "A-B") == {"AB": 1}
    assert counted(spark, "A-B", bridge_noise=False) == {}
    assert counted(spark, "A-AB", bridge_noise=False) == {"AB": 1}
    assert counted(spark, "AA-BB-A") == {"AA": 1, "AB": 1, "BB": 1, "BA": 1}
    assert counted(spark, "00000-11111-00000") == {"00": 8, "11": 4, "01": 1, "10": 1}


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("lag", [1, 2, 5])
@pytest.mark.parametrize("bridge", [True, False])
def test_chunks_change_nothing(spark, chunk, lag, bridge):
    seq = "AB-CABBA--CAACB-ABCCBA"
    rows = [s for s in seq if s != "-"] if bridge else list(seq)
    want: dict = {}
    for a, b in zip(rows, rows[lag:]):
        if "-" not in (a, b):
            want[a + b] = want.get(a + b, 0) + 1
    assert counted(spark, seq, lag=lag, bridge_noise=bridge, chunk_frames=chunk) == want


def test_order_is_by_frame_not_by_row(spark):
    df = spark.createDataFrame([("t", None, i, s) for i, s in zip([2, 0, 1], "BAB")], "trajectory_id string, bead_id string, f long, s string")
    assert {r.src + r.dst: r["count"] for r in transitions.counts(df, "s", "f", GROUP).collect()} == {"AB": 1, "BB": 1}


def test_dense_probabilities_and_empty_rows(spark):
    m = transitions.analyse(frames(spark, "AB"), "s", "f", GROUP, dt=0.5)
    got = {r.src + r.dst: (r["count"], r.probability, r.rate) for r in m.collect()}
    assert got == {"AA": (0, 0, 0), "AB": (1, 1, 2), "BA": (0, None, None), "BB": (0, None, None)}
    for bad in (lambda: transitions.rates(m, 0.0), lambda: transitions.rates(m, 1.0, 0)):
        with pytest.raises(ValueError):
            bad()


def _rates(spark, rate):
    return spark.createDataFrame([("A", "B", rate), ("A", "A", rate), ("B", "A", 0.0), ("B", "B", math.nan)], "src string, dst string, rate double")


@pytest.mark.parametrize("rate, options, want", [(2.0, {}, 0.743778), (1e6, {"model": "arrhenius", "attempt_frequency": 1e12, "conversion": 96.48533212}, 34.460564), (1e9, {"model": "arrhenius", "attempt_frequency": 1e6}, -0.178579)])
def test_barriers(spark, rate, options, want):
    got = {r.src + r.dst: r.barrier for r in transitions.barriers(_rates(spark, rate), 300.0, **options).collect()}
    assert got["AB"] == pytest.approx(want, abs=1e-5)
    assert got["AA"] is None and got["BA"] is None and got["BB"] is None


def test_barrier_settings_are_checked(spark):
    for options in ({"model": "other"}, {"model": "arrhenius"}, {"transmission": 0.0}):
        with pytest.raises(ValueError):
            transitions.barriers(_rates(spark, 1.0), 300.0, **options)
    with pytest.raises(ValueError):
        transitions.barriers(_rates(spark, 1.0), 0.0)


def test_averages_over_beads(spark):
    f = frames(spark, "ABA", "ACA")
    m = transitions.analyse(f, "s", "f", GROUP, dt=1.0)
    avg = {r.src + r.dst: r for r in transitions.averages(f, m, GROUP, "bead_id", temperature=300.0).collect()}
    assert len(avg) == 9
    assert [avg[k]["count"] for k in ("AB", "AC", "BA", "CA")] == [0.5] * 4
    assert [avg[k].probability for k in ("AB", "AC", "BA", "CA")] == [0.5, 0.5, 1.0, 1.0]
    assert avg["BC"].probability == 0.0 and avg["AB"].rate == 0.5
    assert avg["AB"].barrier is not None and avg["BC"].barrier is None


def test_average_of_a_row_without_counts(spark):
    # B is a destination only in the second bead: its row is null for its own states, 0 for those it lacks
    f = frames(spark, "ABCA", "AB")
    m = transitions.analyse(f, "s", "f", GROUP, dt=1.0)
    avg = {r.src + r.dst: r.probability for r in transitions.averages(f, m, GROUP, "bead_id").collect()}
    assert avg["BC"] == 0.5 and avg["BA"] == 0.0 and avg["AB"] == 1.0


def test_members_without_pairs_count(spark):
    f = frames(spark, "AB", "A")
    m = transitions.analyse(f, "s", "f", GROUP)
    avg = {r.src + r.dst: r["count"] for r in transitions.averages(f, m, GROUP, "bead_id").collect()}
    assert avg["AB"] == 0.5


def test_wide(spark):
    m = transitions.analyse(frames(spark, "ABA"), "s", "f", GROUP)
    rows = {r.src: (r.A, r.B) for r in transitions.wide(m, GROUP, "count", ["A", "B"]).collect()}
    assert rows == {"A": (0, 1), "B": (1, 0)}
