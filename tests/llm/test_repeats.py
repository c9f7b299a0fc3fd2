import numpy as np
import pyarrow as pa
import pytest

from basinflow.llm import repeats
from basinflow.llm.run_index import PAD


def brute(rows, span):
    """(n_bytes, removed ranges, kept) of each (id, text) row."""
    low = {}
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for i, b in bodies:
        for p in range(len(b) - span + 1) if i is not None else ():
            w = b[p : p + span]
            low[w] = min(i, low.get(w, i))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - span + 1) if i is not None else ():
            if low[b[p : p + span]] < i:
                gone[p : p + span] = b"\1" * span
        edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(gone) + b"\0", np.uint8).astype(int)))
        out.append((i, len(b), tuple(zip(edges[::2].tolist(), edges[1::2].tolist())), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect()), key=repr)


def corpus(seed, n, letters="abé語"):
    rng = np.random.default_rng(seed)
    draw = lambda k: "".join(rng.choice(list(letters), k))
    passages = [draw(int(k)) for k in rng.integers(10, 120, 12)]
    out = []
    for i in range(n):
        text = "".join(passages[rng.integers(12)][int(rng.integers(5)) :] if rng.random() < 0.6 else draw(int(rng.integers(60))) for _ in range(rng.integers(6)))
        out.append((int(rng.integers(2 * n)), text))
    return out


@pytest.mark.parametrize("span, key, seed, common", [(50, 20, 1, 1 << 14), (24, 8, 2, 4), (40, 12, 3, 2), (50, 20, 5, 12)])
def test_against_brute_force(spark, span, key, seed, common):
    rows = corpus(seed, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = found(repeats.find_repeats(docs, span=span, key=key, part_bytes=2_000, common=common))
    want = brute(rows, span)
    assert got == want and any(r[2] for r in want)


def test_odd_rows(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    extra = [(9, "repeated row of a few words, and more of them than fifty bytes hold"), (9, "repeated row of a few words, and more of them than fifty bytes hold"), (10, "x" * 200), (11, "x" * 130), (12, "y" * 49), (13, "y" * 49), (14, "z" * 50), (15, "z" * 50)]
    docs = odd_documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i, t, "kept") for i, t in extra], "doc_id long, text string, lang string"))
    docs = docs.withColumns({c: docs["lang"] for c in ("part", "body", "spans", "kept", "id")})
    got = repeats.find_repeats(docs, part_bytes=10_000)
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept"]
    long = dict(rows)[5]
    by_id = {}
    for r in found(got):
        by_id.setdefault(r[0], []).append(r)
    # the long text is too much for the brute force: its copy keeps what comes after it, but for a blank that follows the same words earlier too
    assert long[-49:] + " " in long and long[-48:] + " t" not in long
    assert by_id[6] == [(6, len(long) + 5, ((0, len(long) + 1),), b"tail")]
    small = [r for r in rows + extra if r[0] not in (5, 6)]
    assert sorted((r for i, rs in by_id.items() if i not in (5, 6) for r in rs), key=repr) == brute(small, 50)


def test_empty_table(spark):
    assert repeats.find_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_windows_have_equal_keys():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    shift = np.concatenate([rng.integers(97, 100, 700).astype(np.uint8), text])
    a, b = (repeats.keys_of(d, np.array([0, len(d)]), 50, 20) for d in (text, shift))
    inner = a[0][(a[0] >= 50) & (a[0] < 2950)]
    assert np.isin(inner + 700, b[0]).all() and len(a[0]) < 3000 / 8


def test_keys_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(9)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    offsets = np.sort(np.concatenate([[0, 5000], rng.integers(0, 5000, 40)]))
    whole = repeats.keys_of(data, offsets, 50, 20)
    monkeypatch.setattr(repeats, "_SLICE", 173)
    cut = repeats.keys_of(data, offsets, 50, 20)
    assert all((x == y).all() for x, y in zip(whole, cut))


@pytest.mark.parametrize("at_most", [1, 3, 10_000])
def test_large_groups_are_split(at_most):
    rng = np.random.default_rng(3)
    base = rng.integers(97, 99, 80).astype(np.uint8)
    strings = np.repeat(base[None, :], 60, axis=0)
    for row in strings:
        side = rng.integers(2)
        row[slice(0, rng.integers(30)) if side else slice(50 + rng.integers(30), 80)] = rng.integers(97, 99)
    strings[:5, :20] = PAD
    docs = rng.integers(0, 30, 60)
    got = repeats.seen_before(strings, np.zeros(60, np.int64), docs, 50, at_most)
    for s, d, bits in zip(strings, docs, got):
        for w in range(31):
            if PAD not in s[w : w + 50]:
                assert bool(bits >> w & 1) == any(o < d and (t[w : w + 50] == s[w : w + 50]).all() for t, o in zip(strings, docs))


def test_part_without_text():
    p = repeats.Part(pa.table({"id": pa.array([1, None]), "body": pa.array([b"", b""])}), 3, 50, 20)
    assert len(p.places) == 0 and len(p.first) == 0
