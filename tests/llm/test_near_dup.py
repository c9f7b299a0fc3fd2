import random

import numpy as np
import pytest
from shingle_brute import brute

from basinflow.llm import hashing, near_dup
from basinflow.llm.common import Scratch
from basinflow.llm.components import components


def expected(rows, n, percent=80):
    sets = [brute(t, n) for _, t in rows]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            k = len(sets[a] & sets[b])
            if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), True if i is None else find(i) == i) for (i, _), s in zip(rows, sets)), key=str)


def corpus(seed, n=300, ids=None):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.randint(0, 60))] for _ in range(20)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 0, 1, 2, 3, 6])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i if ids is None else rng.randrange(ids), " ".join(w)))
    return rows


@pytest.mark.parametrize("n, ids", [(2, None), (5, None), (2, 150)])
def test_classes_equal_brute_force(spark, n, ids):
    rows = corpus(n, ids=ids) + [(None, "a b c d e f"), (None, None), (7, None), (900, ""), (901, "x"), (902, "X"), (903, "x y"), (904, "x  y")] + [(905, "p q r s t u v w")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dup.near_duplicates(df, shingle_words=n).collect()), key=str) == expected(rows, n)


def test_far_copies_of_one_base_join_through_it(spark):
    """A star: copies near the base but not near each other, in one hot bucket."""
    base = [f"w{i}" for i in range(100)]
    rng = random.Random(1)
    rows = [(1000, " ".join(base))]
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(100), 4):
            w[j] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dup.near_duplicates(df, shingle_words=2).collect()), key=str) == expected(rows, 2)


def test_tiles_of_one_member_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 3)
    rows = corpus(11, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dup.near_duplicates(df, shingle_words=2, percent=70).collect()), key=str) == expected(rows, 2, 70)


def test_a_pair_below_the_threshold_is_told_once(spark, monkeypatch, tmp_path):
    """Texts alike but not linked share many bands: a row for each pair at most, not one for each band and direction."""
    made, told = near_dup._near_components, str(tmp_path / "told")

    def counted(percent):
        run = made(percent)

        def wrapped(batches):
            for batch in run(batches):
                with open(told, "a") as f:
                    f.write(f"{batch.num_rows}\n")
                yield batch

        return wrapped

    monkeypatch.setattr(near_dup, "_near_components", counted)
    monkeypatch.setattr(near_dup, "TILE", 16)
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(i, base + "".join(f" x{i}_{j}" for j in range(18))) for i in range(70)]
    # a component of several texts outside of most buckets' largest one
    rows += [(100 + i, f"{rows[7][1]} y{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dup.near_duplicates(df, shingle_words=2).collect()), key=str) == expected(rows, 2)
    with open(told) as f:
        assert 1000 < sum(map(int, f)) <= len(rows) * (len(rows) - 1) // 2


@pytest.mark.parametrize("ids", [None, 12])
def test_texts_of_one_id_are_dealt_to_tiles(spark, monkeypatch, ids):
    """Tiles of a few texts, also where most rows share one id."""
    monkeypatch.setattr(near_dup, "TILE", 3)
    monkeypatch.setattr(near_dup, "TILE_BYTES", 400)
    rows = [(5 if k % 3 else i, t) for k, (i, t) in enumerate(corpus(17, 150, ids))] + [(800, "a b c d e f g h i j"), (801, "a b c d e f g h i j k"), (802, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dup.near_duplicates(df, shingle_words=2).collect()), key=str) == expected(rows, 2)


def test_odd_rows_and_empty_table(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = near_dup.near_duplicates(odd_documents, shingle_words=2)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, 2)
    assert near_dup.near_duplicates(odd_documents.limit(0)).collect() == []
    with pytest.raises(ValueError):
        near_dup.near_duplicates(odd_documents, percent=10)


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for shared in (0, 500, 900):
        a, b = pool[:1000], np.concatenate([pool[:shared], pool[1000 : 2000 - shared]])
        true = shared / (2000 - shared)
        got = near_dup.estimate(near_dup.registers(a)[None], near_dup.registers(b)[None], near_dup.collision_rate())[0, 0]
        assert abs(got - true) < 0.15
    assert 0 < near_dup.collision_rate() < 0.01


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent if find(x) != x}
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.root for r in components(df, Scratch(spark, "test")).collect()} == want
    assert components(df.limit(0), Scratch(spark, "test")).collect() == []


@pytest.mark.parametrize("size", [1, 4, 12, 60, 200, 700, 20_000])
def test_registers_agree_with_similarity_at_every_size(size):
    rng = np.random.default_rng(size)
    rate, missed, tries = [], 0, 400 if size < 5000 else 40
    for _ in range(tries):
        every = hashing.distinct(hashing.mix(rng.integers(1, 1 << 63, size + size // 4, dtype=np.uint64)))
        cut = max(1, size // 8)
        a, b = (every, every) if size < 4 else (every[np.sort(rng.permutation(len(every))[cut:])], every[np.sort(rng.permutation(len(every))[cut:])])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        ra, rb = near_dup.registers(a), near_dup.registers(b)
        assert len(ra) == near_dup.REGISTERS
        got = near_dup.estimate(ra[None], rb[None], near_dup.collision_rate())[0, 0]
        rate.append(got - j)
        missed += j >= 0.8 and not (near_dup.band_keys(ra) == near_dup.band_keys(rb)).any()
    assert abs(np.mean(rate)) < 4 * 0.4 / np.sqrt(near_dup.REGISTERS * tries) + 0.004 and np.std(rate) < 0.045
    assert missed == 0


def test_registers_of_disjoint_sets_agree_by_chance_alone():
    rng = np.random.default_rng(1)
    for n in (2, 30, 150, 3000):
        agree = []
        for _ in range(200):
            a, b = (hashing.distinct(hashing.mix(rng.integers(1, 1 << 63, n, dtype=np.uint64))) for _ in range(2))
            agree.append((near_dup.registers(a) == near_dup.registers(b)).mean())
        assert np.mean(agree) < 3 * near_dup.collision_rate() + 1e-4
