import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from shingle_brute import brute

from basinflow.llm import hashing


@pytest.fixture(params=[40, 1 << 18])
def group_bytes(request, monkeypatch):
    monkeypatch.setattr(hashing, "GROUP_BYTES", request.param)
    hashing._TABLES.clear()
    yield
    hashing._TABLES.clear()


@pytest.mark.parametrize("n", [1, 2, 5])
def test_sets_have_the_sizes_and_overlaps_of_word_sets(group_bytes, n):
    rng = np.random.default_rng(n)
    vocabulary = ["ab", "Ab", "cd", "é", "x" * 90, "e"]
    texts = ["", None, " a", "a b", "A  b\tc\x0bd"] + [" ".join(rng.choice(vocabulary, rng.integers(0, 60))) for _ in range(60)]
    want = [brute(t, n) for t in texts]
    got = {r: set(s.tolist()) for r, s in hashing.shingle_sets(pa.array(texts), hashing.SPACED, n)}
    assert sorted(got) == list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a + 1):
            assert len(got[a] & got[b]) == len(want[a] & want[b])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té", max_size=300), max_size=8))
def test_word_counts(texts):
    counts = {}
    for at, hashes, number in hashing.words(pa.array(texts, pa.string()), hashing.SPACED):
        assert hashes.shape[-1] == number.sum()
        counts.update({at + i: int(k) for i, k in enumerate(number)})
    assert [counts.get(i, 0) for i in range(len(texts))] == [len(t.split()) for t in texts]


def test_sliced_and_chunked_columns():
    whole = pa.array(["p q", None, "r s t", "u"])
    part = list(hashing.shingle_sets(whole.slice(1, 3), hashing.SPACED, 2))
    assert [len(s) for _, s in part] == [0, 2, 1]
    assert np.array_equal(part[1][1], dict(hashing.shingle_sets(whole, hashing.SPACED, 2))[2])
    assert len(hashing.as_strings(pa.chunked_array([["a"], ["b"]]))) == 2
    assert not list(hashing.words(pa.array([], pa.string()), hashing.SPACED))
