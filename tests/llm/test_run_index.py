import numpy as np
import pytest

from basinflow.llm.run_index import PAD, RunIndex


def brute(strings, docs, queries, query_docs, span):
    seen = {}
    for s, d in zip(strings, docs):
        for i in range(len(s) - span + 1):
            w = bytes(s[i : i + span])
            seen[w] = min(d, seen.get(w, d))
    out = []
    for q, d in zip(queries, query_docs):
        bits = 0
        for i in range(len(q) - span + 1):
            w = bytes(q[i : i + span])
            if PAD not in w and w in seen and seen[w] < d:
                bits |= 1 << i
        out.append(bits)
    return out


@pytest.mark.parametrize("span, width, letters, seed", [(8, 12, 2, 1), (12, 20, 2, 2), (12, 16, 3, 3), (50, 80, 2, 4), (16, 16, 2, 5)])
def test_windows_of_smaller_documents(span, width, letters, seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(97, 97 + letters, size=(6, 3 * width)).astype(np.uint8)

    def strings(n):
        rows = np.stack([pool[rng.integers(6)][(at := rng.integers(2 * width)) : at + width] for _ in range(n)]).copy()
        for r in rows[: n // 2]:
            r[rng.integers(width)] = 120
        for r in rows[: n // 8]:
            r[: rng.integers(width)] = PAD
        return rows

    index, queries = strings(60), strings(80)
    docs, query_docs = rng.integers(0, 40, 60), rng.integers(0, 40, 80)
    got = RunIndex(index, docs, span).seen(queries, query_docs)
    want = brute([r for r in index], docs, queries, query_docs, span)
    assert got.tolist() == want and any(want)


def test_runs_are_fewer_than_rows_in_repetitive_strings():
    rng = np.random.default_rng(7)
    one = rng.integers(97, 123, size=80).astype(np.uint8)
    strings = np.repeat(one[None, :], 500, axis=0)
    index = RunIndex(strings, np.arange(500), 50)
    assert len(index.start) <= 81 < strings.size


def test_one_string_and_equal_bytes():
    strings = np.full((1, 20), 97, np.uint8)
    index = RunIndex(strings, np.array([3]), 12)
    assert index.seen(strings, np.array([4])).tolist() == [(1 << 9) - 1]
    assert index.seen(strings, np.array([3])).tolist() == [0]
