import re

import pytest

from basinflow.llm import decontam


def words(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())


def shingles(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(docs, items, percent=80):
    out = []
    for d, t in docs:
        own = shingles(t)
        for i, s in items:
            x = shingles(s)
            k = len(x & own)
            if x and 100 * k >= percent * len(x):
                out.append((d, i, len(x), k))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    base = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(base[i * 9 : i * 9 + 4 + i])) for i in range(30)] + [(50, None), (51, ""), (52, "Ñandú y Él"), (53, "t0 t1")]
    docs = []
    for i in range(60):
        w = list(base[(i * 5) % 300 :])
        if i % 3 == 0:
            w[len(w) // 2] = "CHANGED"
        docs.append((i, "--".join(w) if i % 2 else " ".join(w).upper()))
    docs += [(100, None), (101, ""), (None, " ".join(base)), (7, " ".join(base)), (103, "x ñandú Y él z"), (104, "ñandú y él"), (105, "T0, T1")]
    return docs, items


@pytest.mark.parametrize("index_bytes", [1 << 25, 200])
@pytest.mark.parametrize("percent", [80, 100, 50])
def test_pairs_equal_brute_force(spark, tables, index_bytes, percent):
    docs, items = tables
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_contaminated(d, i, percent=percent, index_bytes=index_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, percent)


def test_decontaminate_keeps_clean_rows_as_they_are(spark, tables, odd_documents):
    docs, items = tables
    i = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(a, b, a, "z") for a, b in docs], "doc_id long, text string, item_id long, hashes string")
    bad = {(a, dict(docs).get(a)) for a, *_ in brute(docs, items)}
    kept = decontam.decontaminate(d, i).collect()
    assert len(kept) == len([1 for a, b in docs if not brute([(a, b)], items)]) and kept[0].asDict().keys() == set(d.columns)
    assert bad
    assert decontam.decontaminate(odd_documents, i).count() == odd_documents.count()


def test_empty_tables(spark, tables):
    docs, items = tables
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.find_contaminated(d.limit(0), i).collect() == []
    assert decontam.find_contaminated(d, i.limit(0)).collect() == []
    assert decontam.decontaminate(d, i.limit(0)).count() == len(docs)
