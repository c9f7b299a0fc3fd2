import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basinflow.llm import packing
from basinflow.llm.tokens import WordTokenizer, vocabulary_path

TEXTS = ["", " ", "Plain text, don't! 123 £5 ½", "ÉCOLE é Straße ΟΔΟΣ Σ", "a<|endoftext|>b <|", "x\x0by\x1cz w", "''s 're'll <<//>> a_b", "word " * 3000, "naïve façade ÀÉÎÕÜ ÿ ×÷", "日本語 текст", "İstanbul ǅ ﬁ"]


@pytest.fixture(scope="module")
def tokenizer():
    return WordTokenizer(vocabulary_path(), most_cached=50)


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_tokenizers(tokenizer, text):
    want = tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokenizer.encode([text])[0], "<u4").tolist() == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_every_installed_vocabulary(name):
    own = WordTokenizer(vocabulary_path(name))
    assert own.cached_words == (name == "word_bpe_49k.json")
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(TEXTS)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_a_vocabulary_of_other_rules_goes_to_the_tokenizer(tmp_path):
    import json

    with open(vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"].pop()  # no lower case
    path = str(tmp_path / "cased.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    own = WordTokenizer(path)
    assert not own.cached_words
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(TEXTS)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abzAZéÉßÿ019 .,'!<|>/w\n\t\r-_×÷&"), max_size=60), max_size=5))
def test_random_ids_are_the_tokenizers(texts):
    t = test_random_ids_are_the_tokenizers.__dict__.setdefault("t", WordTokenizer(vocabulary_path(), 40))
    assert [np.frombuffer(b, "<u4").tolist() for b in t.encode(texts)] == [t.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def optimum(lengths, capacity):
    """Fewest bins, by search."""
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= lengths[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, [*rest, r - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_bounds_never_exceed_the_optimum(lengths):
    a = np.array(lengths)
    bins, offsets, fill = packing.best_fit_decreasing(a, 12)
    assert packing.lower_bound(a, 12) <= optimum(lengths, 12) <= len(fill)
    used = defaultdict(list)
    for b, o, n in zip(bins, offsets, a):
        used[b].append((o, n))
    for b, parts in used.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == fill[b] <= 12


def test_bound_sees_large_items():
    assert packing.lower_bound(np.array([7, 7, 7]), 12) == 3
    assert packing.lower_bound(np.array([6, 6, 6, 5]), 12) == 2
    assert packing.lower_bound(np.zeros(0, np.int64), 12) == 0


def checked(rows, capacity):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


@pytest.mark.parametrize("partition", [5, 20_000])
def test_pack_round_trip(spark, odd_documents, tokenizer, partition):
    many = odd_documents.select("doc_id", "text", "id").union(spark.createDataFrame([(100 + i, "some words " * (i % 40), i) for i in range(150)], "doc_id long, text string, id long"))
    rows = packing.pack(many, capacity=64, partition_pieces=partition, with_ids=True).collect()
    total = sum(r.length for r in rows)
    n = checked(rows, 64)
    # partitions of five pieces are packed worse than one of all
    assert -(-total // 64) <= n <= -(-total // 64) + (8 if partition == 5 else 2)
    want = defaultdict(int)
    for r in many.collect():
        ids = [*tokenizer.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[(r.doc_id, k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = defaultdict(int)
    for r in rows:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        assert r.bins >= r.bound
    assert got == want


def test_empty_table(spark, odd_documents):
    assert packing.pack(odd_documents.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query_is_optimal_on_a_table(spark):
    from basinflow.llm import catalog

    rows = catalog.op6_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    assert checked(rows, 4096) == -(-sum(r.length for r in rows) // 4096)
