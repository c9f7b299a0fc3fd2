"""Language, toxicity and quality: held-out accuracy on small made corpora, and odd rows."""

import random
import zlib

import numpy as np
import pytest

from basinflow.llm import langid, quality, toxicity

STEMS = {"xx": ["ka", "lo", "mi", "tu", "re"], "yy": ["sch", "ein", "ung", "ber", "ver"], "zz": ["eau", "oui", "ais", "ment", "tre"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        lang = rng.choice(list(STEMS))
        w = text(rng, lang, rng.randint(20, 120)).split()
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["vileword", "foulterm", f"nasty{rng.randrange(50)}"])
        body = " ".join(w) + "." if good else " ".join(x + "$$$" if rng.random() < 0.4 else x.upper() for x in w)
        docs.append((i, body, lang, f"s{i % 3 if good else 9}", len(body)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i, m, r):
    return zlib.crc32(str(i).encode()) % m == r


def test_language(spark, corpus, odd_documents):
    docs, _ = corpus
    model = langid.fit(docs, most_docs=100)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in langid.predict(docs, model).collect() if held(r.doc_id, 5, 0)]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = langid.predict(odd_documents, model).collect()
    assert len(odd) == odd_documents.count()
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {2, 3, 4} and all(r.rejected for r in odd if r.lang_pred == "und")
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).collect() == []


def test_language_sees_the_whole_text(spark, corpus):
    docs, _ = corpus
    model = langid.fit(docs, most_docs=100)
    rng = random.Random(1)
    mixed = text(rng, "xx", 100) + " " + text(rng, "yy", 20_000)
    assert model.predict(mixed)[0] == "yy" and model.predict("12 !? 34")[0] == "und" and model.predict("7 ka 7")[0] != "und"


def test_only_letters_make_words(spark, corpus):
    docs, _ = corpus
    model = langid.fit(docs, most_docs=100)
    for sign in ("½ ² ①", "Ⅷ ⅷ", "12 34", "_ __", "!?", " ", "\u0301", "٣"):
        assert model.predict(sign)[0] == "und", sign
    for letter in ("ª", "ʰ", "中", "ǅ", "ka½lo", "é"):
        assert model.predict(letter)[0] != "und", letter
    assert langid.normalised("Ka½lo_mi 7tu²") == b"ka lo mi tu"


def brute_language(model, text):
    """Fewest bytes over the dictionaries, each chunk compressed on its own, by the plain library."""
    import re

    import zstandard

    words = re.sub("[^x]", lambda m: m[0] if m[0].isalpha() else " ", text.lower()).split()
    data = " ".join(w for i, w in enumerate(words) if i == 0 or w != words[i - 1]).encode()
    sizes = []
    for raw in model.dictionaries:
        c = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(data[a : a + langid.CHUNK])) for a in range(0, len(data), langid.CHUNK)))
    return model.languages[sizes.index(min(sizes))] if data else "und"


def test_language_equals_brute_force(spark, corpus, odd_documents):
    docs, _ = corpus
    model = langid.fit(docs, most_docs=60)
    texts = {r.doc_id: r.text for r in docs.limit(120).collect()}
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs.limit(120), model).collect()}
    assert got == {i: brute_language(model, t) for i, t in texts.items()}
    for r in odd_documents.collect():
        assert model.predict(r.text)[0] == brute_language(model, r.text or "")


def test_fits_are_repeatable(spark, corpus):
    docs, labels = corpus
    clash = docs.limit(300).withColumn("text", docs.text.substr(3, 50)).withColumn("lang", docs.source)
    rows = docs.union(clash)
    a, b = (langid.fit(d, most_docs=60) for d in (rows, rows.repartition(7)))
    assert a.dictionaries == b.dictionaries and a.slope == b.slope
    a, b = (toxicity.fit(d, labels, steps=20) for d in (rows, rows.repartition(7)))
    assert all((x == y).all() for x, y in zip(a.net.tables, b.net.tables))
    a, b = (quality.fit(quality.views(d, None), labels) for d in (rows, rows.repartition(7)))
    assert (a.calibration == b.calibration).all()


def test_toxicity_sample_is_bounded_by_bytes(spark, corpus, monkeypatch):
    docs, labels = corpus
    seen = []
    monkeypatch.setattr(toxicity, "fit_model", lambda texts, *a, **k: seen.append(sum(t.nbytes for t in texts)))
    toxicity.fit(docs, labels, exclude_fold=None)
    toxicity.fit(docs, labels, exclude_fold=None, most_bytes=seen[0] // 4)
    assert 0 < seen[1] < seen[0] // 3


def test_language_is_not_learnt_from_the_held_fold(spark, corpus):
    docs, _ = corpus
    ids = [i for i in range(5000) if held(i, 5, 0)][:200]
    only = spark.createDataFrame([(i, "ka lo", "qq") for i in ids], "doc_id long, text string, lang string")
    assert "qq" not in langid.fit(docs.select("doc_id", "text", "lang").union(only), most_docs=50).languages


def test_toxicity(spark, corpus, odd_documents):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, steps=500)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.score(docs, model).collect() if held(r.doc_id, 3, 1)]
    assert np.mean([(r.score >= toxicity.DECISION) == toxic[r.doc_id] for r in got]) > 0.93
    odd = toxicity.score(odd_documents, model).collect()
    assert len(odd) == odd_documents.count() and all(0 <= r.score <= 1 for r in odd)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_toxicity_finds_one_word_in_a_very_long_text(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, steps=500)
    rng = random.Random(2)
    long = text(rng, "xx", 40_000)
    df = spark.createDataFrame([(1, long + " vileword " + long), (2, "ka lo vileword mi")], "doc_id long, text string")
    assert all(r.score >= toxicity.DECISION for r in toxicity.score(df, model).collect())


def test_slices_of_a_long_text_change_nothing(monkeypatch):
    rng = np.random.default_rng(0)
    net = toxicity.Network.initial(1)
    model = toxicity.Model(net, rng.normal(size=(toxicity._LANG_BUCKETS, 3)), np.zeros(3), np.ones(3))
    ids = rng.integers(0, toxicity.BUCKETS, (toxicity.TABLES, 1000)).astype(np.uint16)
    whole = model.scores(ids, np.array([1000]))
    for size in (1, 3, 7, 999):
        monkeypatch.setattr(toxicity, "SLICE_WORDS", size)
        assert np.allclose(model.scores(ids, np.array([1000])), whole, atol=1e-6)
    monkeypatch.undo()
    both = model.scores(np.concatenate([ids, ids[:, :400]], axis=1), np.array([1000, 400]))
    assert np.allclose(both, [whole[0], model.scores(ids[:, :400], np.array([400]))[0]], atol=1e-6)


def test_toxicity_equals_plain_convolution(spark, corpus):
    """The network's answer, word by word in plain loops."""
    docs, labels = corpus
    model = toxicity.fit(docs, labels, steps=30)
    import pyarrow as pa

    from basinflow.llm import hashing

    rows = docs.limit(15).collect()
    got = {r.doc_id: r.score for r in toxicity.score(docs.where(docs.doc_id.isin([r.doc_id for r in rows])), model).collect()}
    for r in rows:
        ((_, hashes, counts),) = hashing.words(toxicity._lower(pa.array([r.text])), hashing.ALNUM, toxicity.PREFIXES)
        ids = toxicity.bucket_ids(hashes)
        e = [sum(t[i] for t, i in zip(model.net.tables, ids[:, w])) for w in range(counts[0])] + [np.zeros(toxicity.WIDTH)] * 2
        z = model.net.out_bias
        for j, k in enumerate(toxicity.FILTER_WIDTHS):
            for f in range(toxicity.FILTERS):
                best = max(float(np.concatenate(e[w : w + k]) @ model.net.kernels[j][:, f]) for w in range(counts[0])) + model.net.biases[j][f]
                z += max(best, 0.0) * model.net.out[j * toxicity.FILTERS + f]
        g = int(np.argmax([sum(model.languages[i % toxicity._LANG_BUCKETS, n] for i in ids[0]) for n in range(len(model.thresholds))]))
        want = 1 / (1 + np.exp(-((z - model.thresholds[g]) * model.slopes[g] + np.log(toxicity.DECISION / (1 - toxicity.DECISION)))))
        assert abs(got[r.doc_id] - want) < 1e-4


def test_toxicity_without_labels(spark, corpus):
    docs, labels = corpus
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, None).count() == docs.count()


def test_score_of_a_text_does_not_depend_on_its_batch(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, steps=50)
    one = {r.doc_id: r.score for r in toxicity.score(docs.coalesce(1), model).collect()}
    many = {r.doc_id: r.score for r in toxicity.score(docs.repartition(7), model).collect()}
    assert all(abs(one[k] - many[k]) < 1e-5 for k in one)


def test_quality(spark, corpus, odd_documents):
    docs, labels = corpus
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.x.com/en/{i}.html?p=1", "<p><a href='x'>y</a></p>" * (i % 3)) for i in range(0, 900, 2)], "page_id long, url string, html string")
    got = quality.score(docs, pages, labels).collect()
    good = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count()
    test = [r for r in got if held(r.doc_id, 3, 1)]
    assert np.mean([(r.score >= 0.5) == good[r.doc_id] for r in test]) > 0.95
    assert np.mean([(r.text_score >= 0.5) == good[r.doc_id] for r in test]) > 0.9
    assert all((r.page_score is None) == (r.doc_id % 2 == 1) for r in got) and all(r.score == r.text_score for r in got if r.page_score is None)
    odd = quality.score(odd_documents, None, labels).collect()
    assert len(odd) == odd_documents.count() and all(0 <= r.score <= 1 and r.page_score is None for r in odd)
    clash = labels.union(labels.withColumn("quality", 1 - labels.quality)).selectExpr("*", "'x' page_view", "quality text")
    assert quality.score(docs.withColumn("id", docs.source), pages.withColumn("doc_id", pages.url), clash).count() == docs.count()
    assert {r.score for r in quality.score(docs, pages.limit(0), labels.limit(0)).collect()} == {0.5}
    assert quality.score(docs.limit(0), pages, labels).collect() == []


def test_page_features(spark):
    pages = spark.createDataFrame([(1, "http://h/en/7", "<a >"), (2, "http://h/en/7?x", "<a ><a >"), (3, None, None), (4, "http://h/x", ""), (5, "http://h/99999999999999999999", "")], "page_id long, url string, html string")
    got = quality.page_features(pages).collect()
    assert [r.id for r in got] == [7] and len(got[0].page) == quality.PAGE_VALUES
    more = spark.createDataFrame([(1, "https://h/9/", ""), (2, "u://h/8.html?q", None), (3, "x/6", "")], "page_id long, url string, html string")
    assert sorted(r.id for r in quality.page_features(more).collect()) == [8, 9]


def test_the_views_share_no_feature(spark, corpus):
    """The page view changes with the page alone, the text view with the text alone."""
    docs, _ = corpus
    pages = spark.createDataFrame([(i, f"http://h/{i}", "<p>a&b</p>") for i in range(900)], "page_id long, url string, html string")
    a = {r.id: r for r in quality.views(docs, pages).collect()}
    b = {r.id: r for r in quality.views(docs.selectExpr("doc_id", "reverse(text) || 'x y' text", "'q' lang", "'z' source"), pages).collect()}
    c = {r.id: r for r in quality.views(docs, pages.limit(0)).collect()}
    assert all(a[i].page_view == b[i].page_view and a[i].text_view != b[i].text_view and a[i].text_view == c[i].text_view and c[i].page_view is None for i in a)


def test_exchange_helps_the_weak_view():
    rng = np.random.default_rng(4)
    y = (rng.random(4000) < 0.5).astype(int)
    x = rng.normal(size=(4000, quality.TEXT_VALUES)) + 2.5 * y[:, None] * (np.arange(quality.TEXT_VALUES) == 3)
    p = rng.normal(size=(4000, quality.PAGE_VALUES)) + 0.8 * y[:, None] * (np.arange(quality.PAGE_VALUES) < 4)
    scores = []
    for rounds in (1, 4):
        m = quality.co_train(x[:300], p[:300], y[:300], x[300:3000], p[300:3000], rounds=rounds)
        scores.append([((s >= 0.5) == y[3000:]).mean() for s in m.scores(x[3000:], p[3000:])])
    assert scores[1][1] > scores[0][1] + 0.01 and scores[1][2] >= max(scores[1][:2]) - 0.01 and scores[1][0] >= scores[0][0] - 0.02


def test_text_features_equal_brute_force():
    import re

    import pyarrow as pa

    texts = ["One two, two three! 7|$", "a b a b a b a b", "É ß\n\n#", "x"]
    got = quality.text_features(pa.array(texts))
    for row, t in zip(got, texts):
        raw = t.encode()
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw.lower())
        triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)] or [tuple(words)]
        share = lambda chars: sum(b in chars for b in raw) / len(raw)
        assert np.isclose(row[0], np.log1p(len(raw))) and np.isclose(row[1], np.log1p(len(words)))
        assert np.isclose(row[2 + 1], share(b" \t")) and np.isclose(row[2 + 4], share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) and np.isclose(row[2 + 10], share(bytes(range(128, 256))))
        runs = [words.count(w) for w in words]
        assert np.allclose(row[-4:], [len(raw) / len(words), len(set(words)) / len(words), max(runs) / len(words), len(set(triples)) / len(triples)])


def test_text_features_of_a_row_do_not_depend_on_its_group(spark, monkeypatch):
    import pyarrow as pa

    from basinflow.llm import hashing

    texts = ["a b c", "", None, "A! B| " * 50, "é ß 12"]
    whole = quality.text_features(pa.array(texts))
    single = np.concatenate([quality.text_features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, single) and not whole[1].any()
    assert hashing.GROUP_BYTES == 1 << 18


def test_a_view_that_counts_against_itself_gets_no_weight():
    rng = np.random.default_rng(5)
    t = (rng.random(400) < 0.5).astype(float)
    good, offset = (2 * t - 1) * 3 + rng.normal(size=400), np.ones(400)
    both = quality._combination(np.stack([good, (2 * t - 1) + rng.normal(size=400), offset], 1), t)
    assert both[0] > 0 and both[1] > 0
    against = quality._combination(np.stack([good, (1 - 2 * t) * 2 + rng.normal(size=400), offset], 1), t)
    alone = quality._ridge_logistic(np.stack([good, offset], 1), t, start=np.array([1.0, 0.0]))
    assert against[1] == 0 and np.allclose(against[[0, 2]], alone)
