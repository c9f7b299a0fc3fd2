"""The corpus pipeline stage by stage against plain Python, and its registration."""

import random

import pytest

import corpus_pipeline
from basinflow.llm import decontam, toxicity
from shingle_brute import brute


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(5)
    words = [f"word{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(240):
        w = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            w[3] = "horridword"
        labels.append((i, 1, int(i % 4 == 0)))
        docs.append([i, " ".join(w), "en", "s", 0])
    item = " ".join(f"bench{i}" for i in range(20))
    docs[1][1] += " " + item
    docs[3] = [3, docs[5][1], "en", "s", 0]
    docs[7][1] += " reach me at bob@mail.example.com or +1 (227) 555-6608"
    docs += [[300, None, None, None, None], [301, "", "en", "s", 0], [302, "", "en", "s", 0], [None, "no id here at all", "en", "s", 0], [None, "no id here at all", "en", "s", 0], [9, docs[9][1], "en", "s", 0]]
    for d in docs:
        d[4] = None if d[1] is None else len(d[1])
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs


def test_stages(spark, corpus):
    folder, docs = corpus
    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns = df.columns
    ids = lambda d: sorted((r.doc_id for r in d.select("doc_id").collect()), key=str)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, folder)
        assert df.columns == columns
        path = f"{folder}/{name}"
        df.write.parquet(path)
        df = spark.read.parquet(path)
        kept[name] = df
    toxic = {i for i, t, *_ in docs if t and "horridword" in t}
    left = set(ids(kept["toxicity"]))
    assert len(toxic & left) <= 3 and len({d[0] for d in docs} - toxic - left) <= 3
    dedup = ids(kept["near_duplicates"])
    assert 3 in dedup and 5 not in dedup and dedup.count(9) == (9 in left) and dedup.count(None) == 2 and {300, 301, 302} <= set(dedup)
    assert set(ids(kept["near_duplicates"])) - set(ids(kept["decontamination"])) == {1} & left
    texts = {r.doc_id: r for r in kept["private_data"].collect()}
    assert len(texts) == len(set(ids(kept["decontamination"]))) and kept["private_data"].count() == kept["decontamination"].count()
    if 7 in texts:
        assert texts[7].text.endswith("at [EMAIL] or [PHONE]") and texts[7].n_chars == len(texts[7].text)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept["private_data"], folder).collect()
    assert sorted((r.doc_id for r in packed if r.piece == 0), key=str) == ids(kept["private_data"])


def test_dedup_stage_equals_brute_force(spark, corpus):
    folder, docs = corpus
    df = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    # near variants, so that classes hold more than equal rows
    extra = [(400 + i, rows[i][1] + " tail") for i in range(20) if rows[i][0] is not None and rows[i][1]]
    df = df.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in extra], df.schema))
    rows += extra
    sets = [brute(t, 5) if i is not None else set() for i, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            same = rows[a] == rows[b] and rows[a][0] is not None
            if same or (sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])):
                root[find(a)] = find(b)
    classes = {}
    for k, row in enumerate(rows):
        classes.setdefault(find(k), []).append(row)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, folder).collect()]
    assert len(got) == len(classes)
    assert sorted((r[0] for r in got), key=str) == sorted((min((r[0] for r in c if r[0] is not None), default=None) for c in classes.values()), key=str)
    assert len(classes) < len(rows) - 10


def test_dedup_stage_judges_each_text_of_an_id(spark, tmp_path):
    rng = random.Random(8)
    text = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(40)]
    near = lambda t: t + " end"
    rows = [(7, t) for t in text[:20]]  # one id, clean texts
    rows += [(7, text[0]), (7, near(text[1]))]  # an equal and a near row
    rows += [(3, text[20]), (9, near(text[20])), (9, text[21]), (9, text[22])]  # one text of 9 is near a smaller id's
    rows += [(5, None), (5, None), (5, ""), (5, " "), (5, text[23]), (6, ""), (6, ""), (None, text[0]), (None, text[0])]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long").repartition(5)
    got = corpus_pipeline.drop_near_duplicates(spark, df, str(tmp_path))
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    one = [(i, t) for i, t in kept if t in (text[1], near(text[1]))]
    assert len(one) == 1
    want = [(7, text[0]), *one, *[(7, t) for t in text[2:20]], (3, text[20]), (9, text[21]), (9, text[22]), (5, None), (5, ""), (5, " "), (5, text[23]), (6, ""), (None, text[0]), (None, text[0])]
    assert kept == sorted(want, key=str)


def test_run(spark, corpus):
    folder, docs = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "private_data", "packing"]
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 100 and "sequence_id" in out.columns
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_filters_do_nothing_without_models(spark, corpus):
    folder, _ = corpus
    df = spark.read.parquet(f"{folder}/documents.parquet")
    assert toxicity.drop_toxic(df, None).count() == df.count()
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(df, empty).count() == df.count()
