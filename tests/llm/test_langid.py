import numpy as np

from toposcope.llm import langid as L


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(300):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 12, 5))])
        scores = rng.integers(-8, 9, (first[-1], 3)).astype(np.float32)
        labels = L.label(scores, first, 6.0)
        for a, b in zip(first[:-1], first[1:]):
            x, own = scores[a:b], labels[a:b]
            if len(x):
                best = x[0].astype(float)
                for row in x[1:]:
                    best = np.maximum(best, best.max() - 6) + row
                assert x[np.arange(len(x)), own].sum() - 6 * (own[1:] != own[:-1]).sum() == best.max()


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_edges_and_holdout(docs, rows):
    import zlib
    got = L.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i in (900001, 900002, 900003, 900004):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    langs = {r["lang"] for r in rows if r["lang"]}
    for r in got:
        want = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert r["held_out"] == want and 0 <= r["score"] <= 1
        assert r["lang_pred"] in langs | {"und"}


def test_predictions_do_not_read_labels(spark, docs):
    """A model applied to the same texts with other labels, ids and sources predicts the same."""
    model = L.train(docs)
    other = docs.selectExpr("doc_id + 7 as doc_id", "text", "'xx' as lang", "'s' as source")
    known = docs.where("doc_id is not null"), other.where("doc_id is not null")
    a = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in L.identify(known[0], model).collect())
    b = sorted((r["doc_id"] - 7, r["lang_pred"], r["score"]) for r in L.identify(known[1], model).collect())
    assert a == b


def test_mixed_text_and_scripts(spark):
    train = [("the cat sat on the mat and the dog ran " * 20, "en"), ("der hund und die katze ist nicht da " * 20, "de"),
             ("кошка сидела на окне и смотрела " * 20, "ru")]
    model = L.Model(train)
    text = "the dog and the cat " * 6 + "die katze und der hund " * 4 + "кошка на окне " * 3
    df = spark.createDataFrame([(1, text), (2, "собака"), (3, "漢字")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in L.identify(df, model, with_spans=True).collect()}
    assert got[1]["spans"] == "en:0:30,de:30:50,ru:50:59" and got[1]["lang_pred"] == "en"
    assert got[2]["lang_pred"] == "ru" and got[3]["lang_pred"] in {"en", "de", "ru"}


def test_nothing_to_learn_and_empty(spark, empty):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id bigint, text string, lang string")
    assert [r["lang_pred"] for r in L.identify(df).collect()] == ["und"]
    assert L.identify(empty).collect() == []


def _numbered(n):
    """Ids that may train."""
    import zlib
    ids = (i for i in range(10 * n) if zlib.crc32(str(i).encode()) % 4 != 2)
    return [next(ids) for _ in range(n)]


def test_every_language_trains(spark, monkeypatch):
    """The sample is bounded per language, over different texts; a language of long texts only trains."""
    monkeypatch.setattr(L, "Model", lambda rows: rows)
    texts = [f"the text number {i} of many" for i in range(300)]
    first = spark.createDataFrame([(t,) for t in texts], "text string").orderBy(L.F.xxhash64("text")).first()[0]
    rows = [(t, "en") for t in texts + [first] * 50]
    rows += [("кошка сидела на окне", "ru"), ("lang und breit " * 40, "de"), ("noch breiter " * 50, "de")]
    df = spark.createDataFrame([(i, *r) for i, r in zip(_numbered(len(rows)), rows)],
                               "doc_id bigint, text string, lang string").repartition(5)
    got = L.train(df, max_docs=20, max_chars=2000)
    assert sum(lang == "en" for _, lang in got) == len({t for t, lang in got if lang == "en"}) == 20
    assert {t for t, lang in got if lang == "ru"} == {"кошка сидела на окне"}
    assert sorted(len(t) for t, lang in got if lang == "de") == [100, 100]
    used = L.train(df, max_docs=200, max_chars=1000)
    assert 900 < sum(len(t) for t, lang in used if lang == "en") <= 1000


def test_many_languages():
    scores = np.zeros((3, 300), np.float32)
    scores[:2, 290] = scores[2, 5] = 20
    assert L.label(scores, np.array([0, 3])).tolist() == [290, 290, 5]


def test_sample_is_the_first_of_each_language(spark):
    """What is kept for ranking holds the first texts of every language and little else."""
    rows = [(f"short text {i}", "en") for i in range(6000)] + [(f"kurz {i}", "de") for i in range(90)]
    rows += [(f"long {i} " + "x" * 60, "de") for i in range(900)] + [("long only " + "y" * (60 + i), "fr") for i in range(700)]
    df = spark.createDataFrame(rows + rows[:3000] * 2, "text string, lang string").repartition(7)
    texts = df.select(*L.text_key(), "lang", L.F.length("text").alias("n"))
    kept = {tuple(r) for r in L._first_texts(texts, 100, 50).collect()}
    every = {tuple(r) for r in texts.collect()}
    assert kept <= every
    for lang in ("en", "de", "fr"):
        order = sorted((n > 50, a, b, n) for a, b, x, n in every if x == lang)
        first = {(a, b, lang, n) for _, a, b, n in order[:100]}
        assert len(first) == 100 and first <= kept and sum(x == lang for *_, x, _ in kept) < 400
