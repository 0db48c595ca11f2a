"""Corpus preparation: halves, empty / single-word rules, dense indices, partition independence."""

from pyspark.sql import functions as F

from toposcope.functions.ranking import global_row_number, global_running_sum
from toposcope.operators import bow as B
from toposcope.operators import splits as S
from toposcope.plans.newsgroup import prepare_newsgroup_style
from toposcope.sources.corpus import read_corpus, read_stops


def test_halves(spark):
    rows = []
    for doc, n in enumerate([2, 3, 4, 5]):
        for p in range(n):
            rows.append((doc, "ts", p, 100 + p, n))
    enc = spark.createDataFrame(rows, "doc_id long, split string, pos long, token_id long, n_tokens long")
    h = B.split_rows(enc).where("split = 'ts_h1'").groupBy("doc_id").count().orderBy("doc_id").collect()
    assert [r["count"] for r in h] == [1, 1, 2, 2]


def five_docs(spark):
    train = [(0, "alpha beta gamma delta"), (1, ""), (2, "alpha"), (3, "beta beta beta gamma"),
             (4, "the of and")] + [(10 + i, "alpha beta gamma delta epsilon") for i in range(6)]
    test = [(0, "alpha beta"), (1, "gamma"), (2, "zeta eta")]
    tr = spark.createDataFrame(train, "doc_id long, text string")
    ts = spark.createDataFrame(test, "item_id long, text string")
    return read_corpus(tr, ts)


def test_five_document_rules(spark):
    p = prepare_newsgroup_style(five_docs(spark), read_stops(spark), min_df=2, max_df=1.0,
                                valid_size=2)
    vocab = {r.word for r in p.vocab.collect()}
    assert "the" not in vocab and "zeta" not in vocab
    splits = {r.doc_id: r.split for r in p.encoded.select("doc_id", "split").distinct().collect()}
    assert 1 not in splits and 4 not in splits            # empty and stop-only documents vanish
    assert 1_000_000_001 not in splits                    # single-token test document dropped
    assert splits.get(1_000_000_000) == "ts"
    bow = p.bow()
    rep = {r.split: r for r in B.split_report(bow).collect()}
    assert all(r.dense for r in rep.values())
    h1 = bow.where("split = 'ts_h1'").agg(F.sum("cnt")).first()[0]
    h2 = bow.where("split = 'ts_h2'").agg(F.sum("cnt")).first()[0]
    ts = bow.where("split = 'ts'").agg(F.sum("cnt")).first()[0]
    assert h1 + h2 == ts
    rep_doc = bow.where("split = 'tr'").groupBy("doc_ix", "token_id").agg(F.sum("cnt").alias("c"))
    assert rep_doc.agg(F.max("c")).first()[0] >= 3         # repeated word counted


def test_global_row_number_partition_independent(spark):
    df = spark.range(20000).select(F.md5(F.col("id").cast("string")).alias("h"), "id",
                                   (F.col("id") % 3).alias("g"))
    exact = {r.id: r.rn for r in df.selectExpr("id", "row_number() over (partition by g order by h, id) - 1 as rn").collect()}
    for parts in (1, 7):
        got = global_row_number(df, ["h", "id"], ["g"], name="rn", num_partitions=parts)
        assert {r.id: r.rn for r in got.collect()} == exact


def test_global_running_sum(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("g"), (F.col("id") % 7).alias("v"))
    exact = {r.id: (r.n, r.s) for r in df.selectExpr(
        "id", "count(1) over (partition by g order by id) as n",
        "sum(v) over (partition by g order by id) as s").collect()}
    for parts in (1, 5):
        got = global_running_sum(df, ["id"], ["g"], ["v"], num_partitions=parts)
        assert {r.id: (r.cum_n, r.cum_v) for r in got.collect()} == exact


def test_holdout_sizes(spark):
    c = five_docs(spark)
    a = S.split_holdout(c, valid_size=2).groupBy("split").count().collect()
    got = {r.split: r["count"] for r in a}
    assert got == {"tr": 9, "va": 2, "ts": 3}


def test_split_fractions(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"))
    got = {r.split: r["count"] for r in S.split_fractions(docs).groupBy("split").count().collect()}
    assert got == {"tr": 850, "ts": 100, "va": 50}


def test_distributed_numbering_path_gives_same_tables(spark, monkeypatch):
    """At cluster scale the vocabulary / document index / dictionary exceed the single-window
    limit; force that path on a small corpus and compare with the default plan."""
    from toposcope.functions import ranking as R
    from toposcope.plans import lines as L
    from toposcope.sources.corpus import newsgroup_corpus, table

    sf = "/root/testdata/sf0.001"

    def tables():
        p = prepare_newsgroup_style(newsgroup_corpus(spark, sf), read_stops(spark))
        d = table(spark, sf, "documents").select("doc_id", "text")
        lp = L.prepare_lines_style(d, L.build_dictionary(d), read_stops(spark))
        return (sorted(p.bow().collect()), sorted(p.vocab.collect()), sorted(lp.bow().collect()))

    small = tables()
    for name in ("BROADCAST_MAX_BYTES", "HEAD_KEYS"):
        monkeypatch.setattr(R, name, 1)
    for fn in (R.broadcast_if_small, R.lookup_join):
        monkeypatch.setattr(fn, "__defaults__", tuple(1 if isinstance(x, int) else x for x in fn.__defaults__))
    assert tables() == small


def test_dictionary_to_vocab_any_removal_list(spark):
    """The same plan for stop lists of every length, against plain Python."""
    from toposcope.plans import lines as L

    words = [f"w{(i * 7919) % 2003}" for i in range(2003)]
    dictionary = spark.createDataFrame([(i, w, 5000 - i) for i, w in enumerate(words)], "id bigint, word string, cnt bigint")
    for n in (0, 40, 350, 524, 1000, 1001):
        gone = set(words[1:2 * n:2]) if n else set()
        stops = spark.createDataFrame([(w,) for w in sorted(gone)] + [("absent",)], "word string")
        got = sorted(tuple(r) for r in L.dictionary_to_vocab(dictionary, stops).collect())
        assert len(gone) == n and got == [(i, w) for i, w in enumerate(w for w in words if w not in gone)]


def test_split_labels_without_moving_text(spark):
    """W5 by cut-off keys: same split as the ranks, and no exchange below the text."""
    from toposcope.operators import splits as S
    from toposcope.sources.corpus import table

    d = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    labelled = S.label_fractions(d)
    plan = labelled._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    keyed = sorted((r["okey"], r["doc_id"]) for r in S.split_fractions(d).collect())
    n = len(keyed)
    want = {i: "tr" if k < int(.85 * n) else "ts" if k < int(.85 * n) + int(.1 * n) else "va"
            for k, (_, i) in enumerate(keyed)}
    assert {r["doc_id"]: r["split"] for r in labelled.collect()} == want


def test_hot_words_stay_in_place(spark):
    """Half of all tokens are one word and nothing may be broadcast whole: same rows, and the shuffled
    part holds no hot key."""
    from pyspark.sql import functions as F

    from toposcope.functions.ranking import lookup_join

    rows = spark.range(20000).select(F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, "the").otherwise(
        F.concat(F.lit("w"), F.col("id") % 997)).alias("word"))
    side = spark.createDataFrame([("the", 0, 10000)] + [(f"w{i}", i + 1, 10) for i in range(900)],
                                 "word string, token_id bigint, df bigint")
    for how in ("inner", "left"):
        plain = rows.join(side.select("word", "token_id"), "word", how)
        split = lookup_join(rows, side, "word", how, "df", max_bytes=0, head_keys=1)
        cols = ["pos", "word", "token_id"]
        assert sorted(map(tuple, split.select(cols).collect()), key=repr) == sorted(
            map(tuple, plain.select(cols).collect()), key=repr)
