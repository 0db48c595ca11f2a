"""Tokens by chunks of texts against the expressions of ``functions/text.py``, and packed bags."""

import random
import time

import pytest
from pyspark.sql import functions as F

from toposcope.functions import ranking as R
from toposcope.functions import text as T
from toposcope.functions import words as W
from toposcope.operators import bow as B
from toposcope.operators import model as M
from toposcope.operators import vocab as V
from toposcope.plans.newsgroup import packed_bags

ODD = ["don't foo_bar x² ½a café İstanbul 東京 a1 ١٢ _x '' ab-cd a+b [tag] a´b naïve Ab AB a", "", None, " ", "a", "ab", "aß\x85b c",
       "ΣΊΣΥΦΟΣ Σ İ ΑΣ ΑΣΑ\nab", "'𪲢ςσ _𐃥ÉÉY 𐃥É Ⅻ ⑤z ²x", "tab\there nbsp em　x"]


def texts():
    rng, out = random.Random(3), list(ODD)
    for _ in range(60):
        out.append("".join(chr(rng.choice([*range(32, 0x500), *range(0x2000, 0x3100), *range(0x10000, 0x10400)])) if rng.random() < .4
                           else rng.choice("abXYZ ßÉİΣσς'_1²\n") for _ in range(rng.randrange(200))))
    return out


@pytest.mark.parametrize("kind, array", [("clean", T.clean_token_array_stepwise), ("whitespace", T.whitespace_tokens)])
def test_tokens_equal_the_expressions(spark, monkeypatch, kind, array):
    monkeypatch.setattr(W, "CHUNK_BYTES", 300)           # several chunks a batch, texts longer than a chunk
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(2)
    long = df.select("doc_id", F.posexplode(array(F.col("text"))).alias("pos", "word"))
    want = sorted(map(tuple, long.collect()))
    assert sorted(map(tuple, W.token_rows(df, tokenizer=kind).collect())) == want
    per_text = long.groupBy("doc_id", "word").count()
    assert sorted(map(tuple, W.word_counts_by_row(df, tokenizer=kind).collect())) == sorted(map(tuple, per_text.collect()))
    totals = W.word_totals(df, tokenizer=kind).groupBy("word").agg(F.sum("n"))
    assert sorted(map(tuple, totals.collect())) == sorted(map(tuple, long.groupBy("word").count().collect()))


def test_document_frequency_counts_rows_and_flags(spark):
    rows = [("aa bb aa", True), ("AA cc", False), ("bb", None), ("dd", None), (None, True)]
    df = spark.createDataFrame(rows, "text string, f boolean").withColumn("doc_id", F.lit(1))
    got = V.document_frequency_text(df, extra_flags={"f": F.col("f")})
    assert sorted(map(tuple, got.collect()), key=repr) == [("aa", 2, True), ("bb", 2, True), ("cc", 1, False), ("dd", 1, None)]


@pytest.mark.parametrize("limit", [R.BROADCAST_MAX_BYTES, 0])
def test_bags_of_repeated_and_null_ids(spark, monkeypatch, limit):
    """Rows that share a doc_id are one document, with a shipped vocabulary and with a joined one."""
    monkeypatch.setattr(V, "BROADCAST_MAX_BYTES", limit)
    rows = [(1, "tr", "aa bb aa zz"), (1, "tr", "bb cc"), (2, "va", "cc"), (3, "tr", "zz"), (4, "tr", None), (None, "tr", "aa"),
            (None, "tr", "aa bb"), (9, "ts", "aa bb cc"), (8, "ts", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, split string, text string")
    vocab = spark.createDataFrame([(7, "aa", 1), (3, "bb", 1), (0, "cc", 1)], "token_id long, word string, df long")
    got = {(r.doc_id, r.split): (r.tokens, r.counts) for r in packed_bags(df, vocab).collect()}
    assert got == {(1, "tr"): ([0, 3, 7], [1, 2, 2]), (2, "va"): ([0], [1]), (None, "tr"): ([3, 7], [1, 2]),
                   (9, "ts"): ([0, 3, 7], [1, 1, 1]), (9, "ts_h1"): ([7], [1]), (9, "ts_h2"): ([0, 3], [1, 1])}


def test_long_documents_are_normalised_in_proportion(spark):
    """The total of a document is worked out once, not once a word."""
    df = spark.createDataFrame([(0, [1, 3]), (1, None)], "id long, counts array<long>")
    assert [r.weights for r in B.normalize_bow(df).orderBy("id").collect()] == [[0.25, 0.75], None]
    long = spark.range(2).select("id", F.array_repeat(F.lit(2), 30000).cast("array<bigint>").alias("counts"))
    begun = time.monotonic()
    top = B.normalize_bow(long).select(F.explode("weights").alias("w")).agg(F.min("w"), F.max("w"), F.count("w")).first()
    assert tuple(top) == (1 / 30000, 1 / 30000, 60000)
    wide = spark.range(2).select(M.softmax_array(F.array_repeat(F.lit(0.5), 1500)).alias("p"))
    assert wide.select(F.explode("p").alias("p")).agg(F.count("p")).first()[0] == 3000
    assert time.monotonic() - begun < 40
    small = spark.createDataFrame([([0.0, 1.0],), (None,)], "x array<double>").select(M.softmax_array(F.col("x")).alias("p")).collect()
    assert small[0].p == pytest.approx([0.2689414213699951, 0.7310585786300049]) and small[1].p is None


def test_words_are_found_by_hash(monkeypatch):
    """Places of words among a vocabulary sorted by hash, equal hashes of different words included."""
    import numpy as np
    import pyarrow as pa

    from toposcope.functions import words as W
    known = [f"w{i}é" for i in range(500)] + ["", "a", "aa", "\U0001f600"]
    asked = ["a", "w7é", "none", "", "aa", "\U0001f600", "w499é", "w500é"]
    for hashes in (W.string_hashes, lambda c: np.array([len(x or "") % 3 for x in c.to_pylist()], np.uint64)):
        monkeypatch.setattr(W, "string_hashes", hashes)
        words, ids, h = W.words_by_hash(pa.array(known), pa.array(range(len(known))))
        place = W.place_in(words, h, pa.array(asked))
        assert [known.index(w) if w in known else -1 for w in asked] == [ids[int(p)].as_py() if p >= 0 else -1 for p in place]
    assert W.place_in(*W.words_by_hash(pa.array([], pa.string()), pa.array([], pa.int64()))[::2], pa.array(asked)).tolist() == [-1] * 8
