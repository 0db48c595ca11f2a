"""Text-file readers, stores and the streaming encode."""

import os
import tempfile

from pyspark.sql import functions as F

from toposcope.sources import corpus as C
from toposcope.sources import stores
from toposcope.streaming.encode_stream import encode_stream, start_encoded_sink


def test_read_lines_and_dictionary(spark):
    d = tempfile.mkdtemp(prefix="tps-lines-")
    p = os.path.join(d, "dict.txt")
    words = [f"w{i} {1000 - i}" for i in range(2500)]
    with open(p, "w") as f:
        f.write("\n".join(words) + "\n")
    lines = C.read_lines(spark, p).orderBy("doc_id").collect()
    assert [r.text for r in lines] == words and [r.doc_id for r in lines] == list(range(2500))
    dic = C.read_dictionary(spark, p).orderBy("id").collect()
    assert dic[3].word == "w3" and dic[3].cnt == 997


def test_read_lines_over_files_and_blocks(spark, tmp_path):
    """Several files cut into many blocks: ids follow the path order, and no exchange carries the text."""
    lines = []
    for f in range(3):
        part = [f"file {f} line {i} " + "x" * (i % 40) for i in range(4000)] + ["", "last"]
        (tmp_path / f"part-{f:05d}.txt").write_text("\n".join(part) + "\n")
        lines += part
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        df = C.read_lines(spark, str(tmp_path))
        got = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        parts = df.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.text for r in sorted(got, key=lambda r: r.doc_id)] == lines
    assert sorted(r.doc_id for r in got) == list(range(len(lines)))
    moved = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert not moved, moved
    assert parts >= 8


def test_read_vectors_last_wins(spark):
    d = tempfile.mkdtemp(prefix="tps-vec-")
    p = os.path.join(d, "vec.txt")
    with open(p, "w") as f:
        f.write("a 1 2\nb 3 4\na 5 6\nc 7 8\n")
    vocab = spark.createDataFrame([("a",), ("b",)], "word string")
    got = {r.word: r.vec for r in C.read_vectors(spark, p, vocab).collect()}
    assert got == {"a": [5.0, 6.0], "b": [3.0, 4.0]}


def test_read_stops(spark):
    d = tempfile.mkdtemp(prefix="tps-stops-")
    p = os.path.join(d, "stops.txt")
    with open(p, "w") as f:
        f.write("x\ny\nx\n")
    assert sorted(r.word for r in C.read_stops(spark, p).collect()) == ["x", "y"]
    assert C.read_stops(spark).count() > 20


def test_bow_store_prunes_split(spark):
    packed = spark.createDataFrame([("tr", 0, [1, 2], [3, 1]), ("va", 0, [2], [5])],
                                   "split string, doc_ix long, tokens array<int>, counts array<int>")
    path = os.path.join(tempfile.mkdtemp(prefix="tps-bow-"), "bow")
    stores.write_bow(packed, path)
    one = stores.read_bow(spark, path, "va")
    assert [r.counts for r in one.collect()] == [[5]]
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().executedPlan().toString()


def test_stream_encode(spark):
    src = tempfile.mkdtemp(prefix="tps-src-")
    out = tempfile.mkdtemp(prefix="tps-out-")
    spark.createDataFrame([(1, "Alpha beta, beta!"), (2, "gamma x1")], "doc_id long, text string") \
        .write.mode("overwrite").parquet(os.path.join(src, "part"))
    vocab = spark.createDataFrame([(0, "alpha"), (1, "beta")], "token_id long, word string")
    q = start_encoded_sink(spark, os.path.join(src, "part"), "doc_id long, text string", vocab,
                           os.path.join(out, "enc"), os.path.join(out, "ckpt"))
    q.awaitTermination(120)
    got = sorted((r.doc_id, r.src_pos, r.token_id) for r in spark.read.parquet(os.path.join(out, "enc")).collect())
    assert got == [(1, 0, 0), (1, 1, 1), (1, 2, 1)]
    assert encode_stream(spark.readStream.schema("doc_id long, text string").parquet(os.path.join(src, "part")),
                         vocab).isStreaming
