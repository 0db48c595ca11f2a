"""Corpus and side-file readers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import broadcast_if_small
from ..functions.text import STOP_WORDS
from ..session import ensure_checkpoint_dir

from ..plans.params import TEST_ID_OFFSET


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread_small_input(df: DataFrame) -> DataFrame:
    """Text work is CPU-bound per row: when a scan yields fewer splits than there are task slots
    (a small file with few row groups), spread it round-robin over all slots. Such an input is at
    most slots times the split size of the scan, whatever the cluster, so what moves is bounded; an
    input of more splits is returned unchanged (no shuffle)."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text-bearing driver table, spread over the task slots when it is small."""
    return spread_small_input(table(spark, sf_dir, name))


def read_corpus(train: DataFrame, test: DataFrame | None = None,
                test_id_offset: int = TEST_ID_OFFSET) -> DataFrame:
    """Train and test subsets as one ``corpus(doc_id, subset, text)``.

    ``train`` needs ``(doc_id, text)``; ``test`` needs ``(item_id|doc_id, text)`` and gets
    ``doc_id = test_id_offset + id`` so the two id spaces do not collide.
    """
    tr = train.select(F.col("doc_id").cast("bigint"), F.lit("train").alias("subset"), "text")
    if test is None:
        return tr
    tid = "item_id" if "item_id" in test.columns else "doc_id"
    ts = test.select((F.lit(test_id_offset) + F.col(tid)).cast("bigint").alias("doc_id"),
                     F.lit("test").alias("subset"), "text")
    return tr.unionByName(ts)


def newsgroup_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver tables as a two-subset corpus: documents = train, benchmark = test."""
    return read_corpus(text_table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def numbered_lines(raw: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of a scanned text table: the 0-based line number over the files in path order.

    Lines are numbered by offsets. A first narrow pass counts the lines of each (file, block) of the
    scan; the counts of earlier blocks are added up; a second narrow pass adds a block's offset to the
    position of the line in its block. The text is never exchanged: what moves is one row per block."""
    lines = raw.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_f"),
                       F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    counted = lines.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_lo"))
    # one row per block of the scan: a total order of all blocks is small, and is frozen for the second pass
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    ensure_checkpoint_dir(raw.sparkSession)
    blocks = counted.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).checkpoint(eager=True)
    side = blocks.select(F.col("_f").alias("_bf"), F.col("_b").alias("_bb"), "_n", "_lo", "_off")
    found = lines.join(broadcast_if_small(side), (F.col("_f") == F.col("_bf")) & (F.col("_b") == F.col("_bb")), "left")
    at = F.col("_i") - F.col("_lo")
    same = F.coalesce((at >= 0) & (at < F.col("_n")), F.lit(False))
    # both passes must cut the files alike; see read_lines
    number = F.when(same, at + F.col("_off")).otherwise(
        F.raise_error(F.lit("the files or the session's split settings changed while lines were numbered")))
    return found.select(number.cast("bigint").alias("doc_id"), "text")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text file(s), one document per line → ``(doc_id, text)``; the id is the 0-based line number
    over the files in path order (:func:`numbered_lines`).

    Spark cuts files by the number of cores it sees at that moment. So that both passes cut alike when
    executors come and go, a session that does not say how finely to cut
    (``spark.sql.files.minPartitionNum``) is given the present number of cores."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return numbered_lines(spark.read.text(path))


def read_stops(spark: SparkSession, path: str | None = None) -> DataFrame:
    """S3: stop list ``(word)``. Without a path, the library's own list is used."""
    if path is None:
        return spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")
    return spark.read.text(path).select(F.col("value").alias("word")).distinct()


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``word count`` lines → ``dictionary(id, word, cnt)``; id = 0-based line number."""
    lines = read_lines(spark, path)
    parts = F.split(F.col("text"), " ")
    return lines.select(F.col("doc_id").alias("id"),
                        parts.getItem(0).alias("word"),
                        F.when(F.size(parts) > 1, parts.getItem(1).cast("bigint")).alias("cnt"))


def read_vectors(spark: SparkSession, path: str, vocab: DataFrame | None = None) -> DataFrame:
    """S5 + J3: ``word f1 ... fE`` lines → ``vectors(word, vec)``; restricted to the vocabulary
    (semi join); a later line wins on a duplicate word."""
    lines = read_lines(spark, path)
    parts = F.split(F.trim(F.col("text")), r"\s+")
    vecs = lines.select(
        F.col("doc_id").alias("line_no"),
        parts.getItem(0).alias("word"),
        F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.cast("double")).alias("vec"))
    return vectors_in_vocab(vecs, vocab)


def vectors_in_vocab(vecs: DataFrame, vocab: DataFrame | None) -> DataFrame:
    """Keep vectors of vocabulary words; for a duplicate word the last line wins."""
    if vocab is not None:
        vecs = vecs.join(vocab.select("word"), "word", "left_semi")
    return vecs.groupBy("word").agg(F.max_by("vec", "line_no").alias("vec"))
