"""Vocabulary operators: document frequency, pruning, stop words, ids (A1, A8, F3, J2, U2, U3,
W1, W2).

Document frequency is one hash aggregation on ``word`` with map-side partial counts, so a hot word
is combined inside every task before the shuffle (each task sends one row per distinct word).
After pruning by ``min_df`` the vocabulary is small and is broadcast to the corpus-sized side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import BROADCAST_MAX_BYTES, broadcast_if_small, global_row_number, lookup_join, measured_bytes
from ..functions.words import document_counts, words_by_hash


def document_frequency(words: DataFrame, doc: str = "doc_id", arr: str = "words",
                       extra_flags: dict | None = None) -> DataFrame:
    """A1: ``(word, df)`` = number of documents containing the word.

    ``words`` is the array form ``(doc, words)``. ``extra_flags`` maps an output name to a boolean
    column of ``words``; the output then also says whether any containing document had the flag
    (used to get the training-split words in the same pass).
    """
    flags = extra_flags or {}
    ex = words.select(F.explode(F.array_distinct(arr)).alias("word"),
                      *[c.alias(n) for n, c in flags.items()])
    aggs = [F.count(F.lit(1)).alias("df")] + [F.max(F.col(n).cast("int")).cast("boolean").alias(n)
                                              for n in flags]
    return ex.groupBy("word").agg(*aggs).withColumn("df", F.col("df").cast("bigint"))


def document_frequency_text(docs: DataFrame, text: str = "text", extra_flags: dict | None = None
                            ) -> DataFrame:
    """A1 from raw text: each chunk of texts counts its documents per word, and the partial counts meet."""
    flags = extra_flags or {}
    src = docs.select(text, *[c.alias(n) for n, c in flags.items()])
    parts = document_counts(src, text, tuple(flags))
    aggs = [F.sum("n").cast("bigint").alias("df")] + [F.max(n).cast("boolean").alias(n) for n in flags]
    return parts.groupBy("word").agg(*aggs)


def df_range_filter(dfreq: DataFrame, n_docs: int, min_df: int | float = 10,
                    max_df: int | float = 0.7) -> DataFrame:
    """keep ``min_df <= df <= max_df`` where a float bound is a share of ``n_docs``
    (n_docs counts every document, empty ones included)."""
    lo = min_df if isinstance(min_df, int) else min_df * n_docs
    hi = max_df if isinstance(max_df, int) else max_df * n_docs
    return dfreq.where((F.col("df") >= F.lit(lo)) & (F.col("df") <= F.lit(float(hi))))


def remove_stops(vocab: DataFrame, stops: DataFrame, word: str = "word") -> DataFrame:
    """Vocabulary minus stop words (anti join; the stop list is broadcast behind a size check)."""
    return vocab.join(broadcast_if_small(stops.select(F.col("word").alias(word))), word, "left_anti")


def order_vocab_by_df(vocab: DataFrame) -> DataFrame:
    """Ascending document frequency, ties by word."""
    return vocab.orderBy("df", "word")


def assign_ids(vocab: DataFrame, order=("df", "word"), name: str = "token_id") -> DataFrame:
    """Dense 0-based ids in ``order`` by the distributed numbering (no single-task window)."""
    return global_row_number(vocab, list(order), name=name)


def distinct_train_words(words: DataFrame, arr: str = "words") -> DataFrame:
    """Distinct words of the given (training) documents."""
    return words.select(F.explode(arr).alias("word")).distinct()


def vocab_in_train(vocab: DataFrame, train_words: DataFrame) -> DataFrame:
    """Candidate vocabulary restricted to words used in training documents."""
    return vocab.join(train_words, "word", "left_semi")


def vocab_report(stages: dict[str, DataFrame]) -> DataFrame:
    """Vocabulary size after each named stage, ``(stage_no, stage, size)``."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        one = df.agg(F.count(F.lit(1)).cast("bigint").alias("size")).select(
            F.lit(i).cast("bigint").alias("stage_no"), F.lit(name).alias("stage"), "size")
        out = one if out is None else out.unionByName(one)
    return out


def lookup(rows: DataFrame, vocab: DataFrame, on: str = "word", cols=("word", "token_id"),
           how: str = "inner") -> DataFrame:
    """Token rows joined to the vocabulary: broadcast when its measured size is small, else split by
    document frequency so that hot words do not move."""
    weight = "df" if "df" in vocab.columns and "df" not in cols else None
    return lookup_join(rows, vocab.select(*cols, *([weight] if weight else [])), on, how, weight)


def shipped(vocab: DataFrame):
    """Broadcast of a vocabulary's words, ids and hashes (``words_by_hash``), or None where it is too large."""
    import pyarrow as pa
    side = vocab.select("word", F.col("token_id").cast("bigint").alias("token_id"))
    if measured_bytes(side) > BROADCAST_MAX_BYTES:
        return None
    rows = side.toArrow().combine_chunks()
    words, ids = (pa.concat_arrays(rows.column(c).chunks) if rows.num_rows else pa.array([], t)
                  for c, t in ((0, pa.string()), (1, pa.int64())))
    return vocab.sparkSession.sparkContext.broadcast(words_by_hash(words, ids))
