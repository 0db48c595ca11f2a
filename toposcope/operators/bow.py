"""Bag-of-words operators.

Counts are grouped by ``(doc_id, split, token_id)`` right after the per-document window of the
encode step, so the grouping reuses its ``doc_id`` hash partitioning (no second shuffle of token
rows); the dense per-split ``doc_ix`` is attached afterwards by a join on ``doc_id`` that shuffles
only the one-row-per-document index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import broadcast_if_small
from .splits import half_label

SPLITS = ("tr", "va", "ts", "ts_h1", "ts_h2")


def split_rows(encoded: DataFrame) -> DataFrame:
    """Every encoded token under its split; a test token is also emitted under its half, with
    its position counted inside that half."""
    half = F.floor(F.col("n_tokens") / 2)
    in_h1 = F.col("pos") < half
    half_row = F.struct(half_label().alias("s"),
                        F.when(in_h1, F.col("pos")).otherwise(F.col("pos") - half).cast("bigint").alias("p"))
    base_row = F.struct(F.col("split").alias("s"), F.col("pos").alias("p"))
    labels = (F.when(F.col("split") == "ts", F.array(base_row, half_row))
               .otherwise(F.array(base_row)))
    ex = encoded.select("doc_id", "token_id", F.explode(labels).alias("_r"))
    return ex.select("doc_id", F.col("_r.s").alias("split"), F.col("_r.p").alias("pos"), "token_id")


def counts_by_doc(encoded: DataFrame) -> DataFrame:
    """A2 keyed by ``doc_id``: ``(doc_id, split, token_id, cnt)``."""
    return (split_rows(encoded).groupBy("doc_id", "split", "token_id")
            .agg(F.count(F.lit(1)).cast("bigint").alias("cnt")))


def attach_doc_index(df: DataFrame, doc_index: DataFrame) -> DataFrame:
    """Replace ``doc_id`` by the split-local ``doc_ix`` (one document is in one base split)."""
    return df.join(broadcast_if_small(doc_index.select("doc_id", "doc_ix")), "doc_id").drop("doc_id")


def bag_of_words(encoded: DataFrame, doc_index: DataFrame) -> DataFrame:
    """A2: ``bow(split, doc_ix, token_id, cnt)`` for tr, va, ts, ts_h1, ts_h2."""
    return attach_doc_index(counts_by_doc(encoded), doc_index).select(
        "split", "doc_ix", "token_id", "cnt")


def pack_counts(counts: DataFrame, keys=("doc_id", "split")) -> DataFrame:
    """A3 on long counts: ids ascending with aligned counts as two arrays per document."""
    packed = counts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("token_id", "cnt"))).alias("_p"))
    return packed.select(*keys, F.transform("_p", lambda s: s["token_id"]).alias("tokens"),
                         F.transform("_p", lambda s: s["cnt"]).alias("counts"))


def pack_bow(encoded: DataFrame, doc_index: DataFrame) -> DataFrame:
    """A3: ``bow_packed(split, doc_ix, tokens, counts)``; grouped before the index join so the
    grouping reuses the ``doc_id`` partitioning."""
    return attach_doc_index(pack_counts(counts_by_doc(encoded)), doc_index).select(
        "split", "doc_ix", "tokens", "counts")


def unpack_bow(packed: DataFrame, keys=("split", "doc_ix")) -> DataFrame:
    """A4: packed arrays back to ``(keys..., token_id, cnt)``."""
    z = packed.select(*keys, F.explode(F.arrays_zip("tokens", "counts")).alias("z"))
    return z.select(*keys, F.col("z.tokens").alias("token_id"), F.col("z.counts").alias("cnt"))


def doc_lengths(packed: DataFrame, keys=("split", "doc_ix")) -> DataFrame:
    """A5: total count per document, from the packed arrays without a shuffle."""
    return packed.select(*keys, F.aggregate("counts", F.lit(0).cast("bigint"),
                                            lambda a, c: a + c).alias("n_words"))


def flatten_words(encoded_ix: DataFrame) -> DataFrame:
    """Flat ``(split, doc_ix, token_id)`` coordinates, repeats kept, one row per token."""
    return encoded_ix.select("split", "doc_ix", "token_id")


def split_report(bow: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Per split — documents, words (with repeats), distinct doc indices, and whether the
    distinct indices are exactly 0..docs-1 (the reference's printed self-check)."""
    rep = bow.groupBy("split").agg(
        F.count_distinct("doc_ix").cast("bigint").alias("n_docs"),
        F.sum("cnt").cast("bigint").alias("n_words"),
        (F.max("doc_ix") + 1).cast("bigint").alias("max_ix_plus_1"))
    rep = rep.withColumn("dense", F.col("n_docs") == F.col("max_ix_plus_1")).drop("max_ix_plus_1")
    if expected is not None:
        rep = rep.join(expected, "split", "left")
    return rep


def normalize_bow(packed: DataFrame, enabled: bool = True) -> DataFrame:
    """M1: counts divided by the document total (``bow_norm``); identity cast when disabled."""
    total = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c)
    if not enabled:
        return packed.withColumn("weights", F.transform("counts", lambda c: c.cast("double")))
    # bound by a lambda: as a column, the total would be put into the inner lambda and added up once a word
    shares = F.transform(F.array(total), lambda t: F.transform("counts", lambda c: c / t))
    return packed.withColumn("weights", shares[0])
