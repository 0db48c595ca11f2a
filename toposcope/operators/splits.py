"""Splitting, encoding and per-split document indices.

Shuffle plan of the encode step: the token rows are joined to the broadcast vocabulary (narrow),
then shuffled once by ``doc_id`` for the per-document position window; the bag-of-words grouping
by ``(doc_id, ...)`` reuses that partitioning. A document is one row of text, so one window group
is bounded by the largest single text value, never by a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import key
from ..functions.ranking import global_row_number
from ..functions.words import token_rows
from .vocab import lookup


def permutation_key(doc_id: str = "doc_id", seed: int = 2019):
    """md5 of ``seed:doc_id``: ordering by it (ties by id) is a seeded random permutation."""
    return F.md5(key(seed, F.col(doc_id)))


def split_holdout(corpus: DataFrame, valid_size: int = 100, seed: int = 2019) -> DataFrame:
    """The training subset in permuted order, last ``valid_size`` → 'va', rest → 'tr';
    the test subset → 'ts'. Adds ``split`` and ``okey`` to every corpus row (narrow: only the
    ``valid_size`` hold-out ids are broadcast). ``okey`` orders documents inside a split
    (permutation key for tr/va, '' for ts so that test keeps id order)."""
    h = permutation_key(seed=seed)
    # the hold-out is a fixed-size top-k by permutation key: a bounded TakeOrderedAndProject
    valid = (corpus.where(F.col("subset") == "train")
             .select("doc_id", h.alias("h"))
             .orderBy(F.col("h").desc(), F.col("doc_id").desc())
             .limit(valid_size)
             .select("doc_id", F.lit(True).alias("_va")))
    out = corpus.join(F.broadcast(valid), "doc_id", "left")
    split = (F.when(F.col("subset") == "test", F.lit("ts"))
              .when(F.col("_va"), F.lit("va")).otherwise(F.lit("tr")))
    return out.withColumn("split", split).withColumn("okey", holdout_order_key(seed=seed)).drop("_va")


def holdout_order_key(split: str = "split", doc_id: str = "doc_id", seed: int = 2019):
    """Order of documents inside a split: the permutation key for tr/va, '' for ts (id order).
    Recomputed from the id where needed, so token rows never carry it."""
    return F.when(F.col(split) == "ts", F.lit("")).otherwise(permutation_key(doc_id, seed))


def split_fractions(corpus: DataFrame, seed: int = 2019, train: float = 0.85,
                    test: float = 0.10) -> DataFrame:
    """Permute; first floor(train·n) → 'tr', next floor(test·n) → 'ts', remainder → 'va'.
    Returns ``(doc_id, split, okey)`` with ``okey`` the permutation key."""
    n = corpus.count()
    n_tr = int(train * n // 1)
    n_ts = int(test * n // 1)
    keyed = corpus.select("doc_id", permutation_key(seed=seed).alias("okey"))
    tr_end, ts_end = _cut_offs(keyed, n_tr, n_tr + n_ts)
    split = (F.when(_before(tr_end), F.lit("tr"))
              .when(_before(ts_end), F.lit("ts")).otherwise(F.lit("va")))
    return keyed.select("doc_id", split.alias("split"), "okey")


def label_fractions(corpus: DataFrame, seed: int = 2019, train: float = 0.85, test: float = 0.10) -> DataFrame:
    """W5 on rows with payload: ``split`` beside the columns of ``corpus``. Each row compares its own
    permutation key with the two cut-off keys, so neither text nor a rank table moves."""
    n = corpus.count()
    n_tr = int(train * n // 1)
    tr_end, ts_end = _cut_offs(corpus.select("doc_id", permutation_key(seed=seed).alias("okey")), n_tr,
                               n_tr + int(test * n // 1))
    out = corpus.withColumn("okey", permutation_key(seed=seed))
    return out.withColumn("split", F.when(_before(tr_end), F.lit("tr")).when(_before(ts_end), F.lit("ts"))
                          .otherwise(F.lit("va"))).drop("okey")


def _cut_offs(keyed: DataFrame, *positions: int) -> list[tuple | None]:
    """``(okey, doc_id)`` at each 0-based position of the permutation; None past its end. Only keys
    and ids are ranked; the driver reads one row per position."""
    ranked = global_row_number(keyed, ["okey", "doc_id"], name="_r")
    rows = ranked.where(F.col("_r").isin(*positions)).collect()
    at = {r["_r"]: (r["okey"], r["doc_id"]) for r in rows}
    return [at.get(p) for p in positions]


def _before(cut: tuple | None):
    """True for rows ordered before the cut-off (all rows without one)."""
    if cut is None:
        return F.lit(True)
    return (F.col("okey") < F.lit(cut[0])) | ((F.col("okey") == F.lit(cut[0])) & (F.col("doc_id") < F.lit(cut[1])))


def encode_tokens(words: DataFrame, vocab: DataFrame, arr: str = "words",
                  doc: str = "doc_id", carry=()) -> DataFrame:
    """Tokens → word ids, unknown words dropped, order and repeats kept.

    ``words`` is the array form ``(doc, words, carry...)``. Output long form
    ``(doc, carry..., pos, token_id, n_tokens)``: ``pos`` counts surviving tokens from 0 and
    ``n_tokens`` is the encoded length of the document.
    """
    ex = words.select(doc, *carry, F.posexplode(arr).alias("_src_pos", "word"))
    hit = lookup(ex, vocab)
    w = Window.partitionBy(doc).orderBy("_src_pos")
    wl = Window.partitionBy(doc)
    return (hit.select(doc, *carry, "_src_pos", F.col("token_id").cast("bigint").alias("token_id"),
                       (F.row_number().over(w) - 1).cast("bigint").alias("pos"),
                       F.count(F.lit(1)).over(wl).cast("bigint").alias("n_tokens"))
               .drop("_src_pos"))


def encode_text(docs: DataFrame, vocab: DataFrame, text: str = "text", doc: str = "doc_id",
                carry=(), tokenizer: str = "clean") -> DataFrame:
    """J1 from raw text, same output as :func:`encode_tokens`. ``tokenizer``: ``clean`` (P9) or
    ``whitespace`` (P2)."""
    ex = token_rows(docs, text, (doc, *carry), tokenizer).withColumnRenamed("pos", "_src_pos")
    hit = lookup(ex, vocab)
    w = Window.partitionBy(doc).orderBy("_src_pos")
    wl = Window.partitionBy(doc)
    return (hit.select(doc, *carry, "_src_pos", F.col("token_id").cast("bigint").alias("token_id"),
                       (F.row_number().over(w) - 1).cast("bigint").alias("pos"),
                       F.count(F.lit(1)).over(wl).cast("bigint").alias("n_tokens"))
               .drop("_src_pos"))


def drop_empty_docs(encoded: DataFrame) -> DataFrame:
    """documents with no encoded word have no rows in the long form; this is the identity
    on rows and exists for the array form (``size(tokens) > 0``)."""
    if "tokens" in encoded.columns:
        return encoded.where(F.size("tokens") > 0)
    return encoded


def drop_single_token_tests(encoded: DataFrame, split: str = "split") -> DataFrame:
    """test documents must have more than one encoded token (repeats counted)."""
    return encoded.where((F.col(split) != "ts") | (F.col("n_tokens") > 1))


def half_label(pos: str = "pos", n: str = "n_tokens"):
    """W6: 'ts_h1' for the first floor(L/2) tokens, 'ts_h2' for the rest."""
    return F.when(F.col(pos) < F.floor(F.col(n) / 2), F.lit("ts_h1")).otherwise(F.lit("ts_h2"))


def reindex_docs(docs: DataFrame, split: str = "split", order=("okey", "doc_id")) -> DataFrame:
    """Dense 0-based ``doc_ix`` per split in ``order`` (distributed numbering)."""
    return global_row_number(docs.select("doc_id", split, *[c for c in order if c != "doc_id"]),
                             list(order), group_cols=[split], name="doc_ix")
