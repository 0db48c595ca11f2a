"""Newsgroup-style corpus preparation as one Spark plan.

train/test subsets → clean tokens (P9) → document frequency over both subsets (A1, Q2) with the
training-split flag in the same pass (U2) → prune (F3) → drop stops (J2) → restrict to training
words (U3) → ids by (df, word) (W2) → encode (J1) → drop empties / single-token tests (F1, F2) →
per-split doc index (W3) → halves (W6) → bag of words (A2, A3).

Shuffles: one on ``word`` (document frequency, partially aggregated map-side), one on ``doc_id``
(encoding window + bag-of-words grouping), plus small ones for the vocabulary and the document
index numbering. The vocabulary is broadcast behind a row-count check.
"""

from __future__ import annotations

import functools

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import broadcast_if_small
from ..functions.words import packed_counts, word_counts_by_row
from ..operators import bow as B
from ..operators import splits as S
from ..operators import tokens as P
from ..operators import vocab as V

from .params import MAX_DF, MIN_DF, SEED, VALID_SIZE


class Prepared:
    """The stages of X1. Vocabulary, counts and the document index are built on first use, so a
    query that needs only the document frequencies runs only that part."""

    def __init__(self, corpus: DataFrame, stops: DataFrame, min_df, max_df, seed: int,
                 valid_size: int, persist: bool):
        self.corpus, self.stops, self.seed, self.persist = corpus, stops, seed, persist
        # (doc_id, subset, text, split, okey); the hold-out top-k is computed inside the plan
        self.assigned = S.split_holdout(corpus, valid_size=valid_size, seed=seed)
        self.n_docs = corpus.count()
        # not cached: the token pass is cheaper to run twice (document frequency, encoding) than
        # to materialise every token array of the corpus
        self.dfreq = V.document_frequency_text(self.assigned, extra_flags={"in_tr": F.col("split") == "tr"})
        self.pruned = V.df_range_filter(self.dfreq, self.n_docs, min_df, max_df)
        self.candidates = V.remove_stops(self.pruned, stops)

    def _keep(self, df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK) if self.persist else df

    @functools.cached_property
    def vocab(self) -> DataFrame:
        """(token_id, word, df): candidates used in training documents, ids by (df, word)."""
        in_train = self._keep(self.candidates).where("in_tr").select("word", "df")
        return self._keep(V.assign_ids(in_train).select("token_id", "word", "df"))

    @functools.cached_property
    def bags(self) -> DataFrame:
        """(doc_id, split, tokens, counts) for tr, va, ts, ts_h1, ts_h2."""
        return self._keep(packed_bags(self.assigned, self.vocab, keep=self._keep))

    @property
    def counts(self) -> DataFrame:
        """(doc_id, split, token_id, cnt) for tr, va, ts, ts_h1, ts_h2."""
        return B.unpack_bow(self.bags, ("doc_id", "split"))

    @functools.cached_property
    def doc_index(self) -> DataFrame:
        """(doc_id, split, okey, doc_ix): dense per-split index of the non-empty documents."""
        docs = (self.bags.where(F.col("split").isin("tr", "va", "ts")).select("doc_id", "split")
                .withColumn("okey", S.holdout_order_key(seed=self.seed)))
        return S.reindex_docs(docs)

    @property
    def words(self) -> DataFrame:
        """Array form ``(doc_id, split, words)`` of the cleaned documents."""
        return P.clean_token_arrays(self.assigned, keys=("doc_id", "split"))

    @property
    def encoded(self) -> DataFrame:
        """Position-keeping long form ``(doc_id, split, pos, token_id, n_tokens)`` after F1/F2
        (one window over every document; the bag of words does not need it)."""
        enc = S.encode_text(self.assigned, self.vocab, carry=("split",))
        return S.drop_single_token_tests(S.drop_empty_docs(enc))

    def bow(self) -> DataFrame:
        return B.unpack_bow(self.packed())

    def packed(self) -> DataFrame:
        return B.attach_doc_index(self.bags, self.doc_index).select("split", "doc_ix", "tokens", "counts")


def packed_bags(assigned: DataFrame, vocab: DataFrame, tokenizer: str = "clean", keep=lambda df: df) -> DataFrame:
    """(doc_id, split, tokens, counts) for every split: ascending ids of a document's words and their counts.

    Train / validation documents need only counts: a text is counted and looked up where it is read (a
    vocabulary too large to broadcast is joined instead), and what moves on is one row per document. Only
    test documents are ordered by position (for the single-token rule and the halves). Rows that share a
    doc_id are one document. ``keep`` caches what is read more than once."""
    not_test = assigned.where(F.col("split") != "ts")
    keys = ("doc_id", "split")
    lookup = V.shipped(vocab)
    if lookup is None:
        hits = V.lookup(word_counts_by_row(not_test, "text", keys, tokenizer), vocab)
        bags = B.pack_counts(hits.groupBy(*keys, "token_id").agg(F.sum("n").cast("bigint").alias("cnt")))
    else:
        bags = packed_counts(not_test, lookup, "text", keys, tokenizer)
        many = not_test.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
            *[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_many"))
        if many.limit(1).count():
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            marked = keep(bags).join(broadcast_if_small(many), same, "left")
            cells = B.unpack_bow(marked.where("_many"), keys).groupBy(*keys, "token_id").agg(F.sum("cnt").cast("bigint").alias("cnt"))
            bags = marked.where("_many is null").select(*bags.columns).unionByName(B.pack_counts(cells))
    test = assigned.where(F.col("split") == "ts")
    enc = S.drop_single_token_tests(S.encode_text(test, vocab, carry=("split",), tokenizer=tokenizer))
    return bags.unionByName(B.pack_counts(B.counts_by_doc(enc)))


def prepare_newsgroup_style(corpus: DataFrame, stops: DataFrame, min_df=MIN_DF, max_df=MAX_DF,
                            seed: int = SEED, valid_size: int = VALID_SIZE,
                            persist: bool = True) -> Prepared:
    return Prepared(corpus, stops, min_df, max_df, seed, valid_size, persist)
