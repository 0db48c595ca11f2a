"""Lines-style preparation (one document per line, dictionary vocabulary).

Dictionary (word counts, order by count desc) minus stop words is the vocabulary (B2), the
documents are split by fractions of a seeded permutation (W5), tokenised on white space with case
kept (P2), encoded (J1), emptied / single-token tests dropped (F1/F2), indexed (W3), halved (W6)
and counted (A2). Document-frequency pruning is not applied (the reference computes it and
discards it).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number
from ..functions.words import word_totals
from ..operators import bow as B
from ..operators import splits as S
from ..operators import vocab as V
from .params import SEED, TEST_SHARE, TRAIN_SHARE


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(word, cnt)``: white-space token counts (partially aggregated before the shuffle)."""
    return word_totals(texts, text, "whitespace").groupBy("word").agg(F.sum("n").cast("bigint").alias("cnt"))


def build_dictionary(texts: DataFrame, text: str = "text") -> DataFrame:
    """Dictionary ``(id, word, cnt)``: ids in (count desc, word) order. Persisted: every consumer
    (encoding, binarising, id mapping) reads the same numbered table."""
    counts = word_counts(texts, text).persist(StorageLevel.MEMORY_AND_DISK)
    ranked = global_row_number(counts, [F.col("cnt").desc(), F.col("word")], name="id").select("id", "word", "cnt")
    return ranked.persist(StorageLevel.MEMORY_AND_DISK)


def dictionary_to_vocab(dictionary: DataFrame, stops: DataFrame, unique_words: bool = False) -> DataFrame:
    """B2: dictionary minus stop words, dictionary order kept, ids renumbered from 0.

    The kept entries are numbered in id order by the distributed numbering, whatever the length of
    the stop list. ``cnt`` is carried along where the dictionary has it. For a word listed twice the
    last position wins (a word → id map keeps the last assignment); ``unique_words`` skips that
    grouping when the dictionary is known to list each word once."""
    carried = ["cnt"] if "cnt" in dictionary.columns else []
    kept = V.remove_stops(dictionary.select("id", "word", *carried), stops)
    ranked = global_row_number(kept, ["id"], name="token_id").select("token_id", "word", *[
        F.col(c).alias("df") for c in carried])
    if unique_words:
        return ranked
    return ranked.groupBy("word").agg(F.max("token_id").alias("token_id")).select("token_id", "word")


class LinesPrepared:
    def __init__(self, vocab: DataFrame, assign: DataFrame, bags: DataFrame, doc_index: DataFrame,
                 lines: DataFrame, seed: int = SEED):
        self.vocab, self.assign, self.bags, self.doc_index, self.lines = vocab, assign, bags, doc_index, lines
        self.seed = seed

    def release(self) -> None:
        """Drop the cached tables of the preparation."""
        for df in (self.vocab, self.bags):
            df.unpersist()

    @property
    def encoded(self) -> DataFrame:
        toks = S.label_fractions(self.lines, seed=self.seed, train=TRAIN_SHARE, test=TEST_SHARE)
        enc = S.encode_text(toks, self.vocab, carry=("split",), tokenizer="whitespace")
        return S.drop_single_token_tests(S.drop_empty_docs(enc))

    @property
    def counts(self) -> DataFrame:
        """(doc_id, split, token_id, cnt)"""
        return B.unpack_bow(self.bags, ("doc_id", "split"))

    def bow(self) -> DataFrame:
        return B.unpack_bow(self.packed())

    def packed(self) -> DataFrame:
        return B.attach_doc_index(self.bags, self.doc_index).select("split", "doc_ix", "tokens", "counts")


def prepare_lines_style(lines: DataFrame, dictionary: DataFrame, stops: DataFrame,
                        seed: int = SEED, persist: bool = True) -> LinesPrepared:
    from .newsgroup import packed_bags
    vocab = dictionary_to_vocab(dictionary, stops, unique_words=True)
    if persist:
        vocab = vocab.persist(StorageLevel.MEMORY_AND_DISK)
    # every line compares its own permutation key with two cut-off keys: the text never moves
    assigned = S.label_fractions(lines, seed=seed, train=TRAIN_SHARE, test=TEST_SHARE)
    assign = assigned.select("doc_id", "split", S.permutation_key(seed=seed).alias("okey"))
    keep = (lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)) if persist else (lambda df: df)
    bags = keep(packed_bags(assigned, vocab, "whitespace", keep))
    docs = (bags.where(F.col("split").isin("tr", "va", "ts")).select("doc_id", "split")
            .withColumn("okey", S.permutation_key(seed=seed)))
    return LinesPrepared(vocab, assign, bags, S.reindex_docs(docs), lines, seed)
