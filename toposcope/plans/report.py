"""Model context over a prepared corpus, and the evaluation report.

Builds, from the driver tables: the newsgroup-style preparation (X1), the fixture model
(rho, alpha, encoder params at hidden size 8), beta (T1), and the encoder outputs (T3) for the
splits the report needs. Persisted pieces are reused by every metric of one report.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import snap
from ..operators import evaluate as EV
from ..operators import model as M
from ..sources import fixtures as FX
from ..sources.corpus import newsgroup_corpus, read_stops
from . import params as PR
from .newsgroup import Prepared, prepare_newsgroup_style


class ModelContext:
    """Corpus, model and derived tables; each part is built on first use, so a query pays only for what
    it reads. ``rho`` (``qvec``), ``alpha`` (``qsum``) and ``params`` may be given, e.g. by a loaded
    model; by default they are the fixture model's."""

    act = "relu"

    def __init__(self, spark: SparkSession, sf: str, hidden: int = PR.HIDDEN, rho: DataFrame | None = None,
                 alpha: DataFrame | None = None, params: DataFrame | None = None):
        self.spark, self.sf, self.hidden = spark, sf, hidden
        self._rho, self._alpha, self._params = rho, alpha, params
        self._kept: list[DataFrame] = []

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def release(self) -> None:
        """Drop the cached tables of this context."""
        for df in self._kept:
            df.unpersist()

    @cached_property
    def prepared(self) -> Prepared:
        return prepare_newsgroup_style(newsgroup_corpus(self.spark, self.sf), read_stops(self.spark))

    @cached_property
    def vocab_size(self) -> int:
        return self.prepared.vocab.count()

    @cached_property
    def rho(self) -> DataFrame:
        return self._rho if self._rho is not None else self._keep(FX.rho(self.spark, self.sf, self.prepared.vocab))

    @cached_property
    def alpha(self) -> DataFrame:
        return self._alpha if self._alpha is not None else FX.alpha(self.spark, self.sf)

    @cached_property
    def _beta(self) -> tuple[DataFrame, list[int]]:
        beta_tok, topics = M.beta_by_token(self.rho, self.alpha)
        return self._keep(beta_tok), topics

    @property
    def beta_tok(self) -> DataFrame:
        """(token_id, dots, beta)"""
        return self._beta[0]

    @cached_property
    def topics(self) -> list[int]:
        return sorted(r["topic"] for r in self.alpha.select("topic").collect())

    @cached_property
    def beta_long(self) -> DataFrame:
        """(topic, token_id, dot, p)"""
        return M.beta_long(*self._beta)

    @cached_property
    def params(self) -> DataFrame:
        if self._params is not None:
            return self._params
        return FX.encoder_params(self.spark, self.prepared.vocab, len(self.topics), self.hidden)

    @cached_property
    def weights(self) -> M.EncoderWeights:
        return M.EncoderWeights.from_table(self.params, self.vocab_size)

    @cached_property
    def _bow(self) -> DataFrame:
        return self._keep(self.prepared.bow())

    @cached_property
    def _packed(self) -> DataFrame:
        return self._keep(self.prepared.packed())

    def bow(self) -> DataFrame:
        return self._bow

    def packed(self) -> DataFrame:
        return self._packed

    def encoded(self, *splits: str, carry: bool = False) -> DataFrame:
        """Encoder outputs of the splits; with ``carry`` beside the documents' tokens and counts."""
        p = self.packed().where(F.col("split").isin(*splits))
        return M.encode_docs(p, self.weights, self.act, carry=carry)

    @cached_property
    def _beta_blocks(self) -> M.BetaBlocks:
        return M.beta_lookup(self.beta_tok)

    def beta_side(self) -> M.BetaBlocks:
        return self._beta_blocks


def model_context(spark: SparkSession, sf: str, hidden: int = PR.HIDDEN) -> ModelContext:
    return ModelContext(spark, sf, hidden)


def query_words(ctx: ModelContext, n: int = 12) -> list[tuple[int, list[int]]]:
    """Neighbour queries drawn from the data: the ``n`` vocabulary words of highest document
    frequency (ties by word) with their quantised vectors (a bounded top-k)."""
    top = ctx.prepared.vocab.orderBy(F.col("df").desc(), F.col("word")).limit(n)
    col = "qvec" if "qvec" in ctx.rho.columns else "vec"
    rows = top.join(ctx.rho, "token_id").select("token_id", col).collect()
    return [(int(r["token_id"]), list(r[col])) for r in rows]


def eval_report(ctx: ModelContext) -> DataFrame:
    """Tall ``(metric, key, value)`` table: perplexity, coherence, diversity, topic usage, the
    top-used topics (key: rank, value: topic), the listed top words of every topic (key: topic · 1000
    + rank, value: token id) and the neighbours of the query words (key: query id · 1000 + rank)."""
    bow = ctx.bow()
    beta_side = ctx.beta_side()
    h1 = ctx.encoded("ts_h1")
    h2 = ctx.packed().where(F.col("split") == "ts_h2")
    ppl = EV.doc_completion_ppl(h2, h1, beta_side, PR.EVAL_BATCH)
    coh = EV.topic_coherence(ctx.beta_long, bow.where(F.col("split") == "tr"), PR.TOP_WORDS)
    div = EV.topic_diversity(ctx.beta_long, PR.DIVERSITY_WORDS)
    usage = EV.topic_usage(ctx.encoded("tr"), ctx.topics).persist()        # one row per topic
    first = Window.orderBy(F.col("weighted").desc(), "topic")
    used = EV.top_used_topics(usage, 10).withColumn("rank", F.row_number().over(first) - 1)
    top = EV.topic_top_words(ctx.beta_long, EV.listed_words(PR.NUM_WORDS))
    near = EV.nearest_words(ctx.rho, query_words(ctx), PR.NEIGHBOURS)

    def part(df: DataFrame, metric: str, key, value) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), key.cast("bigint").alias("key"),
                         value.cast("double").alias("value"))

    parts = [part(ppl, "ppl", F.lit(-1), F.col("ppl")),
             part(coh, "coherence", F.col("topic"), F.col("coherence")),
             part(div, "diversity", F.lit(-1), F.col("diversity")),
             part(usage, "usage_weighted", F.col("topic"), F.col("weighted")),
             part(used, "top_used", F.col("rank"), F.col("topic")),
             part(top, "top_word", F.col("topic") * 1000 + F.col("rank"), F.col("token_id")),
             part(near, "neighbour", F.col("query_id") * 1000 + F.col("rank"), F.col("token_id"))]
    out = reduce(DataFrame.unionByName, parts)
    return out.select("metric", "key", snap(F.col("value")).alias("value"))
