"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame`` over the driver tables.

Each query runs the library operators on whole tables; none caps, samples or subsets rows.
Column names match the SQL twins in ``toposcope.oracle.sql``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import snap
from ..functions.ranking import broadcast_if_small, global_row_number
from ..functions.text import whitespace_tokens
from ..operators import bow as B
from ..operators import splits as S
from ..operators import tokens as P
from ..operators import vocab as V
from ..session import scratch_path
from ..sources import stores
from ..sources.corpus import newsgroup_corpus, read_dictionary, read_lines, read_stops, read_vectors, table, text_table
from . import lines as L
from .newsgroup import Prepared, prepare_newsgroup_style

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return text_table(spark, sf, "documents").select("doc_id", "text")


def ng(spark: SparkSession, sf: str) -> Prepared:
    return prepare_newsgroup_style(newsgroup_corpus(spark, sf), read_stops(spark))


def lines_prepared(spark: SparkSession, sf: str) -> L.LinesPrepared:
    d = docs(spark, sf)
    return L.prepare_lines_style(d, L.build_dictionary(d), read_stops(spark))


# ------------------------------------------------------------------ sources and tokenisation

@register("read_corpus")
def q_read_corpus(spark, sf):
    return newsgroup_corpus(spark, sf).select("doc_id", "subset", "text")


def _written(spark, df: DataFrame, name: str) -> str:
    """The one text column of ``df`` as text files whose order is that of ``df``'s partitions."""
    path = scratch_path(spark, name)
    df.write.text(path)
    return path


@register("read_lines")
def q_read_lines(spark, sf):
    """The documents' texts written as text files in id order, read back line by line."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return read_lines(spark, _written(spark, d.orderBy("doc_id").select("text"), "lines"))


@register("read_stops")
def q_read_stops(spark, sf):
    """S3: the words of the benchmark's questions as a stop file, one a line, repeats and all."""
    w = table(spark, sf, "benchmark").select(F.explode(whitespace_tokens(F.col("text"))).alias("word"))
    return read_stops(spark, _written(spark, w, "stops"))


@register("read_dictionary")
def q_read_dictionary(spark, sf):
    """The corpus dictionary written as ``word count`` lines in id order and read back."""
    d = L.build_dictionary(docs(spark, sf)).orderBy("id").select(F.concat_ws(" ", "word", F.col("cnt").cast("string")))
    return read_dictionary(spark, _written(spark, d, "dictionary"))


@register("read_vectors")
def q_read_vectors(spark, sf):
    """The embeddings written as ``word f1 ... fE`` lines (the word: ``v<label>x<id // 2>``, so some
    words have two lines) in id order and read back."""
    e = FX.embeddings_q(spark, sf).orderBy("vec_id")
    word = F.concat(F.lit("v"), F.col("label").cast("string"), F.lit("x"), F.floor(F.col("vec_id") / 2).cast("string"))
    line = F.concat_ws(" ", word, F.transform("qvec", lambda q: q.cast("string")))
    return read_vectors(spark, _written(spark, e.select(line), "vectors"))


@register("tokenize_regex")
def q_tokenize_regex(spark, sf):
    return P.tokenize_regex(docs(spark, sf))


@register("tokenize_whitespace")
def q_tokenize_whitespace(spark, sf):
    return P.tokenize_whitespace(docs(spark, sf))


@register("tokenize_word2")
def q_tokenize_word2(spark, sf):
    return P.tokenize_word2(docs(spark, sf))


@register("drop_punct_tokens")
def q_drop_punct(spark, sf):
    return P.drop_punct_tokens(P.tokenize_regex(docs(spark, sf)))


@register("lowercase")
def q_lowercase(spark, sf):
    return P.lowercase(P.tokenize_regex(docs(spark, sf)))


@register("drop_numeric_tokens")
def q_drop_numeric(spark, sf):
    return P.drop_numeric_tokens(P.lowercase(P.drop_punct_tokens(P.tokenize_regex(docs(spark, sf)))))


@register("drop_short_tokens")
def q_drop_short(spark, sf):
    return P.drop_short_tokens(P.tokenize_regex(docs(spark, sf)))


@register("clean_tokens")
def q_clean_tokens(spark, sf):
    return P.clean_tokens(docs(spark, sf))


@register("rejoin_text")
def q_rejoin_text(spark, sf):
    return P.rejoin_text(docs(spark, sf))


@register("concat_subsets")
def q_concat_subsets(spark, sf):
    return P.rejoin_text(newsgroup_corpus(spark, sf), keys=("doc_id", "subset"))


# ------------------------------------------------------------------ vocabulary

@register("document_frequency")
def q_document_frequency(spark, sf):
    return ng(spark, sf).dfreq.select("word", "df")


@register("df_range_filter")
def q_df_range_filter(spark, sf):
    return ng(spark, sf).pruned.select("word", "df")


@register("remove_stops")
def q_remove_stops(spark, sf):
    return ng(spark, sf).candidates.select("word", "df")


@register("order_vocab_by_df")
def q_order_vocab(spark, sf):
    cand = ng(spark, sf).candidates.select("word", "df")
    return global_row_number(cand, ["df", "word"], name="rank").select("rank", "word", "df")


@register("distinct_train_words")
def q_distinct_train_words(spark, sf):
    return V.distinct_train_words(ng(spark, sf).words.where(F.col("split") == "tr"))


@register("vocab_in_train")
def q_vocab_in_train(spark, sf):
    p = ng(spark, sf)
    train_words = V.distinct_train_words(p.words.where(F.col("split") == "tr"))
    return V.vocab_in_train(p.candidates.select("word", "df"), train_words)


@register("assign_ids")
def q_assign_ids(spark, sf):
    return ng(spark, sf).vocab


@register("vocab_report")
def q_vocab_report(spark, sf):
    p = ng(spark, sf)
    return V.vocab_report({"initial": p.pruned, "after_stops": p.candidates, "in_train": p.vocab})


# ------------------------------------------------------------------ splits and encoding

@register("split_holdout")
def q_split_holdout(spark, sf):
    return S.split_holdout(newsgroup_corpus(spark, sf)).select("doc_id", "split")


@register("split_fractions")
def q_split_fractions(spark, sf):
    return S.split_fractions(docs(spark, sf)).select("doc_id", "split")


@register("encode_tokens")
def q_encode_tokens(spark, sf):
    p = ng(spark, sf)
    return S.encode_text(p.assigned, p.vocab).select("doc_id", "pos", "token_id", "n_tokens")


@register("drop_empty_docs")
def q_drop_empty_docs(spark, sf):
    p = ng(spark, sf)
    enc = S.drop_empty_docs(S.encode_text(p.assigned, p.vocab, carry=("split",)))
    return enc.where(F.col("pos") == 0).select("doc_id", "split")


@register("drop_single_token_tests")
def q_drop_single(spark, sf):
    return ng(spark, sf).encoded.where(F.col("pos") == 0).select("doc_id", "split")


@register("reindex_docs")
def q_reindex_docs(spark, sf):
    return ng(spark, sf).doc_index.select("doc_id", "split", "doc_ix")


@register("split_halves")
def q_split_halves(spark, sf):
    rows = B.split_rows(ng(spark, sf).encoded)
    return rows.where(F.col("split").isin("ts_h1", "ts_h2")).select(
        "doc_id", F.col("split").alias("half"), "pos", "token_id")


# ------------------------------------------------------------------ bag of words

@register("bag_of_words")
def q_bag_of_words(spark, sf):
    return ng(spark, sf).bow()


@register("pack_bow")
def q_pack_bow(spark, sf):
    return ng(spark, sf).packed()


@register("unpack_bow")
def q_unpack_bow(spark, sf):
    return B.unpack_bow(ng(spark, sf).packed())


@register("doc_lengths")
def q_doc_lengths(spark, sf):
    return B.doc_lengths(ng(spark, sf).packed())


@register("flatten_words")
def q_flatten_words(spark, sf):
    p = ng(spark, sf)
    rows = B.attach_doc_index(B.split_rows(p.encoded), p.doc_index)
    return rows.select("split", "doc_ix", "pos", "token_id")


@register("split_report")
def q_split_report(spark, sf):
    return B.split_report(ng(spark, sf).bow())


@register("normalize_bow")
def q_normalize_bow(spark, sf):
    packed = B.normalize_bow(ng(spark, sf).packed())
    z = packed.select("split", "doc_ix", F.explode(F.arrays_zip("tokens", "weights")).alias("z"))
    return z.select("split", "doc_ix", F.col("z.tokens").alias("token_id"),
                    round6(F.col("z.weights")).alias("weight"))


@register("bow_store")
def q_bow_store(spark, sf):
    path = stores.write_bow(ng(spark, sf).packed(), scratch_path(spark, "bow"))
    return stores.read_bow(spark, path)


@register("vocab_store")
def q_vocab_store(spark, sf):
    path = stores.write_vocab(ng(spark, sf).vocab, scratch_path(spark, "vocab"))
    return stores.read_vocab(spark, path).select("token_id", "word", "df")


@register("prepare_newsgroup_style")
def q_prepare_newsgroup(spark, sf):
    p = ng(spark, sf)
    return p.bow().join(p.vocab.select("token_id", "word"), "token_id").select(
        "split", "doc_ix", "word", "cnt")


@register("dictionary_to_vocab")
def q_dictionary_to_vocab(spark, sf):
    d = docs(spark, sf)
    return L.dictionary_to_vocab(L.build_dictionary(d), read_stops(spark), unique_words=True).select("token_id", "word")


@register("prepare_lines_style")
def q_prepare_lines(spark, sf):
    return lines_prepared(spark, sf).bow()


def round6(c):
    return snap(c, 1e6)


# ------------------------------------------------------------------ model scoring and analytics

from ..operators import evaluate as EV  # noqa: E402
from ..operators import model as M  # noqa: E402
from ..sources import fixtures as FX  # noqa: E402
from . import params as PR  # noqa: E402
from .report import ModelContext, eval_report, model_context, query_words  # noqa: E402


def round_q(c, q: float = 1e6):
    return snap(c, q)


def ctx_of(spark, sf) -> ModelContext:
    return model_context(spark, sf)


def _long_topics(df: DataFrame, arr: str, out: str, topics: list[int], keys=("split", "doc_ix"),
                 q: float = 1e9) -> DataFrame:
    tl = F.array(*[F.lit(t) for t in topics])
    z = df.select(*keys, F.explode(F.arrays_zip(tl.alias("topic"), F.col(arr).alias("v"))).alias("z"))
    return z.select(*keys, F.col("z.topic").alias("topic"), round_q(F.col("z.v"), q).alias(out))


@register("topic_word_dist")
def q_topic_word_dist(spark, sf):
    c = ctx_of(spark, sf)
    return c.beta_long.select("topic", "token_id", "dot", round_q(F.col("p"), 1e12).alias("p"))


@register("topic_top_words")
def q_topic_top_words(spark, sf):
    c = ctx_of(spark, sf)
    top = EV.topic_top_words(c.beta_long, EV.listed_words(PR.NUM_WORDS), c.prepared.vocab)
    return top.select("topic", "rank", "token_id", "word")


@register("decode_ids")
def q_decode_ids(spark, sf):
    p = ng(spark, sf)
    return V.lookup(p.bow(), p.vocab, on="token_id").select("split", "doc_ix", "token_id", "word", "cnt")


@register("topic_diversity")
def q_topic_diversity(spark, sf):
    c = ctx_of(spark, sf)
    return EV.topic_diversity(c.beta_long, PR.DIVERSITY_WORDS).select(
        round_q(F.col("diversity")).alias("diversity"))


@register("nearest_words")
def q_nearest_words(spark, sf):
    c = ctx_of(spark, sf)
    nn = EV.nearest_words(c.rho, query_words(c), PR.NEIGHBOURS)
    return nn.select("query_id", "rank", "token_id", round_q(F.col("cos"), 1e9).alias("cos"))


@register("encode_docs")
def q_encode_docs(spark, sf):
    c = ctx_of(spark, sf)
    e = c.encoded("tr", "va", "ts").select("split", "doc_ix", F.arrays_zip("mu", "logsigma").alias("both"))
    tl = F.array(*[F.lit(t) for t in c.topics])
    z = e.select("split", "doc_ix", F.explode(F.arrays_zip(tl.alias("topic"), "both")).alias("z"))
    return z.select("split", "doc_ix", F.col("z.topic").alias("topic"), round_q(F.col("z.both.mu"), 1e9).alias("mu"),
                    round_q(F.col("z.both.logsigma"), 1e9).alias("logsigma"))


@register("infer_theta")
def q_infer_theta(spark, sf):
    c = ctx_of(spark, sf)
    return _long_topics(c.encoded("tr", "va", "ts"), "theta", "theta", c.topics)


@register("softmax")
def q_softmax(spark, sf):
    c = ctx_of(spark, sf)
    e = c.encoded("tr", "va", "ts").select("split", "doc_ix", M.softmax_array("mu").alias("sm"))
    return _long_topics(e, "sm", "theta", c.topics)


@register("reparameterize")
def q_reparameterize(spark, sf):
    c = ctx_of(spark, sf)
    e = c.encoded("tr").select("split", "doc_ix", M.reparameterize(seed=PR.SEED, step=0).alias("z"))
    return _long_topics(e, "z", "z", c.topics, q=1e6)


@register("kl_divergence")
def q_kl_divergence(spark, sf):
    c = ctx_of(spark, sf)
    kl = M.kl_divergence(c.encoded("tr", "va", "ts"))
    return kl.groupBy("split").agg(round_q(F.avg("kl")).alias("kl"))


def _elbo(c: ModelContext) -> DataFrame:
    return M.elbo_forward(c.encoded("tr", "va", "ts", carry=True), c.beta_side())


@register("reconstruction_loss")
def q_reconstruction_loss(spark, sf):
    c = ctx_of(spark, sf)
    e = M.reconstruction_loss(c.encoded("tr", "va", "ts", carry=True), None, c.beta_side())
    return e.select("split", "doc_ix", round_q(F.col("rec")).alias("rec"))


@register("elbo_forward")
def q_elbo_forward(spark, sf):
    e = _elbo(ctx_of(spark, sf))
    return e.select("split", "doc_ix", round_q(F.col("rec")).alias("rec"),
                    round_q(F.col("kl")).alias("kl"), round_q(F.col("nelbo")).alias("nelbo"))


@register("nelbo")
def q_nelbo(spark, sf):
    e = _elbo(ctx_of(spark, sf))
    return e.groupBy("split").agg(round_q(F.avg("rec")).alias("rec"), round_q(F.avg("kl")).alias("kl"),
                                  round_q(F.avg("rec") + F.avg("kl")).alias("nelbo"))


@register("theta_beta_join")
def q_theta_beta_join(spark, sf):
    c = ctx_of(spark, sf)
    probs = M.word_probabilities(c.encoded("tr", "va", "ts", carry=True), None, c.beta_side())
    return probs.select("split", "doc_ix", "token_id", "cnt", round_q(F.col("p"), 1e12).alias("p"))


@register("doc_completion_ppl")
def q_doc_completion_ppl(spark, sf):
    c = ctx_of(spark, sf)
    h2 = c.packed().where(F.col("split") == "ts_h2")
    r = EV.doc_completion_ppl(h2, c.encoded("ts_h1"), c.beta_side(), PR.EVAL_BATCH)
    return r.select(round_q(F.col("loss")).alias("loss"), "ppl")


@register("topic_usage")
def q_topic_usage(spark, sf):
    c = ctx_of(spark, sf)
    u = EV.topic_usage(c.encoded("tr"), c.topics)
    return u.select("topic", round_q(F.col("mean"), 1e9).alias("mean"))


@register("topic_usage_weighted")
def q_topic_usage_weighted(spark, sf):
    c = ctx_of(spark, sf)
    u = EV.topic_usage(c.encoded("tr"), c.topics)
    return u.select("topic", round_q(F.col("weighted"), 1e9).alias("weighted"))


@register("top_used_topics")
def q_top_used_topics(spark, sf):
    c = ctx_of(spark, sf)
    u = EV.topic_usage(c.encoded("tr"), c.topics)
    return EV.top_used_topics(u, 10).select("topic", round_q(F.col("weighted"), 1e9).alias("weighted"))


@register("topic_coherence")
def q_topic_coherence(spark, sf):
    c = ctx_of(spark, sf)
    coh = EV.topic_coherence(c.beta_long, c.bow().where(F.col("split") == "tr"), PR.TOP_WORDS)
    return coh.select(F.col("topic").cast("bigint").alias("topic"),
                      round_q(F.col("coherence")).alias("coherence"))


@register("eval_report")
def q_eval_report(spark, sf):
    return eval_report(ctx_of(spark, sf))


@register("sample_topics")
def q_sample_topics(spark, sf):
    return EV.sample_topics(FX.alpha(spark, sf), 10, PR.SEED)


@register("activation")
def q_activation(spark, sf):
    ev = table(spark, sf, "events").select("event_id", ((F.col("value") - 25.0) / 10.0).alias("x"))
    names = [a for a in M.ACTIVATIONS if a != "glu"]
    cols = F.array(*[F.struct(F.lit(n).alias("act"), M.activation(n, F.col("x")).alias("y"))
                     for n in names])
    z = ev.select("event_id", F.explode(cols).alias("z"))
    return z.select("event_id", F.col("z.act").alias("act"), round_q(F.col("z.y"), 1e9).alias("y"))


def _raw_vectors(spark, sf, p: Prepared) -> DataFrame:
    """A 'pre-trained vectors file' over every cleaned corpus word (a superset of the
    vocabulary): words whose md5 draw is even get the embedding at draw % n_vec."""
    e = FX.embeddings_q(spark, sf)
    n_vec = e.count()
    from ..functions.hashing import hash48
    h = hash48(F.col("word"))
    w = p.dfreq.select("word", h.alias("h")).where(F.pmod("h", F.lit(2)) == 0)
    return (w.select("word", F.pmod("h", F.lit(n_vec)).alias("vec_id"), F.lit(0).cast("bigint").alias("line_no"))
            .join(broadcast_if_small(e.select("vec_id", "qvec")), "vec_id")
            .select("word", "line_no",
                    F.transform("qvec", lambda q: q / F.lit(float(PR.QUANT))).alias("vec")))


@register("vectors_in_vocab")
def q_vectors_in_vocab(spark, sf):
    from ..sources.corpus import vectors_in_vocab
    p = ng(spark, sf)
    return vectors_in_vocab(_raw_vectors(spark, sf, p), p.vocab).select("word", "vec")


def _init(spark, sf):
    from ..sources.corpus import vectors_in_vocab
    p = ng(spark, sf)
    vecs = vectors_in_vocab(_raw_vectors(spark, sf, p), p.vocab)
    return EV.init_embeddings(p.vocab, vecs, 64, PR.SEED)


@register("init_embeddings")
def q_init_embeddings(spark, sf):
    i = _init(spark, sf)
    return i.select("token_id", "word", "hit", F.transform("vec", lambda x: round_q(x)).alias("vec"))


@register("embedding_coverage")
def q_embedding_coverage(spark, sf):
    c = EV.embedding_coverage(_init(spark, sf))
    return c.select(F.col("hits").cast("bigint").alias("hits"), F.col("vocab_size").cast("bigint").alias("vocab_size"),
                    round_q(F.col("share")).alias("share"))


# ------------------------------------------------------------------ sentence topic knowledge

from ..operators import metrics_log as ML  # noqa: E402
from ..operators import parallel as PA  # noqa: E402
from ..operators import sentence as SE  # noqa: E402

STATE_WIDTH = 64


class SentenceContext:
    """Tables shared by the sentence queries: dictionary (documents), topic vocabulary and rho
    (newsgroup-style preparation), conversation sentences and their dictionary tokens."""

    def __init__(self, spark, sf):
        self.p = ng(spark, sf)
        self.rho = FX.rho(spark, sf, self.p.vocab)
        self.dictionary = L.build_dictionary(docs(spark, sf))
        self.sentences = FX.conversation_sentences(spark, sf)
        self.proj = SE.Projection(STATE_WIDTH, STATE_WIDTH)
        self.spark, self.sf = spark, sf

    # built on first use: the size checks behind their broadcasts are Spark actions, and the
    # binarised path (score_sentences) needs neither
    @functools.cached_property
    def tokens(self):
        return FX.sent_tokens(self.sentences, self.dictionary)

    @functools.cached_property
    def mapped(self):
        return SE.dict_to_topic_id(self.tokens, self.dictionary, self.p.vocab)

    @functools.cached_property
    def qsum(self):
        return SE.sentence_topic_qsum(self.mapped, self.rho, self.sentences, STATE_WIDTH)

    @functools.cached_property
    def state_vectors(self):
        return FX.state_vectors(self.spark, self.sf)

    def topic_vec(self):
        return SE.sentence_topic_vector(self.mapped, self.rho, self.sentences, STATE_WIDTH)

    def projected(self):
        return SE.project_topic(self.qsum, self.proj)

    def states(self, shift=0):
        return FX.token_states(self.spark, self.sf, self.tokens, shift, self.state_vectors)


def snap_vec(col, q=1e9):
    return F.transform(col, lambda x: snap(x, q))


@register("dict_to_topic_id")
def q_dict_to_topic_id(spark, sf):
    return SentenceContext(spark, sf).mapped.select("sent_id", "pos", "tok", "token_id")


@register("sentence_topic_vector")
def q_sentence_topic_vector(spark, sf):
    return SentenceContext(spark, sf).topic_vec()


@register("project_topic")
def q_project_topic(spark, sf):
    return SentenceContext(spark, sf).projected().select("sent_id", snap_vec("proj").alias("proj"))


@register("add_topic_pre")
def q_add_topic_pre(spark, sf):
    c = SentenceContext(spark, sf)
    return SE.add_topic_pre(c.states(0), c.projected(), snap_q=1e9)


@register("add_topic_post")
def q_add_topic_post(spark, sf):
    c = SentenceContext(spark, sf)
    return SE.add_topic_post(c.states(1), c.projected(), snap_q=1e9)


@register("add_topic_decoder")
def q_add_topic_decoder(spark, sf):
    c = SentenceContext(spark, sf)
    return SE.add_topic_decoder(c.states(0), c.topic_vec(), snap_q=1e9)


@register("add_topic_decoder_step")
def q_add_topic_decoder_step(spark, sf):
    c = SentenceContext(spark, sf)
    return SE.add_topic_decoder_step(c.states(0), c.mapped, c.rho).select(
        "sent_id", "pos", snap_vec("x").alias("x"))


@register("topic_mode")
def q_topic_mode(spark, sf):
    c = SentenceContext(spark, sf)
    c.qsum.persist()                                     # one vector a sentence, read by all three places
    plain = c.states(0)
    out = SE.apply_topics({"pre", "post", "decoder"}, states=plain, enc_out=c.states(1), dec_states=plain,
                          projected=c.projected(), target_vec=SE.topic_vectors(c.qsum), snap_q=1e9)
    parts = [out[k].select(F.lit(k).alias("stage"), "sent_id", "pos", "x")
             for k in ("encoder_in", "encoder_out", "decoder")]
    return functools.reduce(DataFrame.unionByName, parts)


@register("score_sentences")
def q_score_sentences(spark, sf):
    """Binarise (reserved ids first) → map to topic ids with the matching offset → sentence vectors →
    projection → all three places: token states before the encoder, encoder outputs (both projected), and
    decoder states (the unprojected sum)."""
    c = SentenceContext(spark, sf)
    bin_toks = PA.binarize(c.sentences, c.dictionary, key="sent_id")
    mapped = SE.dict_to_topic_id(bin_toks, c.dictionary, c.p.vocab, id_offset=PA.N_RESERVED)
    q = SE.sentence_topic_qsum(mapped, c.rho, c.sentences, STATE_WIDTH).persist()
    plain = FX.token_states(spark, sf, bin_toks, 0, c.state_vectors)
    out = SE.apply_topics({"pre", "post", "decoder"}, states=plain, enc_out=FX.token_states(spark, sf, bin_toks, 1, c.state_vectors),
                          dec_states=plain, projected=SE.project_topic(q, c.proj), target_vec=SE.topic_vectors(q), snap_q=1e9)
    parts = [out[k].select(F.lit(k).alias("stage"), "sent_id", "pos", "x") for k in ("encoder_in", "encoder_out", "decoder")]
    return functools.reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ parallel corpus

@register("joined_dictionary")
def q_joined_dictionary(spark, sf):
    return PA.joined_dictionary(FX.pairs(spark, sf))


@register("binarize")
def q_binarize(spark, sf):
    """B1 on both sides of the pairs with their joined dictionary."""
    pr = FX.pairs(spark, sf)
    dictionary = PA.joined_dictionary(pr).persist()
    sides = [PA.binarize(pr.select("pair_id", F.col(s).alias("text")), dictionary, key="pair_id").select(
        F.lit(s).alias("side"), "pair_id", "pos", "tok") for s in ("src", "tgt")]
    return sides[0].unionByName(sides[1])


@register("strip_subword_marks")
def q_strip_subword_marks(spark, sf):
    s = FX.conversation_sentences(spark, sf)
    return PA.strip_subword_marks(s, "text").select("sent_id", "text")


@register("max_length_filter")
def q_max_length_filter(spark, sf):
    return PA.max_length_filter(FX.pairs(spark, sf)).select("pair_id")


@register("corpus_bleu")
def q_corpus_bleu(spark, sf):
    b = PA.corpus_bleu(FX.hyps(FX.pairs(spark, sf)))
    return b.select(*[snap(F.col(c), 1e9).alias(c) if c not in ("hyp_len", "ref_len") else F.col(c)
                      for c in b.columns])


# ------------------------------------------------------------------ training logs

@register("running_loss")
def q_running_loss(spark, sf):
    return ML.running_loss(FX.train_log(spark, sf), log_interval=2)


@register("best_epoch")
def q_best_epoch(spark, sf):
    return ML.best_epoch(FX.val_log(spark, sf)).select(
        "run_id", "epoch", snap(F.col("val_ppl"), 1e9).alias("val_ppl"), "improved", "kept")


@register("anneal_trigger")
def q_anneal_trigger(spark, sf):
    return ML.anneal_trigger(FX.val_log(spark, sf), nonmono=10, lr=0.005, lr_factor=4.0).select(
        "run_id", "epoch", "trigger", snap(F.col("lr"), 1e12).alias("lr"))


# ------------------------------------------------------------------ fitting (N-checked) and stores

from ..operators import fit as FT  # noqa: E402


def _state(c: ModelContext) -> FT.TopicModel:
    return FT.initial_model(c.params, c.rho, c.alpha, c.act)


@register("batches")
def q_batches(spark, sf):
    """The first epoch's batches of the training documents, read back from the epoch's layout."""
    tr = ctx_of(spark, sf).packed().where(F.col("split") == "tr").select("doc_ix", "tokens", "counts")
    layout = FT.EpochLayout(FT.epoch_batches(tr, 1, PR.TRAIN_BATCH, PR.SEED))
    return layout.rows.select(F.col("batch").cast("bigint").alias("batch"), "doc_ix", F.size("tokens").cast("bigint").alias("n_tokens"))


@register("elbo_gradient")
def q_elbo_gradient(spark, sf):
    """T5 over all training documents at the initial parameters: summed gradient blocks."""
    c = ctx_of(spark, sf)
    tr = c.packed().where(F.col("split") == "tr")
    g = FT.elbo_gradient(tr.select("doc_ix", "tokens", "counts"), _state(c), PR.SEED, 0).table()
    return g.select("name", "i", snap_vec("vec", 1e4).alias("vec"))


@register("fit_topics")
def q_fit_topics(spark, sf):
    """Three epochs asked = two passes (reference loop), Adam, batch 1000, annealing on; a version of
    model and optimiser is committed after each."""
    c = ctx_of(spark, sf)
    p = c.packed()
    store = stores.ModelStore(spark, scratch_path(spark, "fit"))
    _, train_rows, val_rows = FT.fit_topics(
        p.where(F.col("split") == "tr"), p.where(F.col("split") == "ts_h1"), p.where(F.col("split") == "ts_h2"), _state(c),
        epochs=3, batch_size=PR.EVAL_BATCH, anneal_lr=True, seed=PR.SEED,
        on_epoch=lambda state, improved: store.commit(state.tables(), state.record(), state.history[-1]))
    rows = [("train", e, b, r, k, None, lr) for e, b, r, k, lr in train_rows]
    rows += [("valid", e, None, None, None, v, lr) for e, v, lr in val_rows]
    return spark.createDataFrame(rows, "kind string, epoch int, batch int, rec double, kl double, "
                                       "val_ppl double, lr double")


@register("fit_word_vectors")
def q_fit_word_vectors(spark, sf):
    """Skip-gram vectors over the cleaned training documents: the documented command, width 300, window 4,
    50 passes."""
    p = ng(spark, sf)
    words = p.words.where(F.col("split") == "tr").select("words")
    v = FT.fit_word_vectors(words, min_count=PR.MIN_DF)
    return v.select("word", F.size("vec").alias("width"), "vec")


@register("model_store")
def q_model_store(spark, sf):
    """Commit a version of the initial model (parameters, word and topic vectors as doubles, optimiser
    state), then read back the version the manifest names as the last."""
    c = ctx_of(spark, sf)
    start = FT.FitState.start(_state(c), FT.Rule())
    store = stores.ModelStore(spark, scratch_path(spark, "model"))
    store.commit(start.tables(), start.record() | {"num_topics": len(c.topics), "t_hidden_size": PR.HIDDEN}, start.best)
    tables, record = store.last()
    assert record["t_hidden_size"] == PR.HIDDEN
    parts = [tables["params"].select("name", "i", "vec"),
             tables["rho"].select(F.lit("rho").alias("name"), F.col("token_id").alias("i"), "vec"),
             tables["alpha"].select(F.lit("alpha").alias("name"), F.col("topic").cast("bigint").alias("i"), "vec")]
    return functools.reduce(DataFrame.unionByName, parts).select("name", "i", snap_vec("vec").alias("vec"))


@register("topic_words_sink")
def q_topic_words_sink(spark, sf):
    """Append the listed top words of every topic; read the appended table back."""
    c = ctx_of(spark, sf)
    top = EV.topic_top_words(c.beta_long, EV.listed_words(PR.NUM_WORDS), c.prepared.vocab)
    path = scratch_path(spark, "topic_words")
    stores.append_topic_words(top, path)
    return spark.read.parquet(path).select("topic", "words")


@register("embedding_sink")
def q_embedding_sink(spark, sf):
    """Write the model's word embeddings as the doubles they are and read them back."""
    path = scratch_path(spark, "embeddings")
    stores.write_embeddings(_state(ctx_of(spark, sf)).rho, path)
    return spark.read.parquet(path).select("token_id", "vec")
