"""Model and side tables derived from the driver tables (FIXTURES.md).

All are pure functions of the given tables, so their work grows with the data:

* ``rho``    word embeddings: ``embeddings.embedding`` at ``vec_id = token_id % n_vec``,
             integer-quantised (``qvec``, step 1e-6) so dot products are exact in any engine.
* ``alpha``  topic embeddings: per ``embeddings.label`` the sum of quantised vectors; the real
             value is ``qsum / (10 · 1e6)``.
* ``params`` encoder weights ``(name, i, vec)``, row ``i`` = input index, ``vec`` over outputs,
             cell = ``(hash48(name:i:j) % 2001 - 1000) / 1000``.
* ``vectors`` pre-trained vectors for the even token ids only (so the fallback is exercised).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import key, param_cell
from ..functions.ranking import broadcast_if_small
from ..functions.vectors import LookedUp, VectorBlocks
from ..plans.params import HIDDEN, QUANT
from .corpus import table

ALPHA_DIVISOR = 10


def quantised(arr: str = "embedding"):
    return F.transform(arr, lambda x: F.floor(x.cast("double") * F.lit(float(QUANT)) + F.lit(0.5))
                       .cast("bigint"))


def embeddings_q(spark: SparkSession, sf: str) -> DataFrame:
    """``(vec_id, label, qvec ARRAY<BIGINT>)``."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("bigint"), F.col("label").cast("int"),
                    quantised().alias("qvec"))


def rho(spark: SparkSession, sf: str, vocab: DataFrame) -> DataFrame:
    """``rho(token_id, qvec)``: the embedding table (one row per vector id) is broadcast to the
    vocabulary when its counted size is under the broadcast limit, else shuffle-joined."""
    e = embeddings_q(spark, sf)
    n_vec = e.count()
    return (vocab.select("token_id", F.pmod("token_id", F.lit(n_vec)).alias("vec_id"))
            .join(broadcast_if_small(e.select("vec_id", "qvec")), "vec_id")
            .select("token_id", "qvec"))


def alpha(spark: SparkSession, sf: str) -> DataFrame:
    """``alpha(topic, qsum)``: element-wise sum of the quantised vectors of each label."""
    e = embeddings_q(spark, sf)
    cells = e.select("label", F.posexplode("qvec").alias("d", "q"))
    sums = cells.groupBy("label", "d").agg(F.sum("q").cast("bigint").alias("s"))
    rows = sums.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "s"))).alias("_a"))
    return rows.select(F.col("label").alias("topic"),
                       F.transform("_a", lambda x: x["s"]).alias("qsum"))


def param_matrix(spark: SparkSession, name: str, rows: DataFrame | int, width: int) -> DataFrame:
    """``(name, i, vec)`` with ``width`` md5 cells per input row. ``rows`` is either a count or
    a frame whose ``token_id`` column enumerates the input rows (layer 1 is vocabulary-wide)."""
    if isinstance(rows, int):
        idx = spark.range(rows).select(F.col("id").alias("i"))
    else:
        idx = rows.select(F.col("token_id").alias("i"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                      lambda j: param_cell(key(name, F.col("i"), j)))
    return idx.select(F.lit(name).alias("name"), F.col("i").cast("bigint"), vec.alias("vec"))


def encoder_params(spark: SparkSession, vocab: DataFrame, num_topics: int,
                   hidden: int = HIDDEN) -> DataFrame:
    """All encoder weights: W1 (V×H), b1, W2 (H×H), b2, Wmu / Ws (H×K), bmu / bs."""
    parts = [
        param_matrix(spark, "W1", vocab, hidden),
        param_matrix(spark, "b1", 1, hidden),
        param_matrix(spark, "W2", hidden, hidden),
        param_matrix(spark, "b2", 1, hidden),
        param_matrix(spark, "Wmu", hidden, num_topics),
        param_matrix(spark, "bmu", 1, num_topics),
        param_matrix(spark, "Ws", hidden, num_topics),
        param_matrix(spark, "bs", 1, num_topics),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ sentences and parallel text

def conversation_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """``(sent_id, conv_id, turn, role, text)`` with ``sent_id = conv_id · 1000 + turn``."""
    c = table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("sent_id"),
                    "conv_id", "turn", "role", "text")


def sent_tokens(sentences: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``(sent_id, pos, tok)``: white-space tokens with their dictionary id; a token missing from
    the dictionary gets the first id beyond it (so the out-of-range rule is exercised)."""
    from ..functions.text import whitespace_tokens
    n_dict = dictionary.count()
    toks = sentences.select("sent_id", F.posexplode(whitespace_tokens(F.col("text"))).alias("pos", "word"))
    side = broadcast_if_small(dictionary.select("word", "id"))
    return toks.join(side, "word", "left").select(
        "sent_id", F.col("pos").cast("bigint").alias("pos"),
        F.coalesce(F.col("id"), F.lit(n_dict)).cast("bigint").alias("tok"))


def state_vectors(spark: SparkSession, sf: str) -> tuple[int, VectorBlocks]:
    """The number of embeddings and their blocks, which all states of a query share."""
    e = embeddings_q(spark, sf)
    return e.count(), VectorBlocks(e, "vec_id", "qvec")


def token_states(spark: SparkSession, sf: str, tokens: DataFrame, shift: int = 0,
                 vectors: tuple[int, VectorBlocks] | None = None) -> LookedUp:
    """``(sent_id, pos, x)``: the state of a token is the embedding at ``(tok + shift) % n_vec``
    (shift 0: embeddings; shift 1: stand-in encoder outputs), held by reference to the embedding."""
    n_vec, blocks = state_vectors(spark, sf) if vectors is None else vectors
    rows = tokens.select("sent_id", "pos", "tok")
    return LookedUp(rows, "vec_id", blocks, float(QUANT), F.pmod(F.col("tok") + F.lit(shift), F.lit(n_vec)))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``(pair_id, src, tgt)``: a user turn and the assistant turn right after it.
    Turns of one conversation are joined on (conv_id, turn + 1)."""
    c = table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    return u.join(a, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("pair_id"), "src", "tgt")


def hyps(pair_df: DataFrame, every: int = 7) -> DataFrame:
    """``(pair_id, hyp, ref)``: ref = target; hyp = target without every ``every``-th token."""
    from ..functions.text import whitespace_tokens
    toks = whitespace_tokens(F.col("tgt"))
    kept = F.filter(toks, lambda w, i: (i + 1) % every != 0)
    return pair_df.select("pair_id", F.array_join(kept, " ").alias("hyp"),
                          F.array_join(toks, " ").alias("ref"))


# ------------------------------------------------------------------ training logs

def train_log(spark: SparkSession, sf: str) -> DataFrame:
    """``(run_id, epoch, batch_key, rec_c)``: one row per event; epoch = day number (1-based) of
    ``ts``; batches are ordered by ``event_id`` within the day; ``rec`` = value kept as exact
    hundredths ``rec_c`` (kl = value / 10 is ``rec_c`` thousandths)."""
    ev = table(spark, sf, "events")
    day0 = ev.agg(F.min(F.to_date("ts")).alias("d0")).first()["d0"]
    return ev.select(F.lit(0).alias("run_id"),
                     (F.datediff(F.to_date("ts"), F.lit(day0)) + 1).alias("epoch"),
                     F.col("event_id").alias("batch_key"),
                     F.round(F.col("value") * 100).cast("bigint").alias("rec_c"))


def val_log(spark: SparkSession, sf: str) -> DataFrame:
    """``(run_id, epoch, val_ppl)``: daily mean of ``value`` (computed from exact hundredths)."""
    t = train_log(spark, sf)
    return t.groupBy("run_id", "epoch").agg(
        ((F.sum("rec_c") / F.count(F.lit(1))) / F.lit(100.0)).alias("val_ppl"))
