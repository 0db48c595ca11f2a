"""Topic-model scoring operators.

* Topic–word distribution (T1): beta_k = softmax over the vocabulary of rho·alpha_k. The K topic
  vectors are model-sized constants: they are broadcast once and multiplied into each vocabulary
  block (no join); one mergeable (maximum, scaled sum) aggregate finds the normalisers in one scan.
* Encoder (T2/T3): ``mapInArrow`` over packed bag-of-words with the weights shipped once as a
  Spark broadcast variable (dense NumPy); layer 1 is a sparse-row product. A first layer (V×H)
  above a byte limit stays a table and is joined by token.
* Word probabilities (J6) are evaluated only at the (document, word) cells present, in the packed row
  that holds the document's tokens and theta; beta comes in vocabulary blocks, so no exchange carries it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import key, normal
from ..functions.ranking import lookup_join, measured_bytes
from ..functions.vectors import KEPT_BYTES, Shipped, arrow_list, arrow_matrix
from ..plans.params import QUANT
from ..sources.fixtures import ALPHA_DIVISOR

FIRST_LAYER_BYTES = 512 << 20             # a larger vocabulary-wide layer is joined by token, not shipped
BLOCK_BYTES = 32 << 20                    # vocabulary-wide tables are shipped in blocks of at most this
CELL_VALUES = 1 << 22                     # (cell, topic) values handled at once in a task

# --- fixed values: activation constants (public definitions) -------------------------------------
LEAKY_SLOPE = 0.01
RRELU_EVAL_SLOPE = (1.0 / 8.0 + 1.0 / 3.0) / 2.0   # mean of the default bounds 1/8 and 1/3
ELU_ALPHA = 1.0
SELU_ALPHA = 1.6732632423543772848170429916717
SELU_SCALE = 1.0507009873554804934193349852946
SOFTPLUS_THRESHOLD = 20.0
ACTIVATIONS = ("tanh", "relu", "softplus", "rrelu", "leakyrelu", "elu", "selu", "glu")
# -------------------------------------------------------------------------------------------------


def idot(a, b) -> Column:
    """Exact dot product of two BIGINT arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"),
                       lambda acc, v: acc + v)


def ddot(a, b) -> Column:
    """Dot product of two DOUBLE arrays (sequential sum)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


# ------------------------------------------------------------------ activations (M3)

def activation(name: str, x: Column) -> Column:
    """Column form of each activation; unknown names fall back to tanh. ``rrelu`` uses its
    scoring-time slope. ``glu`` needs a pair of columns: use :func:`glu`."""
    if name == "glu":
        raise ValueError("glu takes a pair of columns: use glu(a, b)")
    if name == "relu":
        return F.greatest(x, F.lit(0.0))
    if name == "softplus":
        return F.when(x > SOFTPLUS_THRESHOLD, x).otherwise(F.log1p(F.exp(x)))
    if name == "rrelu":
        return F.when(x >= 0, x).otherwise(x * F.lit(RRELU_EVAL_SLOPE))
    if name == "leakyrelu":
        return F.when(x >= 0, x).otherwise(x * F.lit(LEAKY_SLOPE))
    if name == "elu":
        return F.when(x > 0, x).otherwise(F.lit(ELU_ALPHA) * (F.exp(x) - 1))
    if name == "selu":
        return F.lit(SELU_SCALE) * F.when(x > 0, x).otherwise(F.lit(SELU_ALPHA) * (F.exp(x) - 1))
    return F.tanh(x)


def glu(a: Column, b: Column) -> Column:
    """Gated linear unit of a pair: a · sigmoid(b) (the layer width halves)."""
    return a / (F.lit(1.0) + F.exp(-b))


def np_activation(name: str, x: np.ndarray) -> np.ndarray:
    if name == "relu":
        return np.maximum(x, 0.0)
    if name == "softplus":
        return np.where(x > SOFTPLUS_THRESHOLD, x, np.log1p(np.exp(np.minimum(x, SOFTPLUS_THRESHOLD))))
    if name == "rrelu":
        return np.where(x >= 0, x, x * RRELU_EVAL_SLOPE)
    if name == "leakyrelu":
        return np.where(x >= 0, x, x * LEAKY_SLOPE)
    if name == "elu":
        return np.where(x > 0, x, ELU_ALPHA * np.expm1(np.minimum(x, 0)))
    if name == "selu":
        return SELU_SCALE * np.where(x > 0, x, SELU_ALPHA * np.expm1(np.minimum(x, 0)))
    if name == "glu":
        h = x.shape[-1] // 2
        return x[..., :h] / (1.0 + np.exp(-x[..., h:]))
    return np.tanh(x)


def np_activation_grad(name: str, x: np.ndarray) -> np.ndarray:
    """Derivative of the activation at the pre-activation ``x`` (used by the gradient). For ``glu`` the
    derivatives with respect to both halves, side by side."""
    if name == "relu":
        return (x > 0).astype(float)
    if name == "softplus":
        return np.where(x > SOFTPLUS_THRESHOLD, 1.0, 1.0 / (1.0 + np.exp(-x)))
    if name == "rrelu":
        return np.where(x >= 0, 1.0, RRELU_EVAL_SLOPE)
    if name == "leakyrelu":
        return np.where(x >= 0, 1.0, LEAKY_SLOPE)
    if name == "elu":
        return np.where(x > 0, 1.0, ELU_ALPHA * np.exp(np.minimum(x, 0)))
    if name == "selu":
        return SELU_SCALE * np.where(x > 0, 1.0, SELU_ALPHA * np.exp(np.minimum(x, 0)))
    if name == "glu":
        h = x.shape[-1] // 2
        gate = 1.0 / (1.0 + np.exp(-x[..., h:]))
        return np.concatenate([gate, x[..., :h] * gate * (1.0 - gate)], axis=-1)
    t = np.tanh(x)
    return 1.0 - t * t


# ------------------------------------------------------------------ softmax (M2)

def softmax_array(arr) -> Column:
    """Softmax along an array (max subtracted first)."""
    # each inner result is bound by a lambda, so that it is worked out once an array and not once an element
    let = lambda value, body: F.transform(F.array(value), body)[0]
    e = let(F.array_max(arr), lambda m: F.transform(arr, lambda v: F.exp(v - m)))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return let(e, lambda x: let(total(x), lambda s: F.transform(x, lambda v: v / s)))


# ------------------------------------------------------------------ topic-word distribution
#
# The K topic vectors are model-sized: every vocabulary partition multiplies its block of rho by
# alphaᵀ with one NumPy product (Arrow batches in ``mapInArrow``); Spark's higher-order array functions
# are interpreted per element and would be the slow path here. Nothing V-sized reaches the driver.

def _column(vectors: DataFrame, quantised: str) -> tuple[str, type]:
    """The vector column of a table and its NumPy type: exact integers, or doubles in ``vec``."""
    return (quantised, np.int64) if quantised in vectors.columns else ("vec", np.float64)


def _alpha_matrix(alpha: DataFrame) -> tuple[list[int], np.ndarray]:
    col, kind = _column(alpha, "qsum")
    rows = alpha.orderBy("topic").collect()          # K rows (model-sized)
    return [int(r["topic"]) for r in rows], np.array([list(r[col]) for r in rows], dtype=kind)


def _logits(rho: DataFrame, amat: np.ndarray):
    """Column of ``rho``, a function of its Arrow array to its dot products with all topics, and the
    scale of the dots. Integer tables give exact integer dots; a table of doubles is multiplied as it is."""
    col, kind = _column(rho, "qvec")
    whole = kind is np.int64 and amat.dtype == np.int64
    scale = (float(QUANT) if kind is np.int64 else 1.0) * (float(QUANT) * ALPHA_DIVISOR if amat.dtype == np.int64 else 1.0)

    def dots(values) -> np.ndarray:
        q = arrow_matrix(values, np.int64 if whole else np.float64).reshape(len(values), amat.shape[1])
        return q @ amat.T                              # exact for integers: |dot| < 2^63

    return col, dots, scale


def softmax_norms(rho: DataFrame, amat: np.ndarray, moments: bool = False):
    """``(m, s)`` per topic: the largest dot and the sum of ``exp((dot - m) / scale)`` over the
    vocabulary, in one scan; with ``moments`` also ``r``, the mean vector of rho under each topic's
    distribution (K x E). Each task folds its rows into one (maximum, scaled sums) per topic; two such are
    merged by rescaling the one with the smaller maximum, so K rows per task are all that moves."""
    import pyarrow as pa
    col, dots, scale = _logits(rho, amat)
    k, width = amat.shape
    unit = float(QUANT) if col == "qvec" else 1.0

    def fold(batches):
        m, s, r = None, np.zeros(k), np.zeros((k, width))
        for rb in batches:
            if not rb.num_rows:
                continue
            d = dots(rb.column(0))
            top = d.max(axis=0) if m is None else np.maximum(m, d.max(axis=0))
            shrink = np.ones(k) if m is None else np.exp((m - top).astype(np.float64) / scale)
            e = np.exp((d - top).astype(np.float64) / scale)
            s = s * shrink + e.sum(axis=0)
            if moments:
                r = r * shrink[:, None] + e.T @ (arrow_matrix(rb.column(0), np.float64) / unit)
            m = top
        if m is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(m), pa.array(s), arrow_list(r)],
                                             names=["k", "m", "s", "r"])

    kind = "bigint" if amat.dtype == np.int64 and col == "qvec" else "double"
    parts = rho.select(col).mapInArrow(fold, f"k int, m {kind}, s double, r array<double>")

    def merge(key, rows):
        m = rows["m"].max()
        shrink = np.exp((rows["m"].to_numpy() - m).astype(np.float64) / scale)
        r = np.einsum("p,pe->e", shrink, np.stack(rows["r"].to_numpy()))
        return pd.DataFrame({"k": [key[0]], "m": [m], "s": [float(shrink @ rows["s"].to_numpy())], "r": [r]})

    # a topic's group has one row for each task of the scan
    rows = parts.groupBy("k").applyInPandas(merge, parts.schema).collect()
    top, total, mean = np.zeros(k, dtype=np.int64 if kind == "bigint" else np.float64), np.zeros(k), np.zeros((k, width))
    for row in rows:
        top[row["k"]], total[row["k"]] = row["m"], row["s"]
        mean[row["k"]] = np.array(row["r"]) / row["s"]
    return (top, total, mean) if moments else (top, total)


def beta_by_token(rho: DataFrame, alpha: DataFrame) -> tuple[DataFrame, list[int]]:
    """T1 in per-token form ``(token_id, dots, beta ARRAY<DOUBLE>)``: beta[k] is softmax over the
    vocabulary of topic k, evaluated with the per-topic max subtracted: exp((dot − max) / scale) / Σ.
    ``rho(token_id, qvec | vec)`` and ``alpha(topic, qsum | vec)``: exact integers or doubles. Two scans
    of rho: the normalisers, then (lazily) beta."""
    import pyarrow as pa
    topics, amat = _alpha_matrix(alpha)
    col, dots, scale = _logits(rho, amat)
    top, total = softmax_norms(rho, amat)

    def emit(batches):
        for rb in batches:
            if rb.num_rows:
                d = dots(rb.column(1))
                b = np.exp((d - top).astype(np.float64) / scale) / total
                yield pa.RecordBatch.from_arrays([rb.column(0), arrow_list(d), arrow_list(b)],
                                                 names=["token_id", "dots", "beta"])

    kind = "bigint" if top.dtype == np.int64 else "double"
    out = rho.select(F.col("token_id").cast("bigint").alias("token_id"), col).mapInArrow(
        emit, f"token_id bigint, dots array<{kind}>, beta array<double>")
    return out, topics


def topic_word_dist(rho: DataFrame, alpha: DataFrame) -> DataFrame:
    """T1 long form ``(topic, token_id, dot, p)``."""
    bt, topics = beta_by_token(rho, alpha)
    return beta_long(bt, topics)


def beta_long(bt: DataFrame, topics: list[int]) -> DataFrame:
    """Long form of :func:`beta_by_token`."""
    tlit = F.array(*[F.lit(t) for t in topics])
    z = bt.select("token_id", F.explode(F.arrays_zip(tlit.alias("topic"), "dots", "beta")).alias("z"))
    return z.select(F.col("z.topic").alias("topic"), "token_id",
                    F.col("z.dots").alias("dot"), F.col("z.beta").alias("p"))


class DenseBlocks(Shipped):
    """``rows(token_id, vec)`` shipped to the tasks as dense vocabulary blocks of at most ``block_bytes``:
    ``(first id, broadcast matrix)`` each. The driver reads one block at a time, by Arrow."""

    def __init__(self, rows: DataFrame, size: int, width: int, block_bytes: int | None = None):
        super().__init__()
        rows = rows.toDF("token_id", "vec").select(F.col("token_id").cast("bigint").alias("token_id"), "vec")
        step = max((block_bytes or BLOCK_BYTES) // (8 * max(width, 1)), 1)
        for low in range(0, size, step):
            high = min(low + step, size)
            part = rows if step >= size else rows.where((F.col("token_id") >= low) & (F.col("token_id") < high))
            got = part.toArrow()
            matrix = np.zeros((high - low, width))
            if got.num_rows:
                matrix[got.column("token_id").to_numpy() - low] = arrow_matrix(got.column("vec"), np.float64)
            self.add(rows.sparkSession, matrix, matrix.nbytes)
            self.blocks[-1] = (low, self.blocks[-1])

    def values(self):
        for low, bc in self.blocks:
            yield low, bc.value
            if self.total > KEPT_BYTES:
                bc.__dict__.pop("_value", None)


class BetaBlocks(DenseBlocks):
    """``beta(token_id, beta)`` in vocabulary blocks."""

    def __init__(self, beta: DataFrame, block_bytes: int | None = None):
        rows = beta.select(F.col("token_id").cast("bigint").alias("token_id"), "beta")
        found = rows.agg(F.max("token_id").alias("top"), F.max(F.size("beta")).alias("k")).first()
        self.topics = found["k"] or 0
        super().__init__(rows, 0 if found["top"] is None else found["top"] + 1, self.topics, block_bytes)


def beta_lookup(bt: DataFrame, block_bytes: int | None = None) -> BetaBlocks:
    """The ``(token_id, beta)`` table as vocabulary blocks for :func:`word_probabilities`."""
    return BetaBlocks(bt, block_bytes)


# ------------------------------------------------------------------ encoder

ENCODER_SCHEMA = T.StructType([
    T.StructField("split", T.StringType()),
    T.StructField("doc_ix", T.LongType()),
    T.StructField("mu", T.ArrayType(T.DoubleType())),
    T.StructField("logsigma", T.ArrayType(T.DoubleType())),
    T.StructField("theta", T.ArrayType(T.DoubleType())),
    T.StructField("kl", T.DoubleType()),
    T.StructField("n_words", T.LongType()),
])


class EncoderWeights:
    """Encoder weights of a ``params(name, i, vec)`` table. The upper layers are model-sized NumPy
    matrices. The first layer is vocabulary-wide: one block of it is the matrix ``W1``, several are shipped as
    ``blocks``, and beyond a limit of its measured bytes it stays the table ``first(token_id, vec)``."""

    NAMES = ("W1", "b1", "W2", "b2", "Wmu", "bmu", "Ws", "bs")

    def __init__(self, mats: dict[str, np.ndarray], first: DataFrame | None = None, blocks: DenseBlocks | None = None):
        self.mats, self.first, self.blocks = mats, first, blocks

    @classmethod
    def from_table(cls, params: DataFrame, vocab_size: int, limit: int = FIRST_LAYER_BYTES) -> "EncoderWeights":
        layer = params.where(F.col("name") == "W1").select(F.col("i").alias("token_id"), "vec")
        wide = measured_bytes(layer) > limit
        groups: dict[str, dict[int, list]] = {}
        for r in params.where(F.col("name") != "W1").select("name", "i", "vec").collect():
            groups.setdefault(r["name"], {})[int(r["i"])] = r["vec"]
        mats = {}
        for name, g in groups.items():
            m = np.zeros((max(g) + 1, len(next(iter(g.values())))))
            for i, v in g.items():
                m[i] = v
            mats[name] = m[0] if name.startswith("b") else m
        if wide:
            return cls(mats, layer)
        hidden = len(mats["b1"])
        if vocab_size * hidden * 8 > BLOCK_BYTES:
            return cls(mats, blocks=DenseBlocks(layer, vocab_size, hidden))
        got, mats["W1"] = layer.toArrow(), np.zeros((vocab_size, hidden))
        if got.num_rows:
            mats["W1"][got.column("token_id").to_numpy()] = arrow_matrix(got.column("vec"), np.float64)
        return cls(mats)


def np_encode(tokens_list, counts_list, w: dict[str, np.ndarray], act: str = "relu",
              bow_norm: bool = True):
    """Forward pass for a batch of sparse documents: returns (mu, logsigma, a1, a2)."""
    lens = np.array([len(t) for t in tokens_list], dtype=np.int64)
    if lens.sum() > 0:
        tok = np.concatenate([np.asarray(t, dtype=np.int64) for t in tokens_list])
        cnt = np.concatenate([np.asarray(c, dtype=float) for c in counts_list])
    else:
        tok, cnt = np.zeros(0, dtype=np.int64), np.zeros(0)
    return np_encode_flat(tok, cnt, lens, w, act, bow_norm)


def np_encode_flat(tok: np.ndarray, cnt: np.ndarray, lens: np.ndarray, w: dict[str, np.ndarray],
                   act: str = "relu", bow_norm: bool = True, blocks: DenseBlocks | None = None):
    """:func:`np_encode` on the flat (token, count) values of a batch with per-document lengths
    (the layout of an Arrow list column). ``blocks``: the first layer, instead of ``W1``."""
    n = len(lens)
    a1 = np.tile(w["b1"], (n, 1)).astype(float)
    if lens.sum() > 0:
        doc = np.repeat(np.arange(n), lens)
        tot = np.bincount(doc, weights=cnt, minlength=n)
        x = cnt / tot[doc] if bow_norm else cnt
        for low, layer in [(0, w["W1"])] if blocks is None else blocks.values():
            here = slice(None) if blocks is None else np.flatnonzero((tok >= low) & (tok < low + len(layer)))
            at, own, part = tok[here] - low, doc[here], x[here]
            for j in range(layer.shape[1]):                     # a column at a time: one value a cell is held
                a1[:, j] += np.bincount(own, weights=layer[at, j] * part, minlength=n)
    mu, ls, a2 = np_upper_layers(a1, w, act)
    return mu, ls, a1, a2


def np_upper_layers(a1: np.ndarray, w: dict[str, np.ndarray], act: str):
    """``(mu, logsigma, a2)`` from the first layer's pre-activations."""
    a2 = np_activation(act, a1) @ w["W2"] + w["b2"]
    h2 = np_activation(act, a2)
    return h2 @ w["Wmu"] + w["bmu"], h2 @ w["Ws"] + w["bs"], a2


def np_softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _encoded_batch(rb, mu, ls, n_words):
    import pyarrow as pa
    theta = np_softmax(mu)
    kl = -0.5 * np.sum(1.0 + ls - mu * mu - np.exp(ls), axis=1)
    return pa.RecordBatch.from_arrays(
        [rb.column("split"), rb.column("doc_ix"), arrow_list(mu), arrow_list(ls), arrow_list(theta),
         pa.array(kl), pa.array(n_words)],
        names=["split", "doc_ix", "mu", "logsigma", "theta", "kl", "n_words"])


def encode_docs(packed: DataFrame, weights: EncoderWeights, act: str = "relu",
                bow_norm: bool = True, carry: bool = False) -> DataFrame:
    """T2 + T3 (scoring mode, z = mu) + A10 per document: ``(split, doc_ix, mu, logsigma,
    theta, kl, n_words)``, with ``carry`` also the document's ``tokens`` and ``counts`` (theta then stands
    beside them); one Arrow batch at a time, weights from broadcast variables (the first layer block by block).
    A first layer too wide to ship is joined by token instead (:func:`_first_layer`)."""
    if act == "glu":
        raise ValueError("glu halves the layer width and cannot be wired into this encoder")
    bc, blocks = packed.sparkSession.sparkContext.broadcast(weights.mats), weights.blocks
    if weights.first is not None:
        def upper(batches):
            w = bc.value
            for rb in batches:
                if rb.num_rows:
                    mu, ls, _ = np_upper_layers(arrow_matrix(rb.column("a1"), np.float64) + w["b1"], w, act)
                    yield _encoded_batch(rb, mu, ls, rb.column("n_words").to_numpy())

        sums = _first_layer(packed, weights.first, len(weights.mats["b1"]), bow_norm)
        out = sums.mapInArrow(upper, ENCODER_SCHEMA)
        return out.join(packed.select("split", "doc_ix", "tokens", "counts"), ["split", "doc_ix"]) if carry else out

    def flat(col):
        offs = col.offsets.to_numpy()
        return col.values.to_numpy(zero_copy_only=False)[offs[0]:offs[-1]], np.diff(offs)

    def run(batches):
        w = bc.value
        for rb in batches:
            if rb.num_rows == 0:
                continue
            tok, lens = flat(rb.column("tokens"))
            cnt, _ = flat(rb.column("counts"))
            mu, ls, _, _ = np_encode_flat(tok.astype(np.int64), cnt.astype(float), lens, w, act, bow_norm, blocks)
            n_words = np.bincount(np.repeat(np.arange(rb.num_rows), lens), weights=cnt,
                                  minlength=rb.num_rows).astype(np.int64)
            out = _encoded_batch(rb, mu, ls, n_words)
            if carry:
                out = out.append_column("tokens", rb.column("tokens")).append_column("counts", rb.column("counts"))
            yield out

    rows = packed.select("split", "doc_ix", "tokens", "counts")
    schema = T.StructType(ENCODER_SCHEMA.fields + [rows.schema["tokens"], rows.schema["counts"]]) if carry else ENCODER_SCHEMA
    return rows.mapInArrow(run, schema)


def _first_layer(packed: DataFrame, first: DataFrame, hidden: int, bow_norm: bool) -> DataFrame:
    """``(split, doc_ix, a1, n_words)``: the first layer's sums without its bias, as a join of the
    (document, token) cells with the layer's rows and a weighted vector sum per document. The sum is
    combined map-side; the tokens of the most documents stay with their rows in the join."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
    docs = packed.select("split", "doc_ix", "tokens", "counts", total.alias("n_words"))
    cells = docs.select("split", "doc_ix", "n_words", F.explode(F.arrays_zip("tokens", "counts")).alias("z")).select(
        "split", "doc_ix", "n_words", F.col("z.tokens").cast("bigint").alias("token_id"), F.col("z.counts").alias("c"))
    often = cells.groupBy("token_id").agg(F.count(F.lit(1)).alias("_often"))
    side = first.join(often, "token_id")
    hit = lookup_join(cells, side, "token_id", weight="_often")
    x = F.col("c") / F.col("n_words") if bow_norm else F.col("c").cast("double")
    sums = hit.groupBy("split", "doc_ix").agg(Summarizer.sum(array_to_vector("vec"), x).alias("_s"))
    zero = F.array_repeat(F.lit(0.0), hidden)
    return docs.select("split", "doc_ix", "n_words").join(sums, ["split", "doc_ix"], "left").select(
        "split", "doc_ix", F.coalesce(vector_to_array("_s"), zero).alias("a1"), "n_words")


def reparameterize(mu: str = "mu", logsigma: str = "logsigma", training: bool = True,
                   seed: int = 2019, step: int = 0, doc: str = "doc_ix") -> Column:
    """M4: z = mu + eps·exp(logsigma / 2) with eps ~ N(0,1) keyed by (seed, step, doc, topic)
    when training; z = mu when scoring."""
    if not training:
        return F.col(mu)
    return F.transform(F.arrays_zip(F.col(mu).alias("m"), F.col(logsigma).alias("s")),
                       lambda z, k: z["m"] + normal(key(seed, step, F.col(doc), k))
                       * F.exp(z["s"] * F.lit(0.5)))


# ------------------------------------------------------------------ word probabilities

def packed_cells(bow: DataFrame, theta: DataFrame) -> DataFrame:
    """``(split, doc_ix, tokens, counts, theta)``: the documents of a packed or long bag of words beside
    their theta. What meets is one row per document; theta is never repeated per word."""
    keys = ["split", "doc_ix"]
    if "theta" in bow.columns:
        return bow.select(*keys, "tokens", "counts", "theta")
    if "tokens" not in bow.columns:
        bow = bow.groupBy(*keys).agg(F.collect_list(F.struct("token_id", "cnt")).alias("_c")).select(
            *keys, F.col("_c.token_id").alias("tokens"), F.col("_c.cnt").alias("counts"))
    return bow.select(*keys, "tokens", "counts").join(theta.select(*keys, "theta"), keys)


def _flat(values) -> tuple[np.ndarray, np.ndarray]:
    offs = values.offsets.to_numpy()
    return values.values.to_numpy(zero_copy_only=False)[offs[0]:offs[-1]], np.diff(offs)


def cell_probabilities(doc: np.ndarray, tok: np.ndarray, theta: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Σ_k theta[doc, k] · beta[tok, k] for each cell, a bounded number of cells at a time."""
    out, step = np.empty(len(tok)), max(CELL_VALUES // max(beta.shape[1], 1), 1)
    for at in range(0, len(tok), step):
        part = slice(at, at + step)
        out[part] = np.einsum("ck,ck->c", theta[doc[part]], beta[tok[part]])
    return out


def _by_batch(docs: DataFrame, beta: BetaBlocks, make, schema: str, *more: str) -> DataFrame:
    """One narrow pass over the packed documents: each batch meets the vocabulary blocks in turn, and
    ``make(rb, doc, tok, cnt, p)`` gives the batch of rows for its cells. ``more``: further columns of ``rb``."""

    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            tok, lens = _flat(rb.column("tokens"))
            cnt, _ = _flat(rb.column("counts"))
            doc = np.repeat(np.arange(rb.num_rows), lens)
            tok, theta = tok.astype(np.int64), arrow_matrix(rb.column("theta"), np.float64)
            p, known = np.zeros(len(tok)), np.zeros(len(tok), bool)
            for low, matrix in beta.values():
                here = np.flatnonzero((tok >= low) & (tok < low + len(matrix)))
                p[here], known[here] = cell_probabilities(doc[here], tok[here] - low, theta, matrix), True
            if not known.all():
                doc, tok, cnt, p = doc[known], tok[known], cnt[known], p[known]
            yield make(rb, doc, tok, cnt, p)

    return docs.select("split", "doc_ix", "tokens", "counts", "theta", *more).mapInArrow(run, schema)


def word_probabilities(bow: DataFrame, theta: DataFrame | None, beta: DataFrame | BetaBlocks) -> DataFrame:
    """``p(w|d) = Σ_k theta_dk · beta_kw`` at the present cells ``(split, doc_ix, token_id, cnt, p)``.
    ``bow``: encoded documents that carry their tokens, a packed or a long bag of words; theta joins by
    document, beta is shipped in vocabulary blocks, so an exchange carries neither of them per cell."""
    import pyarrow as pa
    blocks = beta if isinstance(beta, BetaBlocks) else BetaBlocks(beta)

    def make(rb, doc, tok, cnt, p):
        at = pa.array(doc)
        return pa.RecordBatch.from_arrays([rb.column("split").take(at), rb.column("doc_ix").take(at), pa.array(tok),
                                           pa.array(cnt.astype(np.int64)), pa.array(p)],
                                          names=["split", "doc_ix", "token_id", "cnt", "p"])

    docs = packed_cells(bow, theta).withColumn("doc_ix", F.col("doc_ix").cast("bigint"))
    return _by_batch(docs, blocks, make, "split string, doc_ix bigint, token_id bigint, cnt bigint, p double")


def document_losses(bow: DataFrame, theta: DataFrame | None, beta: DataFrame | BetaBlocks, eps: float = 0.0) -> DataFrame:
    """Per document ``(split, doc_ix, rec, n)``: −Σ n·log(p + eps) and Σ n, summed inside the packed row."""
    import pyarrow as pa
    blocks = beta if isinstance(beta, BetaBlocks) else BetaBlocks(beta)

    def make(rb, doc, tok, cnt, p):
        rec = -np.bincount(doc, weights=cnt * np.log(p + eps), minlength=rb.num_rows)
        n = np.bincount(doc, weights=cnt, minlength=rb.num_rows)
        return pa.RecordBatch.from_arrays([rb.column("split"), rb.column("doc_ix"), pa.array(rec), pa.array(n)],
                                          names=["split", "doc_ix", "rec", "n"])

    docs = packed_cells(bow, theta).withColumn("doc_ix", F.col("doc_ix").cast("bigint"))
    return _by_batch(docs, blocks, make, "split string, doc_ix bigint, rec double, n double").where("n > 0")


def reconstruction_loss(bow: DataFrame, theta: DataFrame | None, beta: DataFrame | BetaBlocks, eps: float = 1e-6) -> DataFrame:
    """A11 per document: −Σ n·log(p + eps) ``(split, doc_ix, rec)``."""
    return document_losses(bow, theta, beta, eps).select("split", "doc_ix", "rec")


def elbo_forward(encoded: DataFrame, beta: DataFrame | BetaBlocks) -> DataFrame:
    """T4 / A12 per document: ``(split, doc_ix, rec, kl, nelbo)`` of encoded documents that carry their
    tokens. One narrow pass: loss and divergence of a document come from its own row."""
    import pyarrow as pa
    blocks = beta if isinstance(beta, BetaBlocks) else BetaBlocks(beta)

    def make(rb, doc, tok, cnt, p):
        rec = -np.bincount(doc, weights=cnt * np.log(p + 1e-6), minlength=rb.num_rows)
        kl = rb.column("kl").to_numpy()
        return pa.RecordBatch.from_arrays([rb.column("split"), rb.column("doc_ix"), pa.array(rec), pa.array(kl),
                                           pa.array(rec + kl)], names=["split", "doc_ix", "rec", "kl", "nelbo"])

    return _by_batch(encoded, blocks, make, "split string, doc_ix bigint, rec double, kl double, nelbo double", "kl")


def kl_divergence(encoded: DataFrame) -> DataFrame:
    """A10 from mu / logsigma arrays, per document (Spark expression twin of the NumPy one)."""
    terms = F.zip_with("mu", "logsigma", lambda m, s: F.lit(1.0) + s - m * m - F.exp(s))
    return encoded.select("split", "doc_ix",
                          (F.lit(-0.5) * F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)).alias("kl"))
