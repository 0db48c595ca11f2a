"""Model maths: invariants, hand fixtures for perplexity and coherence, NumPy twin of encode."""

import math

import numpy as np
from pyspark.sql import functions as F

from toposcope.operators import evaluate as EV
from toposcope.operators import model as M
from toposcope.plans.report import model_context

SF = "/root/testdata/sf0.001"


def test_beta_and_theta_rows_sum_to_one(spark):
    c = model_context(spark, SF)
    sums = c.beta_long.groupBy("topic").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-9 for r in sums)
    enc = c.encoded("tr").select(F.aggregate("theta", F.lit(0.0), lambda a, v: a + v).alias("s"), "kl").collect()
    assert all(abs(r.s - 1.0) < 1e-9 for r in enc)
    assert all(r.kl >= 0 for r in enc)


def test_encoder_matches_plain_numpy(spark):
    c = model_context(spark, SF)
    rows = c.packed().where("split = 'va'").orderBy("doc_ix").limit(5).collect()
    got = {r.doc_ix: r.mu for r in c.encoded("va").collect()}
    w = c.weights.mats
    for r in rows:
        x = np.zeros(c.vocab_size)
        x[list(r.tokens)] = np.asarray(r.counts, dtype=float)
        x = x / x.sum()
        h1 = np.maximum(x @ w["W1"] + w["b1"], 0)
        h2 = np.maximum(h1 @ w["W2"] + w["b2"], 0)
        mu = h2 @ w["Wmu"] + w["bmu"]
        assert np.allclose(mu, got[r.doc_ix], atol=1e-12)


def test_uniform_beta_perplexity_is_vocab_size(spark):
    v = 50
    bow = spark.createDataFrame([(d, t, 1 + (d + t) % 3) for d in range(7) for t in range(0, v, 3)],
                                "doc_ix long, token_id long, cnt long")
    theta = spark.createDataFrame([(d, [0.3, 0.7]) for d in range(7)], "doc_ix long, theta array<double>")
    beta = spark.createDataFrame([(t, [1.0 / v, 1.0 / v]) for t in range(v)], "token_id long, beta array<double>")
    r = EV.doc_completion_ppl(bow, theta, F.broadcast(beta), eval_batch=3).first()
    assert abs(math.exp(r.loss) - v) < 1e-9 and r.ppl == float(v)


def test_coherence_extremes(spark):
    # topic 0: words 0 and 1 always together; topic 1: words 2 and 3 never together
    beta = spark.createDataFrame(
        [(0, 0, 10, 0.5), (0, 1, 9, 0.5), (1, 2, 10, 0.5), (1, 3, 9, 0.5)],
        "topic int, token_id long, dot long, p double")
    bow = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 1), (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 5, 1)],
                                "doc_ix long, token_id long, cnt long")
    got = {r.topic: r.coherence for r in EV.topic_coherence(beta, bow, n=2).collect()}
    assert abs(got[1] - (-1.0)) < 1e-12
    p_ij, p_i = 2 / 5, 2 / 5
    assert abs(got[0] - (math.log(p_ij / (p_i * p_i)) / -math.log(p_ij))) < 1e-12
    assert abs(got[0] - 1.0) < 1e-12


def test_diversity_bounds(spark):
    c = model_context(spark, SF)
    d = EV.topic_diversity(c.beta_long, 25).first().diversity
    assert 0 < d <= 1


def test_activations_match_numpy(spark):
    xs = [-30.0, -2.0, -0.5, 0.0, 0.5, 2.0, 25.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for name in ("tanh", "relu", "softplus", "rrelu", "leakyrelu", "elu", "selu", "unknown"):
        got = [r.y for r in df.select(M.activation(name, F.col("x")).alias("y")).collect()]
        assert np.allclose(got, M.np_activation(name, np.array(xs)), atol=1e-12), name


def test_wide_first_layer_is_joined(spark):
    """A first layer over the byte limit stays a table; the encoding is the same."""
    c = model_context(spark, SF)
    wide = M.EncoderWeights.from_table(c.params, c.vocab_size, limit=10)
    assert wide.first is not None and "W1" not in wide.mats
    key = lambda r: (r["split"], r["doc_ix"])
    a = sorted(c.encoded("tr", "va", "ts").collect(), key=key)
    b = sorted(M.encode_docs(c.packed().where("split in ('tr', 'va', 'ts')"), wide).collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b] and [r["n_words"] for r in a] == [r["n_words"] for r in b]
    assert all(np.allclose(x["mu"], y["mu"]) and np.allclose(x["theta"], y["theta"]) for x, y in zip(a, b))


def test_glu_is_explicit():
    import pytest
    x = np.random.default_rng(1).normal(size=(3, 6))
    g = M.np_activation_grad("glu", x)
    for i in range(6):
        d = np.zeros(6)
        d[i] = 1e-6
        num = (M.np_activation("glu", x + d) - M.np_activation("glu", x - d)) / 2e-6
        assert np.allclose(num[:, i % 3], g[:, i], atol=1e-6)
    with pytest.raises(ValueError):
        M.activation("glu", F.lit(1.0))


def test_coherence_of_long_lists(spark):
    """More than 32 top words per topic, against plain Python."""
    rng = np.random.default_rng(3)
    n, k = 40, 2
    beta = spark.createDataFrame([(t, w, float(rng.random()), 0.0) for t in range(k) for w in range(60)],
                                 "topic int, token_id bigint, dot double, p double").withColumn("p", F.col("dot"))
    docs = {d: sorted(set(rng.integers(0, 60, 25).tolist())) for d in range(50)}
    bow = spark.createDataFrame([(d, w) for d, ws in docs.items() for w in ws], "doc_ix bigint, token_id bigint")
    got = {r["topic"]: r["coherence"] for r in EV.topic_coherence(beta, bow, n).collect()}
    rows = beta.collect()
    for t in range(k):
        top = [r["token_id"] for r in sorted((r for r in rows if r["topic"] == t), key=lambda r: (-r["dot"], r["token_id"]))][:n]
        vals = []
        for i in range(n):
            for j in range(i + 1, n):
                di, dj = (sum(top[x] in ws for ws in docs.values()) for x in (i, j))
                dij = sum(top[i] in ws and top[j] in ws for ws in docs.values())
                if dij == 0:
                    vals.append(-1.0)
                else:
                    lp = math.log(dij / 50)
                    vals.append((lp - math.log(di / 50) - math.log(dj / 50)) / -lp)
        assert abs(got[t] - sum(vals) / len(vals)) < 1e-9


def test_vocabulary_blocks_give_the_same_cells(spark):
    """beta in many blocks equals beta in one, and no exchange of the plan carries beta or theta per word."""
    c = model_context(spark, SF)
    small = M.beta_lookup(c.beta_tok, block_bytes=8 * 10 * 37)
    assert len(small.blocks) > 3 and small.blocks[1][0] == 37
    enc = c.encoded("tr", "va", carry=True)
    key = lambda r: (r["split"], r["doc_ix"])
    one = sorted(M.elbo_forward(enc, c.beta_side()).collect(), key=key)
    many = sorted(M.elbo_forward(enc, small).collect(), key=key)
    assert [key(r) for r in one] == [key(r) for r in many]
    assert np.allclose([r["nelbo"] for r in one], [r["nelbo"] for r in many], rtol=1e-12)
    long = c.bow().where("split in ('tr', 'va')")
    cell = lambda r: (r["split"], r["doc_ix"], r["token_id"], r["cnt"])
    a = {cell(r): r["p"] for r in M.word_probabilities(enc, None, small).collect()}
    b = {cell(r): r["p"] for r in M.word_probabilities(long, enc, c.beta_side()).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-15 for k in a)
    for df in (M.word_probabilities(enc, None, small), M.word_probabilities(long, enc, c.beta_side())):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "beta" not in plan


def test_normalisers_in_one_scan(spark):
    """One (maximum, scaled sum) per topic and task; integers and doubles; the mean vector of each topic."""
    rng = np.random.default_rng(8)
    rho, alpha = rng.normal(0, 30, (500, 6)), rng.normal(0, 3, (4, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rho)], "token_id bigint, vec array<double>")
    top, total, mean = M.softmax_norms(df.repartition(7), alpha, moments=True)
    logit = alpha @ rho.T
    e = np.exp(logit - logit.max(axis=1, keepdims=True))
    assert np.allclose(top, logit.max(axis=1)) and np.allclose(total, e.sum(axis=1))
    assert np.allclose(mean, (e / e.sum(axis=1, keepdims=True)) @ rho)
    topics = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(alpha)], "topic int, vec array<double>")
    got, _ = M.beta_by_token(df, topics)
    assert np.allclose(sorted(r.beta[2] for r in got.collect()), sorted((e / e.sum(axis=1, keepdims=True))[2]))


def test_first_layer_in_blocks_gives_the_same_encoding(spark, monkeypatch):
    """A first layer of several blocks is shipped block by block (none of it held whole on the driver), read in one
    narrow pass; beta in many blocks is one pass too, without an exchange."""
    c = model_context(spark, SF)
    whole = M.EncoderWeights.from_table(c.params, c.vocab_size)
    assert "W1" in whole.mats and whole.blocks is None
    monkeypatch.setattr(M, "BLOCK_BYTES", 8 * 8 * 100)
    monkeypatch.setattr(M, "KEPT_BYTES", 0)
    parts = M.EncoderWeights.from_table(c.params, c.vocab_size)
    assert parts.first is None and "W1" not in parts.mats and len(parts.blocks.blocks) > 3
    assert all(len(bc.value) <= 100 for _, bc in parts.blocks.blocks)
    docs = c.packed().where("split in ('tr', 'va')")
    key = lambda r: (r["split"], r["doc_ix"])
    a, b = (sorted(M.encode_docs(docs, w).collect(), key=key) for w in (whole, parts))
    assert [key(r) for r in a] == [key(r) for r in b] and all(np.allclose(x["mu"], y["mu"], rtol=1e-12) for x, y in zip(a, b))
    enc = M.encode_docs(docs, parts, carry=True)
    for df in (M.elbo_forward(enc, M.beta_lookup(c.beta_tok)), M.reconstruction_loss(enc, None, M.beta_lookup(c.beta_tok))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan.split("InMemoryRelation")[0] and "Aggregate" not in plan.split("InMemoryRelation")[0]
