"""Gradient against finite differences and a single-process run; the fit against the same; resume."""

import time
from dataclasses import replace

import numpy as np
import pytest

import reference_fit as RF
from toposcope.operators import fit as FT
from toposcope.operators.model import np_encode, np_softmax
from toposcope.sources import stores


def tiny_state(act="tanh", seed=0):
    rng = np.random.default_rng(seed)
    v, h, k, e = 12, 4, 3, 5
    w = {"W1": rng.normal(0, .5, (v, h)), "b1": rng.normal(0, .1, h), "W2": rng.normal(0, .5, (h, h)),
         "b2": rng.normal(0, .1, h), "Wmu": rng.normal(0, .5, (h, k)), "bmu": rng.normal(0, .1, k),
         "Ws": rng.normal(0, .5, (h, k)), "bs": rng.normal(0, .1, k)}
    return RF.ModelState(w, rng.normal(0, .5, (v, e)), rng.normal(0, .5, (k, e)), True, act)


DOCS_T = [[0, 3, 5], [1, 2, 3, 7, 11], [4, 9]]
DOCS_C = [[2, 1, 1], [1, 1, 3, 1, 2], [5, 1]]


def distributed(spark, state, drop=0.0, train_rho=None) -> FT.TopicModel:
    rows = lambda m: [(i, [float(x) for x in r]) for i, r in enumerate(m)]
    return FT.TopicModel({n: state.w[n].copy() for n in FT.UPPER}, state.alpha.copy(),
                         spark.createDataFrame(rows(state.w["W1"]), "token_id bigint, w array<double>"),
                         spark.createDataFrame(rows(state.rho), "token_id bigint, vec array<double>"),
                         state.act, state.train_rho if train_rho is None else train_rho, drop)


def loss(state, seed=1, step=0, bow_norm=True, drop=0.0):
    beta = state.beta()
    _, _, rec, kl = RF.batch_grad(DOCS_T, DOCS_C, [0, 1, 2], state.w, beta, state.act, seed, step, True, bow_norm, drop)[1:]
    return (rec + kl) / 3


def plain_loss(state, seed=1):
    """The loss written out, without the reference's gradient code."""
    beta = state.beta()
    mu, ls, _, _ = np_encode(DOCS_T, DOCS_C, state.w, state.act)
    eps = RF.np_normal([f"{seed}:0:{d}:{t}" for d in range(3) for t in range(3)]).reshape(3, 3)
    theta = np_softmax(mu + eps * np.exp(0.5 * ls))
    rec = sum(-(np.asarray(DOCS_C[d]) * np.log(theta[d] @ beta[:, DOCS_T[d]] + 1e-6)).sum() for d in range(3))
    return (rec + (-0.5 * np.sum(1 + ls - mu ** 2 - np.exp(ls), axis=1)).sum()) / 3


def analytic(state, seed=1, step=0, bow_norm=True, docs=(0, 1, 2), drop=0.0, tokens=DOCS_T, counts=DOCS_C):
    grads, d_w1, d_beta, rec, kl = RF.batch_grad(list(tokens), list(counts), list(docs), state.w, state.beta(),
                                                 state.act, seed, step, True, bow_norm, drop)
    rows = [{"name": n, "i": i, "vec": v} for n, g in grads.items()
            for i, v in enumerate(np.atleast_2d(g))]
    rows += [{"name": "W1", "i": t, "vec": v} for t, v in d_w1.items()]
    rows += [{"name": "dbeta", "i": t, "vec": v} for t, v in d_beta.items()]
    rows += [{"name": "_rec", "i": 0, "vec": [rec]}, {"name": "_kl", "i": 0, "vec": [kl]},
             {"name": "_n", "i": 0, "vec": [float(len(docs))]}]
    return RF.assemble(rows, state)


def test_gradient_matches_finite_differences():
    assert abs(loss(tiny_state()) - plain_loss(tiny_state())) < 1e-12
    for act, bow_norm, drop in (("tanh", True, 0.0), ("softplus", True, 0.0), ("elu", True, 0.0), ("relu", True, 0.0),
                                ("tanh", False, 0.0), ("tanh", True, 0.4)):
        st = tiny_state(act)
        g, rec, kl = analytic(st, bow_norm=bow_norm, drop=drop)
        assert abs(rec + kl - loss(st, bow_norm=bow_norm, drop=drop)) < 1e-9
        for name in st.names():
            flat = st.get(name).reshape(-1)
            for idx in range(0, flat.size, max(1, flat.size // 7)):
                old = flat[idx]
                flat[idx] = old + 1e-6
                up = loss(st, bow_norm=bow_norm, drop=drop)
                flat[idx] = old - 1e-6
                dn = loss(st, bow_norm=bow_norm, drop=drop)
                flat[idx] = old
                num = (up - dn) / 2e-6
                assert abs(num - g[name].reshape(-1)[idx]) < 1e-5 * max(1.0, abs(num)), (act, name, idx)


def as_blocks(grad: FT.Gradient, v: int):
    out = {n: g / grad.n for n, g in grad.upper.items()} | {"alpha": grad.alpha / grad.n}
    for name, rows in (("W1", grad.first), ("rho", grad.rho)):
        got = {r["token_id"]: np.array(r["g"]) / grad.n for r in rows.collect()}
        width = len(next(iter(got.values())))
        out[name] = np.array([got.get(t, np.zeros(width)) for t in range(v)])
    return out


@pytest.mark.parametrize("drop", [0.0, 0.5])
def test_distributed_gradient_equals_single_process(spark, drop):
    st = tiny_state("tanh")
    df = spark.createDataFrame([(i, DOCS_T[i], DOCS_C[i]) for i in range(3)], "doc_ix long, tokens array<int>, counts array<int>")
    ref, rec, kl = analytic(st, seed=2019, step=0, drop=drop)
    for parts in (1, 3):
        grad = FT.elbo_gradient(df.repartition(parts), distributed(spark, st, drop), 2019, 0)
        assert grad.rec / 3 == pytest.approx(rec) and grad.kl / 3 == pytest.approx(kl) and grad.n == 3
        got = as_blocks(grad, 12)
        for name in ref:
            assert np.allclose(ref[name], got[name], atol=1e-10), name


def single_process_fit(st, rows, epochs, batch_size, lr, seed, drop=0.0, kind="adam", clip=0.0):
    """The epoch loop on one machine, every row updated in every step."""
    import hashlib
    opt = RF.Adam(lr=lr) if kind == "adam" else RF.SGD(lr=lr)
    step = 0
    for epoch in range(1, epochs):
        order = sorted(rows, key=lambda r: (hashlib.md5(f"{seed}:{epoch}:{r[0]}".encode()).hexdigest(), r[0]))
        for at in range(0, len(order), batch_size):
            part = order[at:at + batch_size]
            g, _, _ = analytic(st, seed, step, True, [r[0] for r in part], drop, [r[1] for r in part], [r[2] for r in part])
            opt.step(st, RF.clip_grads(g, clip))
            step += 1
    return st


ROWS = [(i, DOCS_T[i % 3], [c + i % 2 for c in DOCS_C[i % 3]]) for i in range(9)]


def fit_inputs(spark):
    tr = spark.createDataFrame(ROWS, "doc_ix long, tokens array<int>, counts array<int>")
    return tr, tr.selectExpr("'ts_h1' as split", "*"), tr.selectExpr("'ts_h2' as split", "*")


@pytest.mark.parametrize("kind,train_rho,drop,clip", [("adam", False, 0.0, 0.0), ("adam", True, 0.3, 0.05)])
def test_fit_equals_single_process(spark, monkeypatch, kind, train_rho, drop, clip):
    """Tables by token, updated when touched, with a first layer that is joined, not shipped."""
    from toposcope.operators import model as M
    monkeypatch.setattr(M.EncoderWeights.from_table.__func__, "__defaults__", (1,))
    monkeypatch.setattr(FT, "MERGE_EVERY", 2)
    st = replace(tiny_state("relu", seed=3), train_rho=train_rho)
    model = distributed(spark, st)
    model = replace(model, train_rho=train_rho, drop=drop)
    tr, h1, h2 = fit_inputs(spark)
    got, train_rows, val_rows = FT.fit_topics(tr, h1, h2, model, epochs=2, batch_size=3, lr=0.05, optimizer=kind, seed=1, clip=clip)
    want = single_process_fit(st, ROWS, 2, 3, 0.05, 1, drop, kind, clip)
    assert len(train_rows) == 3 and len(val_rows) == 1
    for name in FT.UPPER:
        assert np.allclose(got.model.upper[name], want.w[name], atol=1e-10), name
    assert np.allclose(got.model.alpha, want.alpha, atol=1e-10)
    first = {r["token_id"]: r["w"] for r in got.model.first.collect()}
    assert np.allclose([first[t] for t in range(12)], want.w["W1"], atol=1e-10)
    rho = {r["token_id"]: r["vec"] for r in got.model.rho.collect()}
    assert np.allclose([rho[t] for t in range(12)], want.rho, atol=1e-10)


def test_resume_goes_on_where_the_store_ends(spark, tmp_path):
    tr, h1, h2 = fit_inputs(spark)
    model = distributed(spark, tiny_state("relu", seed=4), train_rho=False)
    args = dict(batch_size=5, lr=0.05, seed=1)
    whole, rows, _ = FT.fit_topics(tr, h1, h2, replace(model), epochs=3, **args)
    store = stores.ModelStore(spark, str(tmp_path / "m"))
    assert store.last() is None
    commit = lambda s, improved: store.commit(s.tables(), s.record(), s.history[-1])
    FT.fit_topics(tr, h1, h2, replace(model), epochs=2, on_epoch=commit, **args)
    loaded = FT.FitState.load(*store.last())
    assert loaded.epoch == 1 and len(loaded.rule.rates) == 2
    state, later, _ = FT.fit_topics(tr, h1, h2, loaded, epochs=3, on_epoch=commit, **args)
    assert [r[:2] for r in later] == [r[:2] for r in rows[2:]]
    assert np.allclose(state.model.alpha, whole.model.alpha, rtol=1e-12, atol=1e-14)
    assert np.allclose(state.model.upper["W2"], whole.model.upper["W2"], rtol=1e-12, atol=1e-14)
    a, b = ({r["token_id"]: r["w"] for r in s.model.first.collect()} for s in (state, whole))
    assert all(np.allclose(a[t], b[t], rtol=1e-12, atol=1e-14) for t in b)
    assert [v["version"] for v in store.versions()] == [0, 1]
    _, best = store.best()
    assert best["history"][-1] == min(state.history)
    # a version without its manifest row is not there
    state.model.rho.write.parquet(str(tmp_path / "m" / "version-half" / "rho"))
    assert len(store.versions()) == 2


def test_fit_lowers_loss(spark):
    tr, h1, h2 = fit_inputs(spark)
    model = distributed(spark, tiny_state("relu", seed=3), train_rho=False)
    _, train_rows, _ = FT.fit_topics(tr, h1, h2, model, epochs=4, batch_size=9, lr=0.1, seed=1)
    assert train_rows[-1][2] + train_rows[-1][3] < train_rows[0][2] + train_rows[0][3]
    assert len({r[0] for r in train_rows}) == 3             # epochs - 1 passes


def test_batches_read_only_their_own_rows(spark):
    df = spark.createDataFrame([(i, [i % 7], [1]) for i in range(100)], "doc_ix long, tokens array<int>, counts array<int>")
    layout = FT.EpochLayout(FT.epoch_batches(df, 1, 16, 5))
    assert layout.batches == 7
    seen = [sorted(r["doc_ix"] for r in layout.batch(b).collect()) for b in range(7)]
    assert [len(s) for s in seen] == [16] * 6 + [4] and sorted(sum(seen, [])) == list(range(100))
    plan = layout.batch(3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan


def test_rules():
    with pytest.raises(ValueError):
        FT.Rule("other")
    rule = FT.Rule("sgd", 0.1, 0.5)
    assert rule.begin() == 1
    p, _, _ = rule.update(np.ones(2), np.full(2, 3.0), 0.0, 0.0, 1)
    assert np.allclose(p, 0.7)                                # no decay in plain steps


def test_fitted_model_saved_loaded_evaluated(spark, tmp_path):
    """fit → commit the best → load → context → report; the stored doubles are the fitted ones."""
    from toposcope.plans import params as PR
    from toposcope.plans import registry as G
    from toposcope.plans.report import ModelContext, eval_report, model_context

    sf = "/root/testdata/sf0.001"
    c = model_context(spark, sf)
    p = c.packed()
    store = stores.ModelStore(spark, str(tmp_path / "model"))
    state, _, _ = FT.fit_topics(p.where("split = 'tr'"), p.where("split = 'ts_h1'"), p.where("split = 'ts_h2'"), G._state(c),
                                epochs=2, batch_size=PR.EVAL_BATCH, seed=PR.SEED,
                                on_epoch=lambda s, improved: store.commit(s.tables(), s.record(), s.history[-1]))
    tables, record = store.best()
    assert record["epoch"] == 1
    loaded = ModelContext(spark, sf, rho=tables["rho"], alpha=tables["alpha"], params=tables["params"])
    assert (loaded.weights.mats["W2"] == state.model.upper["W2"]).all()
    got = {r["metric"] for r in eval_report(loaded).collect()}
    assert got == {"ppl", "coherence", "diversity", "usage_weighted", "top_used", "top_word", "neighbour"}
    rho = {r["token_id"]: r["vec"] for r in tables["rho"].collect()}
    want = RF.beta_from(np.array([rho[t] for t in range(len(rho))]), state.model.alpha)
    beta = {(r["topic"], r["token_id"]): r["p"] for r in loaded.beta_long.collect()}
    assert all(abs(beta[t, 3] - want[k, 3]) < 1e-12 for k, t in enumerate(loaded.topics))


def jobs_of(spark, run):
    """The number of jobs that ``run`` starts."""
    sc, group = spark.sparkContext, f"counted-{time.time_ns()}"
    sc.setJobGroup(group, "counted")
    try:
        out = run()
        return len(sc.statusTracker().getJobIdsForGroup(group)), out
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("kind,drop,clip", [("adam", 0.3, 0.05), ("sgd", 0.0, 0.0)])
def test_held_fit_equals_tables_in_one_job_a_step(spark, monkeypatch, kind, drop, clip):
    """A small model's first layer is held by the driver: the same fit as with tables by token, one job a step.
    A token without a row of the first layer or without a word vector counts as before."""
    tr, h1, h2 = fit_inputs(spark)
    whole = replace(distributed(spark, tiny_state("relu", seed=6), train_rho=False), drop=drop)
    # documents have tokens without a first row, without a vector, and without either
    used = sorted({t for r in ROWS for t in r[1]})
    model = replace(whole, rho=whole.rho.where(f"token_id not in ({used[0]}, {used[2]})"))
    if not clip:
        model = replace(model, first=whole.first.where(f"token_id not in ({used[1]}, {used[2]})"))
    args = dict(epochs=3, batch_size=4, lr=0.05, optimizer=kind, seed=2, clip=clip)
    monkeypatch.setattr(FT, "validation_ppl", lambda *a: 1.0)
    held, rows, _ = FT.fit_topics(tr, h1, h2, replace(model), **args)
    state = FT.FitState.start(replace(model), FT.Rule(kind, 0.05))
    words, batch = FT.HeldWords.of(state), tr.where("doc_ix < 4")
    jobs, _ = jobs_of(spark, lambda: FT.train_step(state, batch, 2, clip, held=words))
    assert jobs == 1
    monkeypatch.setattr(FT, "HELD_BYTES", 0)
    assert FT.HeldWords.of(state) is None
    want, other, _ = FT.fit_topics(tr, h1, h2, replace(model), **args)
    assert np.allclose([r[2:4] for r in rows], [r[2:4] for r in other], rtol=1e-10)
    for name in FT.UPPER:
        assert np.allclose(held.model.upper[name], want.model.upper[name], atol=1e-10), name
    assert np.allclose(held.model.alpha, want.model.alpha, atol=1e-10)
    a, b = ({r["token_id"]: r["p"] + r["m"] + r["v"] + [r["last"]] for r in s.first.base.collect()} for s in (held, want))
    assert a.keys() == b.keys() and all(np.allclose(a[t], b[t], atol=1e-10) for t in b)


def test_word_vectors_query_does_the_whole_job(spark, monkeypatch):
    """The registered query asks for the documented width, window and passes."""
    from toposcope.plans import registry as G
    asked = {}

    def fit(words, vector_size=300, window=4, max_iter=50, **more):
        asked.update(vector_size=vector_size, window=window, max_iter=max_iter)
        return spark.createDataFrame([("w", [0.0])], "word string, vec array<double>")

    monkeypatch.setattr(FT, "fit_word_vectors", fit)
    G.REGISTRY["fit_word_vectors"](spark, "/root/testdata/sf0.001")
    assert asked == {"vector_size": 300, "window": 4, "max_iter": 50}


def test_many_batches_share_folders(spark):
    """More batches than folders: the same batches, in a bounded number of folders."""
    import os
    df = spark.createDataFrame([(i, [i % 7], [1]) for i in range(100)], "doc_ix long, tokens array<int>, counts array<int>")
    batched = FT.epoch_batches(df, 1, 4, 5)
    layout = FT.EpochLayout(batched, folders=5)
    assert layout.batches == 25 and len([d for d in os.listdir(layout.path.removeprefix("file:")) if "part=" in d]) == 5
    whole = FT.EpochLayout(batched)
    assert sorted(map(tuple, layout.rows.collect())) == sorted(map(tuple, whole.rows.collect()))
    for b in (0, 4, 5, 24):
        assert sorted(layout.batch(b).collect()) == sorted(whole.batch(b).collect()) and layout.batch(b).count() == 4
    plan = layout.batch(3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan
