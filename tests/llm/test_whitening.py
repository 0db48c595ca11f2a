import math

import numpy as np
import pytest

from toposcope.llm import whitening
from toposcope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, count=4):
    """Whitening by NumPy's symmetric eigensolver."""
    keep = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in keep}), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = [i for i in np.argsort(-values) if values[i] > 1e-9 * values.max()][:count]
    out = {}
    for i, x in keep:
        deviation = sum((n * a - int(b)) ** 2 for a, b in zip(x, s))
        for k, o in enumerate(order):
            out.setdefault((i, k + 1), []).append(
                (n, deviation, (np.array(x) - s / n) @ vectors[:, o] / math.sqrt(values[o]), values[o] / np.trace(cov)))
    return out


def compare(df, rows):
    want = brute(rows)
    got = {}
    for r in df.collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert got.keys() == want.keys()
    sign = {}
    for key in want:
        assert len(got[key]) == len(want[key])
        for g, w in zip(sorted(got[key], key=lambda r: r.deviation), sorted(want[key], key=lambda r: r[1])):
            assert (g.n, g.deviation) == w[:2]
            assert g.explained == pytest.approx(w[3], rel=1e-9)
            assert g.identity_error < 1e-9
            if abs(w[2]) > 1e-6:
                sign.setdefault(key[1], math.copysign(1, g.whitened * w[2]))
            assert g.whitened * sign.get(key[1], 1) == pytest.approx(w[2], abs=1e-6)


def test_whole_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(QUERIES["op11_embedding_whitening"](spark, SF), rows)


def test_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=6) * [3, 2.5, 2, 1, 1, 0.5]]) for i in range(40)]
    rows += [(100, None), (101, [None] * 6), (102, [float("nan")] + [0.0] * 5), (103, [float("inf")] + [0.0] * 5),
             (104, []), (7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (105, [-0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, n int, x string")
    got = whitening.whiten(df.repartition(5))
    compare(got, [r for r in rows])
    short = df.unionByName(spark.createDataFrame([(200, [1.0, 2.0], 1, "x")], df.schema))
    assert whitening.whiten(short).count() == got.count()


def test_few_dimensions_and_empty(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], schema)
    got = whitening.whiten(line).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)
    assert sorted(abs(r.whitened) for r in got) == pytest.approx([0, .5 ** .5, .5 ** .5, 2 ** .5, 2 ** .5])


def test_equal_eigenvalues(spark):
    rows = [(2 * k + s, [float((1 - 2 * s) * (i == k)) for i in range(6)]) for k in range(6) for s in range(2)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert {r.component for r in got} == {1, 2, 3, 4}
    assert max(r.identity_error for r in got) < 1e-12
    assert all(r.explained == pytest.approx(1 / 6) for r in got)


def test_huge_entries(spark):
    rows = [(i, [1e30 if i == 0 else float(i), float(i * i), -2.0]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-4


def test_charpoly_and_roots(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(-50, 50, size=(9, 7)).astype(object)
    scatter = a.T @ a
    poly = whitening.charpoly(spark, scatter)
    values = np.sort(np.linalg.eigvalsh(scatter.astype(float)))[::-1]
    assert np.allclose(np.sort(np.roots([float(c) for c in poly[::-1]]).real)[::-1], values, rtol=1e-6)
    found = whitening.largest_roots(poly, 7)
    assert [r / (1 << whitening.BITS) for r, _ in found] == pytest.approx(list(values), rel=1e-9)
    assert whitening.largest_roots([-8, 12, -6, 1], 2) == [((2 << whitening.BITS) - 1, 3)] or \
        whitening.largest_roots([-8, 12, -6, 1], 2)[0][1] == 3


def test_gram_is_exact():
    x = np.array([[2 ** 40, 3], [-(2 ** 50), 5], [7, 2 ** 62]], dtype=np.int64)
    want = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(2)] for i in range(2)]
    assert whitening.gram(x).tolist() == want
    y = np.random.default_rng(0).integers(-130, 130, size=(40000, 5))
    assert (whitening.gram(y) == y.astype(object).T @ y.astype(object)).all()
    for v in (0, 5, -5, 2 ** 130 + 12345, -(2 ** 90) + 1):
        assert sum(p << (whitening.LIMB * at) for at, p in whitening.limbs(v)) == v
