"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix.

Entries become integers, so the scatter matrix ``n * sum(x x') - S S'`` (n^2 times the covariance) is
exact. Its characteristic polynomial is computed modulo many primes (Hessenberg reduction) and put
together by Chinese remaindering. All its roots are real, so the sign changes of the polynomial
shifted to t count the roots above t exactly; bisection on them isolates the largest eigenvalues, with
their multiplicities, to any precision. Inverse iteration in fixed-point integers at such a root gives
the components.

Spark does what grows with the rows: integers, distinct vectors, partial scatter sums, projection, and
the covariance of the result. Modular polynomials are tasks as well, one for each prime. The driver
holds d x d integers and the polynomial, which follow the dimension d alone.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbuf import frozen

SCALE, COMPONENTS = 256, 4
#: Fixed-point bits of eigenvalues and eigenvectors beyond the integer part of the scatter matrix.
BITS = 192
#: Sums travel as signed limbs of this many bits, so that Spark adds longs and nothing overflows.
LIMB = 40


# ---------------------------------------------------------------- exact sums

def limbs(value: int) -> Iterator[tuple[int, int]]:
    """``(index, limb)`` with ``value == sum(limb << (LIMB * index))``; limbs carry the sign."""
    sign, value, at = (-1, -value, 0) if value < 0 else (1, value, 0)
    while value:
        if part := value & ((1 << LIMB) - 1):
            yield at, sign * part
        value, at = value >> LIMB, at + 1


def gram(x: np.ndarray) -> np.ndarray:
    """``x' x`` of an int64 matrix as Python integers: double products while they are exact."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    rows = (1 << 53) // (top * top)
    if rows < 1:
        wide = x.astype(object)
        return wide.T @ wide
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for at in range(0, len(x), min(rows, 1 << 14)):
        part = x[at:at + min(rows, 1 << 14)].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim) if len(flat) else np.zeros((0, dim), np.int64)


def _summed(distinct: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """``n``, per-dimension sums and ``sum(x x')`` of ``distinct(x)``, exactly."""

    def run(batches):
        n, sums, total = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n += len(x)
            sums += x.astype(object).sum(axis=0) if len(x) else 0
            total += gram(x)
        rows = [(-1, -1, *p) for p in limbs(n)]
        for i in range(dim):
            rows += [(i, -1, *p) for p in limbs(int(sums[i]))]
            rows += [(i, j, *p) for j in range(i + 1) for p in limbs(int(total[i, j]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)],
                                         ["i", "j", "l", "v"])

    parts = distinct.select("x").mapInArrow(run, "i bigint, j bigint, l bigint, v bigint")
    n, sums, total = 0, [0] * dim, np.zeros((dim, dim), object)
    # at most dim^2 / 2 sums, of a few limbs each
    for i, j, at, v in parts.groupBy("i", "j", "l").agg(F.sum("v")).collect():
        part = v << (LIMB * at)
        if i < 0:
            n += part
        elif j < 0:
            sums[i] += part
        else:
            total[i, j] += part
            if i != j:
                total[j, i] += part
    return n, sums, total


# ---------------------------------------------------------------- characteristic polynomial

def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (< 2^32)."""

    def prime(p: int) -> bool:
        if p % 2 == 0:
            return p == 2
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):                 # decides all numbers below 3,215,031,751
            if base % p == 0:
                continue
            y = pow(base, odd, p)
            if y in (1, p - 1):
                continue
            for _ in range(twos - 1):
                y = y * y % p
                if y == p - 1:
                    break
            else:
                return False
        return True

    found, p = [], top - 1
    while len(found) < count:
        if prime(p):
            found.append(p)
        p -= 1
    return found


def charpoly_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (constant first) of ``det(t I - matrix)`` modulo the prime ``p`` < 2^31."""
    h = matrix % p
    h = h.astype(np.int64)
    d = len(h)
    for k in range(d - 2):                        # similar matrix with zeros below the subdiagonal
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factor[:, None] * h[k + 1][None, :]) % p
        for part, f in zip(h[:, k + 2:].T, factor):
            if f:
                h[:, k + 1] = (h[:, k + 1] + part * f) % p
    polys = np.zeros((d + 1, d + 1), np.int64)    # of the leading blocks
    polys[0, 0] = 1
    for k in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = polys[k - 1, :-1]
        row = (row - h[k - 1, k - 1] * polys[k - 1]) % p
        run = 1
        for i in range(1, k):
            run = run * int(h[k - i, k - i - 1]) % p
            if not run:
                break
            row = (row - int(h[k - i - 1, k - 1]) * run % p * polys[k - i - 1]) % p
        polys[k] = row
    return polys[d]


def charpoly(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Integer coefficients (constant first) of ``det(t I - matrix)``, symmetric and positive
    semidefinite: modulo enough primes, a task each, then by Chinese remaindering."""
    d, trace = len(matrix), int(sum(matrix[i, i] for i in range(len(matrix))))
    # the k-th coefficient is a sum of k-fold products of eigenvalues: at most C(d, k) (trace / d)^k
    bound = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    primes = primes_below(1 << 31, (2 * bound + 1).bit_length() // 30 + 1)
    text = json.dumps([[str(v) for v in row] for row in matrix.tolist()])

    def run(batches):
        own = np.array([[int(v) for v in row] for row in json.loads(text)], dtype=object).reshape(d, d)
        for batch in batches:
            yield pd.DataFrame({"p": batch["p"], "c": [charpoly_mod(own, int(p)).tolist() for p in batch["p"]]})

    slots = max(1, min(len(primes), spark.sparkContext.defaultParallelism * 2))
    asked = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(slots)
    residues = {r["p"]: r["c"] for r in asked.mapInPandas(run, "p bigint, c array<bigint>").collect()}
    value, modulus = [0] * (d + 1), 1
    for p in primes:
        inverse = pow(modulus, -1, p)
        value = [v + modulus * ((c - v) * inverse % p) for v, c in zip(value, residues[p])]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in value]


# ---------------------------------------------------------------- roots and components

def roots_above(poly: list[int], at: int, bits: int) -> int:
    """Number of roots (with multiplicity) greater than ``at / 2^bits`` of a polynomial all of whose
    roots are real: the sign changes of its shift to that point."""
    d = len(poly) - 1
    c = [v << (bits * (d - k)) for k, v in enumerate(poly)]      # roots times 2^bits
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int, bits: int = BITS) -> list[tuple[int, int]]:
    """``(root * 2^bits rounded down, multiplicity)`` of the positive roots, falling, until at least
    ``count`` roots (with multiplicity) are given. Roots that agree in all those bits count as one."""
    top = 1 << (max(1, -poly[-2]).bit_length() + 1)              # the trace bounds every root
    found, have = [], 0
    positive = roots_above(poly, 0, 0)
    while have < min(count, positive):
        # between low (more than `have` roots above) and high (no more than `have` roots above)
        low, high, scale = 0, top, 0
        while scale < bits or high - low > 1:
            if high - low <= 1:
                step = min(16, bits - scale)
                low, high, scale = low << step, high << step, scale + step
            mid = (low + high) // 2
            if roots_above(poly, mid, scale) > have:
                low = mid
            else:
                high = mid
        upto = roots_above(poly, low, bits)
        found.append((low, upto - have))
        have = upto
    return found


def _solve(rows: list[np.ndarray], right: np.ndarray, bits: int) -> np.ndarray:
    """Solution of a square fixed-point system (partial pivoting); a vanishing pivot becomes one unit."""
    a = np.array(rows, dtype=object)
    b = right.copy()
    d = len(a)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if pivot != k:
            a[[k, pivot]], b[[k, pivot]] = a[[pivot, k]], b[[pivot, k]]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            factor = (a[k + 1:, k] << bits) // a[k, k]
            a[k + 1:, k:] -= (factor[:, None] * a[k, k:][None, :]) >> bits
            b[k + 1:] -= (factor[:, None] * b[k][None, :]) >> bits
    x = np.zeros_like(b)
    for k in reversed(range(d)):
        rest = b[k] - (((a[k, k + 1:, None] * x[k + 1:]).sum(axis=0) >> bits) if k + 1 < d else 0)
        x[k] = (rest << bits) // a[k, k]
    return x


def _orthonormal(block: np.ndarray, bits: int) -> np.ndarray:
    """Columns made orthonormal, in fixed point (two passes of Gram-Schmidt)."""
    out = block.copy()
    for k in range(out.shape[1]):
        size = max(max(abs(v) for v in out[:, k]).bit_length(), 1)
        out[:, k] = (out[:, k] << (bits * 2)) >> (size + bits)    # near one before products are taken
        for _ in range(2):
            for j in range(k):
                dot = int((out[:, j] * out[:, k]).sum()) >> bits
                out[:, k] -= (out[:, j] * dot) >> bits
            norm = math.isqrt(int((out[:, k] * out[:, k]).sum()))
            out[:, k] = (out[:, k] << bits) // max(norm, 1)
    return out


def components(matrix: np.ndarray, roots: list[tuple[int, int]], bits: int = BITS) -> np.ndarray:
    """Unit eigenvectors (columns, double) at the given roots, by inverse iteration of a block of as
    many vectors as the root is multiple, on the matrix shifted by the root."""
    d = len(matrix)
    shift = int(matrix.max()).bit_length() if d else 0            # entries come near one
    work = bits + 64
    columns = []
    for root, times in roots:
        rows = (matrix << (work - shift)).copy()
        at = root << (work - shift - bits) if work - shift >= bits else root >> (bits + shift - work)
        for i in range(d):
            rows[i, i] -= at
        start = [[((i * 7919 + j * 104729 + 12345) * 2654435761 >> 7) % 2003 - 1001 for j in range(times)] for i in range(d)]
        block = _orthonormal(np.array(start, dtype=object).reshape(d, times) << work, work)
        for _ in range(3):
            block = _orthonormal(_solve(list(rows), block, work), work)
        columns.append(block)
    block = np.concatenate(columns, axis=1) if columns else np.zeros((d, 0), object)
    return np.array([[float(v) / 2.0 ** work if abs(v) < 1 << 1000 else v / (1 << work) for v in row] for row in block],
                    dtype=np.float64).reshape(d, block.shape[1])


# ---------------------------------------------------------------- the operator

def integers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)``: ``floor(scale * c)`` of the rows whose vector is whole; see :func:`whiten`."""
    values = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    bad = F.exists(values, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~F.coalesce(bad, F.lit(True)))
    return whole.select("vec_id", F.transform(values, lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def fit(rows: DataFrame, dim: int, count: int = COMPONENTS) -> dict:
    """Model of the distinct vectors of ``rows(x)``: ``n``, ``sums``, ``values`` (eigenvalues of the
    covariance), ``vectors`` (columns), ``explained`` and ``identity_error``."""
    spark = rows.sparkSession
    distinct = frozen(rows.select("x").distinct())
    n, sums, total = _summed(distinct, dim)
    scatter = n * total - np.array([[a * b for b in sums] for a in sums], dtype=object).reshape(dim, dim)
    trace = int(sum(scatter[i, i] for i in range(dim)))
    if not trace:
        return {"n": n, "sums": sums, "values": [], "vectors": np.zeros((dim, 0)), "explained": [], "identity_error": 0.0}
    roots = largest_roots(charpoly(spark, scatter), count)
    vectors = components(scatter, roots)[:, :count]
    each = [r for r, times in roots for _ in range(times)][:count]
    model = {"n": n, "sums": sums, "vectors": vectors, "values": [r / (n * n << BITS) for r in each],
             "explained": [r / (trace << BITS) for r in each]}
    return model | {"identity_error": _identity_error(distinct, model)}


def _projector(model: dict):
    n, sums = model["n"], np.array(model["sums"], dtype=object)
    weights = model["vectors"] / np.sqrt(np.array(model["values"], dtype=np.float64))
    most = max([abs(s) for s in model["sums"]], default=0)
    dim = len(sums)

    def centred(x: np.ndarray) -> tuple[np.ndarray, list]:
        """``x - S / n`` as doubles, and the exact ``sum((n x - S)^2)`` of each row (None beyond a long)."""
        top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if (n * top + most) ** 2 * dim < 1 << 62:
            off = n * x - sums.astype(np.int64)
            return off / n, (off * off).sum(axis=1).tolist()
        off = n * x.astype(object) - sums
        exact = [int(v) for v in (off * off).sum(axis=1)]
        return (off / n).astype(np.float64), [v if v < 1 << 63 else None for v in exact]

    def project(x: np.ndarray) -> tuple[np.ndarray, list]:
        off, deviation = centred(x)
        return off @ weights, deviation

    return project


def _identity_error(distinct: DataFrame, model: dict) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    project, dim, k = _projector(model), len(model["sums"]), len(model["values"])

    def run(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w, _ = project(_matrix(batch.column(0), dim))
            total += w.sum(axis=0)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i in range(k) for _ in range(k + 1)], pa.int64()),
             pa.array([j for _ in range(k) for j in range(-1, k)], pa.int64()),
             pa.array([total[i] if j < 0 else products[i, j] for i in range(k) for j in range(-1, k)], pa.float64())],
            ["i", "j", "v"])

    rows = distinct.select("x").mapInArrow(run, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v"))
    sums = {(i, j): v for i, j, v in rows.collect()}              # (components + 1)^2 numbers
    n = model["n"]
    return max(abs(sums[i, j] / n - sums[i, -1] / n * (sums[j, -1] / n) - (i == j)) for i in range(k) for j in range(k))


def whiten(embeddings: DataFrame, count: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Whitened coordinates of ``embeddings(vec_id, embedding)``.

    Returns one row for each kept row and component: ``vec_id``, ``component`` (from 1, by falling
    eigenvalue), ``n`` (distinct integer vectors, the fit list), ``deviation`` (exact; null where it
    exceeds a long), ``whitened``, ``explained``, ``identity_error``.
    Rows whose vector is null, empty or holds a null or non-finite entry go; so do rows whose vector
    has another length than most rows have (ties: the longer). Entries whose integer would exceed a
    long are held at its limits. Components with eigenvalue zero are not returned, so fewer than
    ``count`` components, or none (one distinct vector, an empty table), are possible. Equal
    eigenvalues get an orthonormal basis of their space. Repeated rows and null ids are kept as they
    are; other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = integers(embeddings.select("vec_id", "embedding"), scale)
    schema = T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType)]).add("component", "integer").add(
        "n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add(
        "identity_error", "double")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("k"))
    most = lengths.orderBy(F.col("k").desc(), F.col("d").desc()).first()
    if most is None:
        return spark.createDataFrame([], schema)
    dim = most["d"]
    rows = rows.where(F.size("x") == dim)
    model = fit(rows, dim, count)
    k = len(model["values"])
    if not k:
        return spark.createDataFrame([], schema)
    project, n, error = _projector(model), model["n"], float(model["identity_error"])
    explained = np.array(model["explained"])

    def run(batches):
        for batch in batches:
            w, deviation = project(_matrix(batch.column(1), dim))
            m = len(w)
            index = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, n, np.int64)), pa.array(deviation, pa.int64()).take(index),
                 pa.array(w.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                schema.fieldNames())

    return rows.mapInArrow(run, schema)
