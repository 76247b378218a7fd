"""Whitening against numpy's own eigenvectors."""

import math

import numpy as np
import pytest

from gridlake.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def plain(vectors, k=16):
    """(rows by index, fit size, sums, eigenvalues, vectors, trace) of lists of doubles."""
    rows = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fitted = sorted(set(map(tuple, rows.values())))
    sums = [sum(c) for c in zip(*fitted, strict=True)]
    centred = np.array([[v - 1_000_000 for v in r] for r in fitted], float)
    centred -= np.array([(s - 1_000_000 * len(fitted)) / len(fitted) for s in sums])
    values, basis = np.linalg.eigh(centred.T @ centred / len(fitted))
    order = np.argsort(values)[::-1][:k]
    return rows, len(fitted), sums, values[order], basis[:, order], values.sum()


def check(found, vectors, ids, k):
    rows, n, sums, values, basis, trace = plain(vectors, k)
    got = {(r.vec_id, r.component): r for r in found}
    assert len(found) == len(rows) * k
    sign = {}
    for i, x in rows.items():
        centred = np.array([v - s / n for v, s in zip(x, sums, strict=True)])
        for c in range(k):
            r = got[ids[i], c + 1]
            want = float(centred @ basis[:, c]) / math.sqrt(values[c])
            if abs(want) > 1e-3:
                sign.setdefault(c, math.copysign(1, want) * math.copysign(1, r.whitened))
            assert abs(r.whitened * sign.get(c, 1) - want) < 1e-6
            assert r.n == n and r.deviation == sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
            assert abs(r.explained - values[c] / trace) < 1e-9 * r.explained + 1e-12 and r.identity_error < 1e-9


def test_query_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(queries.op13_whitening(spark, SF).collect(), [[float(c) for c in r.embedding] for r in rows], [r.vec_id for r in rows], 16)


def test_awkward_tables(spark):
    rng = np.random.default_rng(2)
    vectors = [list(map(float, rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5])) for _ in range(60)]
    vectors += [vectors[0], vectors[0], None, [None, *vectors[1][1:]], [math.nan, *vectors[1][1:]], [math.inf, *vectors[1][1:]]]
    ids = list(range(len(vectors)))
    rows = [(i, v, "x", 1) for i, v in zip(ids, vectors, strict=True)] + [(500, [], "x", 1), (501, [1.0, 2.0], "x", 1), (502, [1e300] * 6, "x", 1)]
    schema = "vec_id long, embedding array<double>, x string, component int"
    frame = spark.createDataFrame(rows, schema)
    check(whitening.whiten(frame, 4).collect(), vectors, ids, 4)
    check(whitening.whiten(frame, 16).collect(), vectors, ids, 6)
    assert whitening.whiten(frame.where("false")).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], "x", 1) for i in range(5)], schema)
    assert whitening.whiten(same).count() == 0
    flat = spark.createDataFrame([(None, [float(i), float(i), 7.0], "x", 1) for i in range(5)], schema)
    assert {(r.vec_id, r.component) for r in whitening.whiten(flat).collect()} == {(None, 1)}


def test_exact_deviations_of_large_numbers():
    x, rest = np.array([[3, -(1 << 40)], [1, 2]]), np.array([5, -7], object)
    assert whitening.deviations(x, 1 << 20, rest) == [sum(((1 << 20) * int(v) - r) ** 2 for v, r in zip(row, [5, -7])) for row in x]


@pytest.mark.parametrize(("d", "k"), [(40, 5), (300, 4), (7, 16), (1, 1)])
def test_jacobi_davidson_restarts_and_small_spaces(d, k):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    values = np.sort(rng.uniform(0.1, 1, d) ** 2 * 50)[::-1]
    a = (q * values) @ q.T
    found, vectors, rounds, residual = whitening.jacobi_davidson(lambda w: a @ w, d, k)
    k = min(k, d)
    assert np.allclose(found, values[:k], rtol=1e-12) and residual < 1e-12 and np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    assert np.abs(a @ vectors - vectors * found).max() < 1e-11 * values[0] and rounds < 60


def test_corrections_solve_the_projected_equation():
    rng = np.random.default_rng(4)
    m = rng.normal(size=(30, 30))
    a = m @ m.T
    values, vectors = np.linalg.eigh(a)
    ritz = np.linalg.qr(vectors[:, -3:] + 0.05 * rng.normal(size=(30, 3)))[0]
    theta = (ritz * (a @ ritz)).sum(axis=0)
    residual = a @ ritz - ritz * theta
    t = whitening.corrections(lambda w: a @ w, theta, residual, ritz, 40)
    p = np.eye(30) - ritz @ ritz.T
    for i in range(3):
        assert np.linalg.norm(p @ (a - theta[i] * np.eye(30)) @ p @ t[:, i] + p @ residual[:, i]) < 1e-6 * np.linalg.norm(residual[:, i])
