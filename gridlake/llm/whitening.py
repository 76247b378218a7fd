"""Whitening of embeddings on their leading principal components, by Jacobi-Davidson.

Vectors become integers, so sums, means and deviations are exact. The covariance is never formed: it is only applied to a
few directions at a time, each product a pass over the distinct vectors, centred before they are multiplied, whose partial sums are
added up in Spark. From a search space the Rayleigh-Ritz step takes the leading pairs; for each pair that isn't exact yet, a
correction equation, projected against all leading directions, is solved by a few steps of MINRES (all equations in step, so one pass
serves one step of all of them), and its solution widens the space. Exact pairs are locked. This goes on until every residual
is down to what double precision resolves. A space as wide as the vectors themselves contains the answer, so few rounds are needed.

Distinct vectors are kept as blocks of packed integers, which the passes read with little cost. The driver holds matrices of
dimensions x directions only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridlake.functions.durable import Workspace

SCALE, OFFSET = 64.0, 1_000_000
COMPONENTS = 16
BLOCK = 4096
INNER_STEPS = 4
#: Directions of the search space, as a multiple of the components, before it is restarted with the leading ones.
WIDEST = 5
STUCK = 6
_LONGEST = float(1 << 62)


class Fit(NamedTuple):
    n: int
    base: np.ndarray  # integers near the means, x = base + what a block holds
    rest: np.ndarray  # n * mean - n * base, exact
    values: np.ndarray  # falling eigenvalues of the covariance
    vectors: np.ndarray  # dimensions x components
    trace: float
    rounds: int
    residual: float  # the largest, over the largest eigenvalue

    @property
    def mean(self) -> np.ndarray:
        """Mean of what blocks hold."""
        return self.rest / self.n


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id and x = floor(64 c) + 1000000 of the rows whose vector has no null or non-finite entries, and the length most rows have.

    Ties of length go to the longer one. Entries beyond some 2**56 can't become longs and count as non-finite."""
    c = F.col("embedding").cast("array<double>")
    fine = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * SCALE < _LONGEST))
    rows = vectors.select("vec_id", F.when(fine, c).alias("c")).where("c IS NOT NULL")
    length = rows.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("rows")).agg(F.max(F.struct("rows", "d"))["d"]).first()[0]
    return rows.where(F.size("c") == (length or 0)).select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE).cast("long") + OFFSET).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """(number of vectors, exact sums of each dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            high, low = x >> 32, x & 0xFFFFFFFF  # parts whose sums stay far inside a long
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(high.sum(axis=0)), pa.array(low.sum(axis=0)), pa.array(np.full(d, len(x)))], names=["i", "high", "low", "n"])

    rows = distinct.select("x").mapInArrow(run, "i long, high long, low long, n long").groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")])
    found = {r["i"]: r for r in rows.collect()}  # one row a dimension
    return (int(found[0]["n"]) if found else 0), [(int(found[i]["high"]) << 32) + int(found[i]["low"]) for i in range(d if found else 0)]


def _blocks(distinct: DataFrame, base: np.ndarray) -> DataFrame:
    """(kind, block): up to BLOCK vectors less ``base`` as bytes of the least integer type that holds them."""
    d = len(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d) - base
            for at in range(0, len(x), BLOCK):
                some = x[at : at + BLOCK]
                kind = np.promote_types(np.min_scalar_type(min(int(some.min()), -1)), np.min_scalar_type(-int(some.max()) - 1 if some.max() >= 0 else -1))
                yield pa.RecordBatch.from_arrays([pa.array([kind.str]), pa.array([some.astype(kind).tobytes()], pa.binary())], names=["kind", "block"])

    return distinct.select("x").mapInArrow(run, "kind string, block binary")


def _added(blocks: DataFrame, d: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum, over all blocks, of the matrices that ``part`` makes of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for kind, block in zip(batch.column("kind").to_pylist(), batch.column("block"), strict=True):
                total += part(np.frombuffer(block.as_buffer(), np.dtype(kind)).reshape(-1, d).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    out = np.zeros(shape[0] * shape[1])
    for r in blocks.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # dimensions x directions
        out[r["i"]] = r["v"]
    return out.reshape(shape)


def _orthonormal(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the orthonormal ``old``."""
    out = old
    for c in new.T:
        size = np.linalg.norm(c)
        for _ in range(3):
            c = c - out @ (out.T @ c)
        left = np.linalg.norm(c)
        if size > 0 and left > 1e-10 * size:
            c = c / left
            c = c - out @ (out.T @ c)
            out = np.column_stack([out, c / np.linalg.norm(c)])
    return out[:, old.shape[1] :]


def corrections(times: Callable[[np.ndarray], np.ndarray], values: np.ndarray, residuals: np.ndarray, q: np.ndarray, steps: int) -> np.ndarray:
    """Solutions t of (I - qq')(V - value)(I - qq') t = -residual, one for each value, by ``steps`` of MINRES in step.

    ``times`` applies V to the columns of a matrix. A column whose Krylov space ends early keeps its solution."""
    out = lambda x: x - q @ (q.T @ x)
    norm = lambda x: np.sqrt((x * x).sum(axis=0))
    safe = lambda x: np.where(x == 0, 1.0, x)
    r = out(-residuals)
    beta = norm(r)
    v, v_old = r / safe(beta), np.zeros_like(r)
    t, d1, d2 = np.zeros_like(r), np.zeros_like(r), np.zeros_like(r)
    eta, beta_now = beta.copy(), np.zeros_like(beta)
    c1 = c2 = np.ones_like(beta)
    s1 = s2 = np.zeros_like(beta)
    alive = beta > 0
    for _ in range(steps):
        if not alive.any():
            break
        p = out(times(v) - v * values)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta_now * v_old
        p = out(p)
        beta_next = norm(p)
        delta = c1 * alpha - c2 * s1 * beta_now
        rho1 = np.sqrt(delta**2 + beta_next**2)
        rho2, rho3 = s1 * alpha + c2 * c1 * beta_now, s2 * beta_now
        ok = alive & (rho1 > 0)
        c0, s0 = np.where(ok, delta / safe(rho1), 1.0), np.where(ok, beta_next / safe(rho1), 0.0)
        d0 = np.where(ok, (v - rho2 * d1 - rho3 * d2) / safe(rho1), 0.0)
        t = t + np.where(ok, c0 * eta, 0.0) * d0
        eta = -s0 * eta
        alive = ok & (beta_next > 1e-14 * np.abs(values).max())
        v_old, v, beta_now = v, p / safe(beta_next), beta_next
        d2, d1, c2, c1, s2, s1 = d1, d0, c1, c0, s1, s0
    return t


def jacobi_davidson(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, steps: int = INNER_STEPS) -> tuple[np.ndarray, np.ndarray, int, float]:
    """(values, vectors, rounds, largest residual): the ``k`` leading eigenpairs of a symmetric positive operator on d dimensions.

    ``times`` applies it to the columns of a matrix. Pairs are exact when their residuals are below 64 * epsilon * sqrt(d) of the largest
    value, or as small as rounding lets them be: the space is whole, or below 1e-11 no round of STUCK has halved the largest one."""
    k = min(k, d)
    basis = _orthonormal(np.random.default_rng(7).standard_normal((d, k)), np.zeros((d, 0)))
    image, rounds, best, since = times(basis), 0, np.inf, 0
    while True:
        rounds += 1
        small = basis.T @ image
        value, inside = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(value)[::-1][:k]
        value, inside = value[order], inside[:, order]
        ritz = basis @ inside
        residual = image @ inside - ritz * value
        size = np.sqrt((residual**2).sum(axis=0)) / max(value[0], np.finfo(float).tiny)
        open_ = size > 64 * np.finfo(float).eps * np.sqrt(d)  # the others are locked: they get no correction, but stay in every projection
        worst = float(size.max())
        best, since = (worst, 0) if worst < best / 2 else (best, since + 1)
        if not open_.any() or basis.shape[1] == d or (worst < 1e-11 and since >= STUCK):
            return value, ritz, rounds, worst
        if basis.shape[1] + open_.sum() > WIDEST * k and basis.shape[1] > k:
            basis = _orthonormal(ritz, np.zeros((d, 0)))
            image = times(basis)
        new = corrections(times, value[open_], residual[:, open_], ritz, steps)
        new = _orthonormal(np.column_stack([new, residual[:, open_]]), basis)[:, : max(1, int(open_.sum()))]
        if not new.shape[1]:
            return value, ritz, rounds, worst
        basis, image = np.column_stack([basis, new]), np.column_stack([image, times(new)])


def fit(distinct: DataFrame, components: int, tables: Workspace) -> tuple[Fit | None, float]:
    """The components of the distinct x vectors, and the identity error of the whitening. Without vectors None. Directions without
    variance are no components."""
    first = distinct.select(F.size("x")).first()
    if first is None:
        return None, 0.0
    d = first[0]
    n, sums = _sums(distinct, d)
    base = [s // n for s in sums]
    blocks = tables.durable(_blocks(distinct, np.array(base, np.int64)))
    rest = np.array([s - n * b for s, b in zip(sums, base, strict=True)], object)
    mean = np.array([float(r) / n for r in rest])

    def times(w: np.ndarray) -> np.ndarray:
        return _added(blocks, d, (d, w.shape[1]), lambda x: (x - mean).T @ ((x - mean) @ w)) / n

    trace = float(_added(blocks, d, (d, 1), lambda x: ((x - mean) ** 2).sum(axis=0)[:, None]).sum()) / n
    if trace == 0:
        return Fit(n, np.array(base, np.int64), rest, np.zeros(0), np.zeros((d, 0)), 0.0, 0, 0.0), 0.0
    value, vector, rounds, residual = jacobi_davidson(times, d, components)
    some = value > d * np.finfo(float).eps * value[0]
    value, vector = value[some], vector[:, some]
    whitener = vector / np.sqrt(value)
    k = len(value)
    total = _added(blocks, d, (k + 1, k), lambda x: (lambda y: np.vstack([y.T @ y, y.sum(axis=0)]))((x - mean) @ whitener)) / n
    covariance = total[:k] - np.outer(total[k], total[k])
    return Fit(n, np.array(base, np.int64), rest, value, vector, trace, rounds, residual), float(np.abs(covariance - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, rest: np.ndarray) -> list[int]:
    """Exact sums over dimensions of (n * x - rest)^2, x a matrix of integers less their base."""
    rest = [int(r) for r in rest]
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, rest)) if x.size else 0
    if len(rest) * most * most < 1 << 62:
        return ((n * x - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in x.tolist()]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and leading component.

    ``vectors`` has vec_id and embedding. Rows whose vector is null, empty, has null or non-finite entries, or another length than most are
    dropped; the rest become x = floor(64 c) + 1000000. n counts the distinct x, on which means and covariance (divisor n) are taken; repeated
    vectors and repeated or null vec_ids get rows each. whitened is the centred x on a unit eigenvector over the root of its
    eigenvalue, explained the eigenvalue's share of the trace, deviation the exact sum of (n x - sum)^2 (an error if no long holds it), identity_error
    the largest entry of the whitened fit list's covariance less the identity. Components number the falling eigenvalues from 1;
    directions without variance are left out, so equal vectors only, or no vectors at all, give no rows. Other columns don't matter.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    with Workspace(vectors.sparkSession) as tables:
        rows = quantized(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
        found, error = fit(tables.durable(rows.select("x").distinct()), components, tables)
    if found is None or not len(found.values):
        return vectors.sparkSession.createDataFrame([], schema)
    whitener, mean, k, d = found.vectors / np.sqrt(found.values), np.array([float(r) / found.n for r in found.rest]), len(found.values), len(found.base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                some = batch.slice(at, BLOCK)
                x = _matrix(some.column("x"), d) - found.base
                far = pa.array(np.repeat(np.array(deviations(x, found.n, found.rest), object), k).tolist(), pa.int64())
                again = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [some.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, found.n)), far]
                columns += [pa.array(((x - mean) @ whitener).ravel()), pa.array(np.tile(found.values / found.trace, len(x))), pa.array(np.full(len(x) * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
