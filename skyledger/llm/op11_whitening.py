"""Operator 11: whitening of embeddings along their leading components, found by Jacobi-Davidson.

Entries are scaled and rounded down to whole numbers x. The *fit list* holds each distinct x vector
once, in blocks of bounded size written to the shared folder. The covariance V is never formed: a
pass over the blocks multiplies the centred vectors with a few columns at a time, every task adds up
its blocks, and the driver gets one row for each dimension.

The search keeps an orthonormal basis and its product with V. In a step the basis' Ritz pairs are
taken; a pair whose residual has reached double precision is *locked*: it stays in the basis and no
equation is solved for it any more. For each other wanted pair the correction equation, projected
off all wanted vectors, is solved by some steps of MINRES, for all pairs in the same passes, and the
basis grows by the corrections. A basis that gets too wide starts again from its best vectors.
Residuals are measured anew by a last pass.

Defined results: rows whose vector is null, or holds a null or an entry that is not finite, are left
out, as are vectors of another length than the most frequent one (the longer of two equally frequent).
Components without variance are none: equal vectors, a single one or none give no rows. Numbers beyond
long are taken as the greatest or least long. ``deviation`` is null where it is beyond long. Repeated
rows get equal rows; a null ``vec_id`` stays. Columns other than those two never reach the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import stash

#: What an entry is multiplied with before it is rounded down, and components that are wanted.
SCALE, WANTED = 256, 4
#: Bytes of a block of the fit list, and of the vectors that are projected at once.
BLOCK_BYTES = 1 << 20
#: Steps of the inner solver, the share of a right side that it leaves, and vectors in the basis.
INNER_STEPS, INNER_REST, WIDEST = 6, 0.01, 48

Product = Callable[[np.ndarray], np.ndarray]


def whole_numbers(vectors: DataFrame, scale: int = SCALE, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows whose vector is whole and finite and has the most frequent length."""
    finite = F.forall(column, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where(F.col(column).isNotNull() & finite)
    rows = rows.select(F.col(id_column).alias("vec_id"), F.transform(column, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long")).alias("x"))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (usual["d"] if usual else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _slices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK_BYTES // (8 * d))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


@dataclass
class FitList:
    """The distinct vectors in blocks, how many they are, and the sum of each dimension."""

    blocks: DataFrame
    d: int
    n: int
    sums: list[int]

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function that takes whole vectors to vectors less the mean."""
        n, sums = self.n, self.sums
        narrow = max((abs(s) for s in sums), default=0) < 1 << 61
        mean = np.array([s / n for s in sums])
        whole = np.array(sums, dtype=np.int64) if narrow else None

        def step(x: np.ndarray) -> np.ndarray:
            if narrow and x.size and n * int(np.abs(x.astype(float)).max()) < 1 << 61:
                return (n * x - whole) / n
            return x.astype(float) - mean

        return step

    def summed(self, step: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> np.ndarray:
        """The sum over blocks of ``step(centred block)``, a matrix of ``height`` rows: a task sends the
        sum of its blocks, Spark adds the rows up, and the driver gets ``height`` rows."""
        d, centred = self.d, self.centred()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for block in batch.column("block"):
                    got = step(centred(np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(-1, d)))
                    total = got if total is None else total + got
            if total is not None:
                columns = [pa.array(np.arange(height), pa.int32()), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(width)]]
                yield pa.RecordBatch.from_arrays(columns, names=["i", *names])

        names = [f"y{j}" for j in range(width)]
        parts = self.blocks.mapInArrow(run, ", ".join(["i int", *[f"{y} double" for y in names]]))
        out = np.zeros((height, width))
        for r in parts.groupBy("i").agg(*[F.sum(y).alias(y) for y in names]).collect():
            out[r["i"]] = [r[y] for y in names]
        return out

    def product(self, u: np.ndarray) -> np.ndarray:
        """The covariance times some columns."""
        return self.summed(lambda c: c.T @ (c @ u), self.d, u.shape[1]) / self.n

    def variance(self) -> float:
        """The sum of the variances of all dimensions."""
        return float(self.summed(lambda c: np.array([[np.vdot(c, c)]]), 1, 1)[0, 0]) / self.n


def fit_list(rows: DataFrame) -> FitList | None:
    """Each distinct ``x`` of ``rows`` once; None if there is none, or only empty ones."""
    first = rows.select(F.size("x").alias("d")).first()
    if first is None or first["d"] == 0:
        return None
    d = first["d"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, d):
            yield pa.RecordBatch.from_arrays([pa.array([_matrix(part.column("x"), d).tobytes()], pa.binary())], names=["block"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            for block in batch.column("block"):
                x = np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(-1, d)
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    blocks = stash(rows.select("x").distinct().mapInArrow(pack, "block binary"), "vectors")
    totals = blocks.mapInArrow(add, "i int, n long, high long, low long").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])
    sums = {r["i"]: (r["n"], (r["high"] << 32) + r["low"]) for r in totals.collect()}
    return FitList(blocks, d, sums[0][0], [sums[i][1] for i in range(d)])


def corrections(product: Product, wanted: np.ndarray, values: np.ndarray, right: np.ndarray, steps: int = INNER_STEPS, rest: float = INNER_REST) -> np.ndarray:
    """For each column, about the solution off ``wanted`` of (V - value) t = right, by MINRES: the
    columns have recurrences of their own and share the passes."""
    off = lambda y: y - wanted @ (wanted.T @ y)
    m = right.shape[1]
    out = np.zeros_like(right)
    ahead = off(right)
    beta = np.linalg.norm(ahead, axis=0)
    start, eta = beta.copy(), beta.copy()
    old = np.zeros_like(right)
    w0, w1 = np.zeros_like(right), np.zeros_like(right)
    c0, c1, s0, s1 = np.ones(m), np.ones(m), np.zeros(m), np.zeros(m)
    open_ = np.flatnonzero(beta > 0)
    for _ in range(steps):
        if not open_.size:
            break
        k = open_
        v = ahead[:, k] / beta[k]
        p = off(product(v) - v * values[k])
        alpha = np.einsum("ij,ij->j", v, p)
        following = p - v * alpha - old[:, k] * beta[k]
        longer = np.linalg.norm(following, axis=0)
        delta = c1[k] * alpha - c0[k] * s1[k] * beta[k]
        r1 = np.maximum(np.hypot(delta, longer), np.finfo(float).tiny)
        r2 = s1[k] * alpha + c0[k] * c1[k] * beta[k]
        r3 = s0[k] * beta[k]
        c0[k], s0[k] = c1[k], s1[k]
        c1[k], s1[k] = delta / r1, longer / r1
        w = (v - w0[:, k] * r3 - w1[:, k] * r2) / r1
        w0[:, k], w1[:, k] = w1[:, k], w
        out[:, k] += w * (c1[k] * eta[k])
        eta[k] *= -s1[k]
        old[:, k], ahead[:, k], beta[k] = v, following, longer
        open_ = k[(np.abs(eta[k]) > rest * start[k]) & (longer > 1e-14 * np.abs(alpha) + np.finfo(float).tiny)]
    return off(out)


def orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What ``new`` adds to the span of ``basis``, as orthonormal columns."""
    kept: list[np.ndarray] = []
    for column in new.T:
        length = np.linalg.norm(column)
        if not length > 0:
            continue
        v = column / length
        for _ in range(3):
            v = v - basis @ (basis.T @ v)
            for k in kept:
                v = v - k * (k @ v)
            if not np.linalg.norm(v) > 1e-8:
                break
            v = v / np.linalg.norm(v)
        else:
            kept.append(v)
    return np.stack(kept, axis=1) if kept else np.zeros((len(basis), 0))


def leading_pairs(product: Product, d: int, wanted: int = WANTED, widest: int = WIDEST, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, and unit eigenvectors as columns."""
    p = min(wanted, d)
    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((d, min(d, 2 * p))))[0]
    held = product(basis)
    best = (np.inf, np.zeros(p), np.zeros((d, p)))
    stalled = 0
    for _ in range(most):
        small = basis.T @ held
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz, image = basis @ turns, held @ turns
        exact = 8 * d * np.finfo(float).eps * max(values[0], np.finfo(float).tiny)
        lengths = np.linalg.norm(image[:, :p] - ritz[:, :p] * values[:p], axis=0)
        if lengths.max() <= exact or basis.shape[1] == d:
            basis, held = ritz, image
            fresh = np.linalg.qr(ritz[:, :p])[0]  # a last pass for the residuals themselves
            seen = product(fresh)
            lengths = np.linalg.norm(seen - fresh * np.einsum("ij,ij->j", fresh, seen), axis=0)
            if lengths.max() < best[0]:
                best, stalled = (lengths.max(), np.einsum("ij,ij->j", fresh, seen), fresh), 0
            else:
                stalled += 1
            if lengths.max() <= exact or stalled > 2:
                break
            held[:, :p], basis[:, :p] = seen, fresh
            ritz, image = basis, held
        open_ = np.flatnonzero(lengths > exact)  # the others are locked
        right = ritz[:, open_] * values[open_] - image[:, open_]
        new = corrections(product, ritz[:, :p], values[open_], right)
        if basis.shape[1] + new.shape[1] > min(d, widest):
            basis, held = ritz[:, : 2 * p], image[:, : 2 * p]
        new = orthonormal(new, basis)[:, : d - basis.shape[1]]
        if not new.shape[1]:  # no correction leads out of the basis
            new = orthonormal(np.random.default_rng(basis.shape[1]).standard_normal((d, 1)), basis)
        basis, held = np.concatenate([basis, new], axis=1), np.concatenate([held, product(new)], axis=1)
    if not best[0] <= 1e-9 * max(best[1].max(), np.finfo(float).tiny):
        raise ArithmeticError(f"residual {best[0]} after {most} steps")
    order = np.argsort(-best[1], kind="stable")
    return best[1][order], best[2][:, order]


@dataclass
class Whitening:
    """Components by falling eigenvalue, the share of all variance in each, and how far whitened rows
    of the fit list are from uncorrelated ones of unit variance."""

    fit: FitList
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float


def whitening(fit: FitList, wanted: int = WANTED) -> Whitening:
    total = fit.variance()
    if total > 0:
        values, vectors = leading_pairs(fit.product, fit.d, wanted)
        some = values > 1e-12 * values.max()
        values, vectors = values[some], vectors[:, some]
    else:
        values, vectors = np.zeros(0), np.zeros((fit.d, 0))
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])] < 0, -1.0, 1.0)
    p, error = len(values), 0.0
    if p:
        turn = vectors / np.sqrt(values)
        mean = fit.summed(lambda c: (c @ turn).sum(axis=0)[None, :], 1, p)[0] / fit.n
        spread = lambda c: (w := c @ turn - mean).T @ w
        error = float(np.abs(fit.summed(spread, p, p) / fit.n - np.eye(p)).max())
    return Whitening(fit, values, vectors, values / total if p else values, error)


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """A row for each of ``rows`` (``vec_id, x``) and component, numbered from 1."""
    d, n, p = model.fit.d, model.fit.n, len(model.values)
    sums, centred = model.fit.sums, model.fit.centred()
    turn, explained, error = model.vectors / np.sqrt(model.values), model.explained, model.identity_error
    wrapped = np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums], dtype=np.int64)
    mean = np.array([s / n for s in sums])

    def deviations(x: np.ndarray) -> pa.Array:
        about = ((n * (x.astype(float) - mean)) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            y = n * x - wrapped  # exact modulo 2**64, and so is the sum of squares, which is below 2**63 where it counts
            exact = (y * y).sum(axis=1)
        close = np.flatnonzero((about > 9.2e18) & (about < 9.3e18))
        beyond = about >= 9.2e18
        for i in close:
            true = sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums, strict=True))
            beyond[i] = true >= 1 << 63
        return pa.array(exact, pa.int64(), mask=beyond)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, d):
            x = _matrix(part.column("x"), d)
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), p))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, p + 1), m), pa.int32()), pa.array(np.full(m * p, n), pa.int64()), deviations(x).take(each),
                    pa.array((centred(x) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * p, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    fit = fit_list(rows)
    if fit is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whiten(rows, whitening(fit))
