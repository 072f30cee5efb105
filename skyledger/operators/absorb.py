"""Effects of many levels taken out of the columns of a regression, without a design of dummies.

The effect with the most levels, the *unit*, has a diagonal block in the normal equations, so it is
eliminated exactly: what is left is one equation for each level of the other effects, and the product
of its matrix with some vectors takes one pass over the units' counts by level. Up to ``DENSE`` levels
the matrix is the product with the unit vectors, solved on the driver; beyond that conjugate gradients
ask for a product a step. Nothing has as many rows as pairs of levels, and the driver holds numbers
for the levels of the other effects only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.sources.raw import materialised

#: Levels of the other effects up to which their equations are solved as one matrix.
DENSE = 1500


def added(parts: DataFrame) -> DataFrame:
    """``key, sums`` (doubles as bytes): the sums by key of vectors of equal length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, value in zip(batch.column("key").to_pylist(), batch.column("sums"), strict=True):
                got = np.frombuffer(value.as_buffer())
                total[key] = total[key] + got if key in total else got
        for key, value in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([value.tobytes()], pa.binary())], names=["key", "sums"])

    return parts.repartition("key").mapInArrow(run, "key long, sums binary")


class _Levels:
    """The counts of units by level of the other effects, and what is multiplied with them."""

    def __init__(self, rows: DataFrame, unit: str, others: list[str], columns: list[str]):
        long = rows.select(F.col(unit).alias("u"), F.explode(F.array(*[F.struct(F.lit(k).alias("e"), F.col(e).cast("string").alias("v")) for k, e in enumerate(others)])).alias("l"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
        cells = long.groupBy("u", "l.e", "l.v").agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.sum(f"c{i}") for i in range(len(columns))]).alias("s"))
        # a unit has at most one cell for each level
        self.units = materialised(cells.groupBy("u").agg(F.collect_list(F.struct("e", "v", "n", "s")).alias("cells")), "units")
        found = self.units.select(F.explode("cells").alias("c")).select("c.e", "c.v").distinct().collect()
        self.names = sorted((r["e"], r["v"]) for r in found)
        self.index = {name: i for i, name in enumerate(self.names)}
        self.width = len(columns)
        # rows by the levels that stand together, whatever the unit
        self.together = materialised(rows.groupBy(F.array(*[F.col(e).cast("string") for e in others]).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n")), "together")

    def _together(self, v: np.ndarray) -> np.ndarray:
        """For each level the sum over its rows of what ``v`` has for all their levels."""
        index, width = self.index, v.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(index), width))
            for batch in batches:
                values, n = batch.column("v").to_pylist(), batch.column("n").to_numpy()
                at = np.array([[index[e, x] for e, x in enumerate(row)] for row in values], dtype=int)
                w = n[:, None] * v[at].sum(axis=1)
                for e in range(at.shape[1]):
                    np.add.at(total, at[:, e], w)
            keys = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([total[k].tobytes() for k in keys], pa.binary())], names=["key", "sums"])

        return self._gathered(self.together.mapInArrow(run, "key long, sums binary"), width)

    def _gathered(self, parts: DataFrame, width: int) -> np.ndarray:
        out = np.zeros((len(self.index), width))
        for r in added(parts).collect():  # a row for each level
            out[r["key"]] = np.frombuffer(r["sums"])
        return out

    def _pass(self, step, width: int) -> np.ndarray:
        """The sum over units of ``step(levels, counts, sums)``, a row for each level of the unit."""
        index, m = self.index, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(index), width))
            touched = np.zeros(len(index), bool)
            for batch in batches:
                ends = batch.column("cells").offsets.to_numpy()
                flat = batch.column("cells").flatten()
                at = np.array([index[e, v] for e, v in zip(flat.field("e").to_pylist(), flat.field("v").to_pylist(), strict=True)], dtype=int)
                first, n = flat.field("e").to_numpy() == 0, flat.field("n").to_numpy()
                s = flat.field("s").flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
                for a, b in zip(ends - ends[0], ends[1:] - ends[0], strict=False):
                    here = at[a:b]
                    total[here] += step(here, n[a:b], s[a:b], first[a:b])
                    touched[here] = True
            keys = np.flatnonzero(touched)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([total[k].tobytes() for k in keys], pa.binary())], names=["key", "sums"])

        return self._gathered(self.units.mapInArrow(run, "key long, sums binary"), width)

    def right(self) -> np.ndarray:
        return self._pass(lambda at, n, s, first: s - n[:, None] * (s[first].sum(axis=0) / n[first].sum()), self.width)

    def product(self, v: np.ndarray) -> np.ndarray:
        return self._together(v) - self._pass(lambda at, n, s, first: n[:, None] * ((n @ v[at]) / n[first].sum()), v.shape[1])

    def diagonal(self) -> np.ndarray:
        return self._pass(lambda at, n, s, first: (n - n * n / n[first].sum())[:, None], 1)[:, 0]


def conjugate_gradients(product, right: np.ndarray, diagonal: np.ndarray, tol: float = 1e-12, most: int = 1000) -> np.ndarray:
    """The solutions of a positive semidefinite system for several right sides in shared passes."""
    scale = np.where(diagonal > 0, 1 / np.maximum(diagonal, 1e-300), 0.0)[:, None]
    x, r = np.zeros_like(right), right.copy()
    z = scale * r
    p, rz = z.copy(), (r * z).sum(axis=0)
    goal = tol * tol * np.maximum(rz, 1e-300)
    for _ in range(most):
        if (open_ := rz > goal).any():
            q = product(p)
            a = np.where(open_, rz / np.maximum((p * q).sum(axis=0), 1e-300), 0.0)
            x, r = x + a * p, r - a * q
            z = scale * r
            last, rz = rz, (r * z).sum(axis=0)
            p = z + np.where(open_, rz / np.maximum(last, 1e-300), 0.0) * p
        else:
            return x
    raise ArithmeticError(f"effects: no convergence after {most} steps")


def without_effects(rows: DataFrame, columns: list[str], effects: list[str] | None, dense: int = DENSE) -> tuple[DataFrame, int]:
    """``rows`` with ``columns`` less their least-squares fit on a constant and all levels of all
    ``effects``, and how many independent columns that took beside the constant. Least squares, two-step
    GMM and LIML give the same coefficients then as with all dummies in the design. Rows with a null are
    left out. Beyond ``dense`` levels of the smaller effects each of these is taken to have one level
    that follows from others, which can only be too many columns."""
    if not effects:
        return rows, 0
    rows = materialised(rows.dropna(), "rows")
    sizes = rows.agg(*[F.count_distinct(e).alias(f"n{k}") for k, e in enumerate(effects)]).first()
    order = sorted(range(len(effects)), key=lambda k: -sizes[k])
    unit, others = effects[order[0]], [effects[k] for k in order[1:] if sizes[k] > 1]
    taken = max(sizes[order[0]] - 1, 0)
    left = rows
    if others:
        levels = _Levels(rows, unit, others, columns)
        right = levels.right()
        if len(levels.names) <= dense:
            values, turns = np.linalg.eigh(levels.product(np.eye(len(levels.names))))
            some = values > 1e-9 * max(values.max(), 1e-300)
            coef = (turns[:, some] / values[some]) @ (turns[:, some].T @ right)
            taken += int(some.sum())
        else:
            coef = conjugate_gradients(levels.product, right, levels.diagonal())
            taken += len(levels.names) - len(others)
        for k, e in enumerate(others):
            table = [(v, *map(float, coef[i])) for (kind, v), i in levels.index.items() if kind == k]
            schema = ", ".join([f"_v{k} string", *[f"_e{k}_{i} double" for i in range(len(columns))]])
            left = left.join(rows.sparkSession.createDataFrame(table, schema), F.col(e).cast("string") == F.col(f"_v{k}")).drop(f"_v{k}")
            left = left.withColumns({c: F.col(c) - F.col(f"_e{k}_{i}") for i, c in enumerate(columns)}).drop(*[f"_e{k}_{i}" for i in range(len(columns))])
    means = left.groupBy(F.col(unit).alias("_u")).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    left = left.join(means, F.col(unit) == F.col("_u")).drop("_u")
    return left.withColumns({c: F.col(c) - F.col(f"_m{i}") for i, c in enumerate(columns)}).drop(*[f"_m{i}" for i in range(len(columns))]), taken
