"""Panel regressions out of moment matrices.

Rows stay on Spark. One pass adds up the cross products of all columns that a set of specifications
needs, and a second one the lagged products of their pairwise products: the moments of a residual
are linear in these, whatever the coefficients are, and so every specification's estimates, errors
and tests are solved on the driver from two matrices without another pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators.absorb import added, without_effects

BANDWIDTH = 4


def estimation_sample(panel: DataFrame, regressand: str, unit: str = "od", first: int = 200201, last: int = 201312, least_rows: int = 6) -> DataFrame:
    """Rows in the window with a regressand, of units with enough of them, and their months ``t``."""
    from skyledger.functions.columns import month_index

    rows = panel.where(F.col("ym").between(first, last) & F.col(regressand).isNotNull())
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(unit))).where(F.col("_n") >= least_rows).drop("_n")
    return rows.withColumn("t", month_index("ym"))


def cross_products(df: DataFrame, columns: list[str], dummies: list[str] | None = None) -> dict[tuple[str, str], float]:
    """Sums of products of every two columns and of each with a constant, named ``1``. A task adds its
    rows up, Spark adds the tasks, and the driver gets a row for each column. ``dummies`` are codes of
    few values, of which each but the least is a column ``code=value``; effects of many levels are taken
    out by ``without_effects``."""
    for d in dummies or []:
        values = [r[0] for r in df.select(d).dropna().distinct().orderBy(d).collect()][1:]
        df = df.withColumns({f"{d}={v}": (F.col(d) == F.lit(v)).cast("double") for v in values})
        columns = [*columns, *[f"{d}={v}" for v in values]]
    names = ["1", *columns]
    used = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), len(names)))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *[c.to_numpy(zero_copy_only=False) for c in batch.columns]])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(len(names)), pa.int64()), pa.array([r.tobytes() for r in total], pa.binary())], names=["key", "sums"])

    rows = {r["key"]: np.frombuffer(r["sums"]) for r in added(used.mapInArrow(run, "key long, sums binary")).collect()}
    return {(a, b): float(rows[i][j]) if rows else 0.0 for i, a in enumerate(names) for j, b in enumerate(names)}


def independent(gram: np.ndarray, names: list[str], protected: int = 1, tol: float = 1e-9) -> list[str]:
    """Columns that are no combination of those before them, by one sweep of a Cholesky factor; the
    first ``protected`` always stay."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    g = gram / np.outer(scale, scale)
    kept: list[int] = []
    factor = np.zeros((len(names), len(names)))
    for k in range(len(names)):
        m = len(kept)
        row = np.zeros(m)
        for i in range(m):
            row[i] = (g[k, kept[i]] - row[:i] @ factor[i, :i]) / factor[i, i]
        rest = g[k, k] - row @ row
        if gram[k, k] > 0 and rest > tol or k < protected:
            factor[m, :m], factor[m, m] = row, math.sqrt(max(rest, 1e-300))
            kept.append(k)
    return [names[k] for k in kept]


def _pairs_within(later: tuple, earlier: tuple, bandwidth: int, by_unit: bool, gammas: np.ndarray, offset: int) -> None:
    """Add the products of rows that stand ``offset`` rows apart to those of their lag."""
    (u1, t1, m1), (u0, t0, m0) = later, earlier
    if not by_unit:
        gammas[offset] += m1.T @ m0
        return
    gap = np.where(u1 == u0, t1 - t0, 0)
    for lag in range(1, bandwidth + 1):
        if (here := gap == lag).any():
            gammas[lag] += m1[here].T @ m0[here]


def lagged_products(df: DataFrame, unit: str, time: str, columns: list[str], make: Callable[[np.ndarray], np.ndarray], width: int, bandwidth: int, by_unit: bool = True) -> np.ndarray:
    """``G0 + sum w_j (G_j + G_j')`` with Bartlett weights, of the moments ``make`` gives for a matrix
    of ``columns``, in one shuffle for any bandwidth.

    By unit, a pair counts if it is exactly j months apart in one unit. Else j rows apart in the order
    of unit and time, which crosses units. Rows are sorted over all tasks; a task keeps a ring of its
    last rows, and hands its first and last ones to the driver, which pairs those of tasks that follow
    one another: at most ``bandwidth`` rows of either end of each task.
    """
    used = df.select(F.xxhash64(unit).alias("u"), F.col(time).cast("long").alias("t"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], F.col(unit).alias("_unit")).dropna()
    ordered = used.orderBy("_unit", "t").select("u", "t", *[f"c{i}" for i in range(len(columns))], F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gammas = np.zeros((bandwidth + 1, width, width))
        ring: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width)))
        held: tuple | None = None
        head: list[np.ndarray] = []
        n_head, part = 0, None

        def take(u: np.ndarray, t: np.ndarray, m: np.ndarray) -> None:
            nonlocal ring, n_head
            if n_head < bandwidth:
                first = slice(0, bandwidth - n_head)
                head.append(np.column_stack([u[first].view(float), t[first].view(float), m[first]]))
                n_head += len(u[first])
            k = len(ring[0])
            u, t, m = np.concatenate([ring[0], u]), np.concatenate([ring[1], t]), np.concatenate([ring[2], m])
            for offset in range(1, bandwidth + 1):
                at = max(k, offset)
                if at < len(u):
                    _pairs_within((u[at:], t[at:], m[at:]), (u[at - offset : -offset], t[at - offset : -offset], m[at - offset : -offset]), bandwidth, by_unit, gammas, offset)
            keep = slice(max(len(u) - bandwidth, 0), None)
            ring = (u[keep], t[keep], m[keep])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            u, t = batch.column("u").to_numpy().copy(), batch.column("t").to_numpy().copy()
            m = make(np.column_stack([batch.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(len(columns))]))
            gammas[0] += m.T @ m
            if by_unit:  # rows of one unit and month count as their sum in lagged pairs; the last may go on in the next batch
                if held is not None:
                    u, t, m = np.r_[held[0], u], np.r_[held[1], t], np.concatenate([held[2], m])
                starts = np.flatnonzero(np.r_[True, (np.diff(u) != 0) | (np.diff(t) != 0)])
                u, t, m = u[starts], t[starts], np.add.reduceat(m, starts, axis=0)
                held, u, t, m = (u[-1:], t[-1:], m[-1:]), u[:-1], t[:-1], m[:-1]
            if len(u):
                take(u, t, m)
        if held is not None:
            take(*held)
        if part is None:
            return
        tail = np.column_stack([ring[0].view(float), ring[1].view(float), ring[2]])
        edges = [np.concatenate(head) if head else np.zeros((0, width + 2)), tail]
        keys = [*range(bandwidth + 1), -2 * part - 1, -2 * part - 2]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([*[g.tobytes() for g in gammas], *[e.tobytes() for e in edges]], pa.binary())], names=["key", "sums"])

    gammas = np.zeros((bandwidth + 1, width, width))
    ends: dict[int, np.ndarray] = {}
    for r in added(ordered.mapInArrow(run, "key long, sums binary")).collect():
        if r["key"] >= 0:
            gammas[r["key"]] = np.frombuffer(r["sums"]).reshape(width, width)
        else:
            ends[-r["key"] - 1] = np.frombuffer(r["sums"]).reshape(-1, width + 2)
    split = lambda e: (np.ascontiguousarray(e[:, 0]).view(np.int64), np.ascontiguousarray(e[:, 1]).view(np.int64), e[:, 2:])
    ring = np.zeros((0, width + 2))
    for part in sorted(k // 2 for k in ends if k % 2 == 0):
        head, tail = ends[2 * part], ends[2 * part + 1]
        for i in range(len(head)):
            for offset in range(i + 1, bandwidth + 1):  # nearer rows are in the same task
                if (at := len(ring) + i - offset) >= 0:
                    _pairs_within(split(head[i : i + 1]), split(ring[at : at + 1]), bandwidth, by_unit, gammas, offset)
        ring = np.concatenate([ring, tail])[-bandwidth:] if bandwidth else ring
    out = gammas[0].copy()
    for lag in range(1, bandwidth + 1):
        out += (1 - lag / (bandwidth + 1)) * (gammas[lag] + gammas[lag].T)
    return out


def lagged_moments(df: DataFrame, unit: str, time: str, moments: list[str], bandwidth: int, by_unit: bool = True) -> np.ndarray:
    """Bartlett-weighted covariance sums of moment columns."""
    return lagged_products(df, unit, time, moments, lambda x: x, len(moments), bandwidth, by_unit)


@dataclass
class Panel:
    """All that specifications over the same rows need: the cross products of centred and scaled
    columns (the constant first, named ``1``), and the lagged sums of their pairwise products."""

    names: list[str]
    gram: np.ndarray
    lagged: np.ndarray | None
    n: int
    mean: np.ndarray
    scale: np.ndarray
    absorbed: int = 0
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), int))

    def at(self, names: list[str]) -> list[int]:
        return [self.names.index(c) for c in names]

    def block(self, a: list[str], b: list[str]) -> np.ndarray:
        return self.gram[np.ix_(self.at(a), self.at(b))]

    def kept(self, names: list[str], after: list[str] | None = None) -> list[str]:
        """``names`` without those that follow from a constant, ``after`` and the ones before them."""
        base = self.independent(["1", *(after or [])])
        return [c for c in self.independent([*base, *names], len(base)) if c not in base]

    def independent(self, names: list[str], protected: int = 1) -> list[str]:
        return independent(self.block(names, names), names, protected)

    def moment_map(self, z: list[str], weights: dict[str, float]) -> np.ndarray:
        """The moments of each of ``z`` with a combination of columns, as a map from pairwise products."""
        out = np.zeros((len(z), int(self.pairs.max()) + 1))
        for row, k in enumerate(self.at(z)):
            for c, w in weights.items():
                out[row, self.pairs[k, self.names.index(c)]] += w
        return out

    def spread(self, left: np.ndarray, right: np.ndarray | None = None) -> np.ndarray:
        return left @ self.lagged @ (left if right is None else right).T

    def own(self, names: list[str], b: np.ndarray, cov: np.ndarray | None, y: str) -> tuple[np.ndarray, np.ndarray | None]:
        """Coefficients (and their covariance) in the columns' own units, the constant among them."""
        k = self.names.index(y)
        back = np.zeros((len(names), len(names)))
        for i, c in enumerate(names):
            j = self.names.index(c)
            back[i, i] = self.scale[k] / self.scale[j]
            if c != "1" and "1" in names:
                back[names.index("1"), i] = -self.mean[j] * self.scale[k] / self.scale[j]
        out = back @ b
        if "1" in names:
            out[names.index("1")] += self.mean[k]
        return out, None if cov is None else back @ cov @ back.T

    def fit_measures(self, y: str, names: list[str], b: np.ndarray, k: int) -> dict:
        yy, xy, xx = self.block([y], [y])[0, 0], self.block(names, [y])[:, 0], self.block(names, names)
        unit = self.scale[self.names.index(y)] ** 2
        rss = max(float(yy - 2 * b @ xy + b @ xx @ b), 0.0)
        return {"n": self.n, "k": k, "rss": rss * unit, "adj_r2": float(1 - rss / yy * (self.n - 1) / (self.n - k)) if yy > 0 else float("nan"), "rmse": math.sqrt(rss * unit / (self.n - k))}

    def result(self, y: str, names: list[str], b: np.ndarray, cov: np.ndarray | None, **more) -> dict:
        measures = self.fit_measures(y, names, b, len(names) + self.absorbed)
        b, cov = self.own(names, b, cov, y)
        shown = slice(1 if self.absorbed else 0, None)
        out = {"names": names[shown], "b": b[shown]} | ({} if cov is None else {"se": np.sqrt(np.maximum(np.diag(cov), 0))[shown]})
        return out | measures | more

    def ols(self, y: str, x: list[str]) -> dict:
        """Least squares with a constant and HAC errors, corrected for degrees of freedom; columns that
        follow from those before them go."""
        names = self.independent(["1", *x])
        inv = np.linalg.inv(self.block(names, names))
        b = inv @ self.block(names, [y])[:, 0]
        s = self.spread(self.moment_map(names, {y: 1.0} | {c: -v for c, v in zip(names, b, strict=True)}))
        return self.result(y, names, b, inv @ s @ inv * self.n / (self.n - len(names) - self.absorbed))

    def design(self, exog: list[str], endog: list[str], instruments: list[str]) -> tuple[list[str], list[str], list[str]]:
        exog = self.kept(exog)
        endog, instruments = self.kept(endog, exog), self.kept(instruments, exog)
        if len(instruments) < len(endog):
            raise ValueError(f"{len(instruments)} independent instruments for {len(endog)} endogenous columns")
        return exog, endog, instruments

    def gmm(self, y: str, exog: list[str], endog: list[str], instruments: list[str]) -> dict:
        """Two-step GMM with a HAC weight, and Hansen's J."""
        exog, endog, instruments = self.design(exog, endog, instruments)
        n, x, z = self.n, ["1", *exog, *endog], ["1", *exog, *instruments]
        zx, zy = self.block(z, x), self.block(z, [y])[:, 0]
        residual = lambda b: self.moment_map(z, {y: 1.0} | {c: -v for c, v in zip(x, b, strict=True)})
        solve = lambda w: np.linalg.solve(zx.T @ w @ zx, zx.T @ w @ zy)
        w = np.linalg.inv(self.spread(residual(solve(np.linalg.inv(self.block(z, z) / n)))) / n)
        b = solve(w)
        s = self.spread(residual(b)) / n
        bread = np.linalg.inv(zx.T @ w @ zx / n / n)
        cov = bread @ (zx.T / n @ w @ s @ w @ zx / n) @ bread / (n - len(x) - self.absorbed)
        g, df = (zy - zx @ b) / n, len(instruments) - len(endog)
        j = float(n * g @ w @ g)
        return self.result(y, x, b, cov, j=j, j_df=df, j_p=chi2_tail(j, df))

    def liml(self, y: str, exog: list[str], endog: list[str], instruments: list[str]) -> dict:
        """Limited-information maximum likelihood: the k-class estimate at the least root."""
        exog, endog, instruments = self.design(exog, endog, instruments)
        inc, z, x, w = ["1", *exog], ["1", *exog, *instruments], ["1", *exog, *endog], [y, *endog]
        off = lambda c: self.block(w, w) - self.block(w, c) @ np.linalg.solve(self.block(c, c), self.block(c, w))
        k = float(np.min(np.linalg.eigvals(np.linalg.solve(off(z), off(inc))).real))
        through = lambda r, c: self.block(r, z) @ np.linalg.solve(self.block(z, z), self.block(z, c))
        left = (1 - k) * self.block(x, x) + k * through(x, x)
        return self.result(y, x, np.linalg.solve(left, (1 - k) * self.block(x, [y])[:, 0] + k * through(x, [y])[:, 0]), None, kappa=k)

    def rank_tests(self, exog: list[str], endog: list[str], instruments: list[str], iid: bool = False) -> dict:
        """Cragg-Donald and Anderson, and for every rank q below the number of endogenous columns the
        Kleibergen-Paap statistics of the hypothesis that the reduced form has rank q.

        The reduced form is measured in roots of the instruments' and residuals' covariances; its
        singular vectors beyond the first q span what should vanish, and a quadratic form in it, weighted by the
        covariance of the reduced form, is chi-square. The LM form takes the covariance of residuals of
        the form cut to rank q, the Wald form that of free ones. With ``iid`` the covariance is the
        classical one, under which they are Anderson's and Cragg and Donald's at the greatest q.
        """
        exog, endog, instruments = self.design(exog, endog, instruments)
        n, inc, m, l = self.n, ["1", *exog], len(endog), len(instruments)  # noqa: E741
        both = [*endog, *instruments]
        onto = np.linalg.solve(self.block(inc, inc), self.block(inc, both))
        rest = (self.block(both, both) - self.block(both, inc) @ onto) / n
        yy, zy, zz = rest[:m, :m], rest[m:, :m], rest[m:, m:]
        roots = np.sort(np.linalg.eigvals(np.linalg.solve(yy, zy.T @ np.linalg.solve(zz, zy))).real)
        least, k = float(min(max(roots[0], 0.0), 1 - 1e-15)), len(inc) + l + self.absorbed
        out: dict = {"n": n, "df": l - m + 1, "anderson_lm": n * least, "cragg_donald": n * least / (1 - least), "cragg_donald_f": least / (1 - least) * (n - k) / l}
        pi = np.linalg.solve(zz, zy)
        free = yy - pi.T @ zy - zy.T @ pi + pi.T @ zz @ pi
        half = lambda a, power: (lambda v, t: (t * np.maximum(v, 1e-14) ** power) @ t.T)(*np.linalg.eigh((a + a.T) / 2))
        z_root, v_root = half(zz, 0.5), half(free, -0.5)
        theta = z_root @ pi @ v_root
        left, sizes, right = np.linalg.svd(theta)
        to_theta, from_pi = np.kron(v_root, z_root), np.kron(np.eye(m), np.linalg.inv(zz))

        def less_included(c: str) -> dict[str, float]:
            return {c: 1.0} | {i: -float(v) for i, v in zip(inc, onto[:, both.index(c)], strict=True)}

        def spread_of(form: np.ndarray) -> np.ndarray:
            """The covariance of the instruments' moments with the residuals of a reduced form."""
            if iid:
                return np.kron(yy - form.T @ zy - zy.T @ form + form.T @ zz @ form, zz)
            maps = []
            for j in range(m):
                u = less_included(endog[j])
                for i, z in enumerate(instruments):
                    for c, v in less_included(z).items():
                        u[c] = u.get(c, 0.0) - form[i, j] * v
                for z in instruments:  # the instrument too is what is left of it
                    own = less_included(z)
                    maps.append(np.array(list(own.values())) @ self.moment_map(list(own), u))
            return self.spread(np.array(maps)) / n

        for q in range(m):
            kept = np.linalg.inv(z_root) @ (left[:, :q] * sizes[:q]) @ right[:q] @ np.linalg.inv(v_root)
            a, b = left[:, q:], right[q:].T
            lam = (a.T @ theta @ b).reshape(-1, order="F")
            turn = np.kron(b, a)
            df = (l - q) * (m - q)
            for kind, form in (("lm", kept), ("wald", pi)):
                weight = to_theta @ from_pi @ spread_of(form) @ from_pi.T @ to_theta.T
                value = float(n * lam @ np.linalg.pinv(turn.T @ weight @ turn, hermitian=True) @ lam)
                out |= {f"kp_{kind}_{q}": value, f"kp_{kind}_{q}_p": chi2_tail(value, df)}
            out |= {f"kp_df_{q}": df, f"kp_wald_f_{q}": out[f"kp_wald_{q}"] / l}
        return out


def panel(df: DataFrame, columns: list[str], unit: str = "od", time: str = "t", bandwidth: int = BANDWIDTH, by_unit: bool = True, effects: list[str] | None = None, errors: bool = True) -> Panel:
    """The matrices of all specifications over ``columns``, in two passes: over the rows that have all
    of them, less ``effects``. Without ``errors`` the lagged products are left out."""
    columns = list(dict.fromkeys(columns))
    rows = df.select(*dict.fromkeys([unit, time, *columns, *(effects or [])])).dropna()
    rows = rows.withColumns({c: F.col(c).cast("double") for c in columns})
    rows, absorbed = without_effects(rows, columns, effects)
    sums = cross_products(rows, columns)
    n = sums["1", "1"]
    if not n:
        raise ValueError("no rows to estimate from")
    mean = np.array([sums["1", c] / n for c in columns])
    raw = np.array([[sums[a, b] for b in columns] for a in columns]) - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(raw) / n, 0))
    tiny = 1e-9 * np.sqrt(np.array([sums[c, c] / n for c in columns]))
    flat = scale <= tiny  # a constant column: nothing is left of it
    scale = np.where(flat, 1.0, scale)
    gram = np.zeros((len(columns) + 1,) * 2)
    gram[0, 0], gram[1:, 1:] = n, np.where(flat[:, None] | flat[None, :], 0.0, raw) / np.outer(scale, scale)
    m = len(columns) + 1
    pairs = np.zeros((m, m), int)
    upper = np.triu_indices(m)
    pairs[upper] = range(len(upper[0]))
    pairs = np.maximum(pairs, pairs.T)
    lagged = None
    if errors:

        def products(x: np.ndarray) -> np.ndarray:
            c = np.column_stack([np.ones(len(x)), np.where(flat, 0.0, (x - mean) / scale)])
            return c[:, upper[0]] * c[:, upper[1]]

        lagged = lagged_products(rows, unit, time, columns, products, len(upper[0]), bandwidth, by_unit)
    return Panel(["1", *columns], gram, lagged, int(n), np.r_[0.0, mean], np.r_[1.0, scale], absorbed, pairs)


def ols(df: DataFrame, y: str, x: list[str], unit: str = "od", time: str = "t", bandwidth: int = BANDWIDTH, by_unit: bool = True, effects: list[str] | None = None) -> dict:
    """Least squares with a constant and Bartlett HAC errors. With ``effects`` the constant is one of
    them, and the fit's measures are those within them."""
    return panel(df, [y, *x], unit, time, bandwidth, by_unit, effects).ols(y, x)


def gmm(df: DataFrame, y: str, exog: list[str], endog: list[str], instruments: list[str], unit: str = "od", time: str = "t", bandwidth: int = BANDWIDTH, by_unit: bool = True, effects: list[str] | None = None) -> dict:
    """Two-step GMM with a Bartlett weight, and Hansen's J. With ``effects`` the constant is one of them."""
    return panel(df, [y, *exog, *endog, *instruments], unit, time, bandwidth, by_unit, effects).gmm(y, exog, endog, instruments)


def liml(df: DataFrame, y: str, exog: list[str], endog: list[str], instruments: list[str], unit: str = "od", time: str = "t", effects: list[str] | None = None) -> dict:
    """Limited-information maximum likelihood."""
    return panel(df, [y, *exog, *endog, *instruments], unit, time, effects=effects, errors=False).liml(y, exog, endog, instruments)


def rank_tests(df: DataFrame, exog: list[str], endog: list[str], instruments: list[str], unit: str = "od", time: str = "t", bandwidth: int = 0, effects: list[str] | None = None) -> dict:
    """Cragg-Donald, Anderson and the Kleibergen-Paap statistics of every rank."""
    return panel(df, [*exog, *endog, *instruments], unit, time, bandwidth, True, effects).rank_tests(exog, endog, instruments)


@dataclass(frozen=True)
class Specification:
    """One column of a table of estimates."""

    table: str
    column: int
    regressand: str
    exog: tuple[str, ...] = ()
    endog: tuple[str, ...] = ()
    instruments: tuple[str, ...] = ()
    estimator: str = "gmm"

    def used(self) -> tuple[str, ...]:
        return (self.regressand, *self.exog, *self.endog, *(self.instruments if self.estimator != "ols" else ()))


def estimated(panel: Panel, spec: Specification) -> list[tuple[str, str, float, float | None]]:
    """(kind, name, value, error) of one specification: its coefficients, and as ``statistic`` N, K, the
    fit, J, and the tests of the instruments."""
    if spec.estimator == "ols":
        found, tests = panel.ols(spec.regressand, [*spec.exog, *spec.endog]), {}
    else:
        found = getattr(panel, spec.estimator)(spec.regressand, [*spec.exog], [*spec.endog], [*spec.instruments])
        tests = panel.rank_tests([*spec.exog], [*spec.endog], [*spec.instruments]) if spec.endog else {}
    errors = found.get("se", [None] * len(found["b"]))
    rows = [("coefficient", n, float(b), None if e is None else float(e)) for n, b, e in zip(found["names"], found["b"], errors, strict=True)]
    rows += [("statistic", name, float(found[name]), None) for name in ("n", "k", "adj_r2", "rmse", "j", "j_df", "j_p", "kappa") if name in found]
    return rows + [("statistic", name, float(v), None) for name, v in tests.items() if name != "n"]


def tables(df: DataFrame, specs: list[Specification], grids: dict[str, list[str] | None], unit: str = "od", time: str = "t", bandwidth: int = BANDWIDTH) -> DataFrame:
    """``table, column, effects, kind, name, value, error``: all ``specs`` under each set of effects of
    ``grids``. Specifications with the same regressand share their rows, those that have every column
    that one of them uses, and two passes."""
    out: list[tuple] = []
    for name, effects in grids.items():
        for y in dict.fromkeys(s.regressand for s in specs):
            own = [s for s in specs if s.regressand == y]
            found = panel(df, [c for s in own for c in s.used()], unit, time, bandwidth, True, effects)
            out += [(s.table, s.column, name, *row) for s in own for row in estimated(found, s)]
    return df.sparkSession.createDataFrame(out, "table string, column int, effects string, kind string, name string, value double, error double")


def chi2_tail(x: float, df: int) -> float:
    """Chance that a chi-square of ``df`` exceeds ``x``, by the series and the continued fraction of
    the incomplete gamma function."""
    if df <= 0 or x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    scale = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= h / k
            total += term
        return max(0.0, 1 - total * scale)
    b, c, d = h + 1 - a, 1e300, 1 / (h + 1 - a)
    f = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        f *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return f * scale


def descriptives(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, deviation, least and greatest of each column, from one aggregate; nulls are left out."""
    stats = [f(F.col(c)).alias(f"{i}_{n}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))]
    entries = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"{i}_n").alias("n"), *[F.col(f"{i}_{n}").cast("double").alias(n) for n in ("mean", "sd", "min", "max")]) for i, c in enumerate(columns)])
    return df.agg(*stats).select(F.explode(entries).alias("e")).select("e.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every two columns over the rows that have both, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    both = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c_{k}") for k, (a, b) in enumerate(pairs)]
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c_{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return df.agg(*both).select(F.explode(entries).alias("e")).select("e.*")
