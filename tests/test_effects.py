import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import regress as R
from skyledger.operators.absorb import without_effects
from skyledger.plans import queries as Q


def test_effects_are_those_of_a_design_with_all_dummies(spark):
    rng = np.random.default_rng(4)
    units, months = 6, 10
    keep = [k for k in range(units * months) if k % 13]
    unit, t = np.array([k // months for k in keep]), np.array([k % months for k in keep])
    season = np.where(unit < 3, t % 3 + 1, 0)
    n = len(keep)
    z, u, w = rng.normal(size=(n, 2)), rng.normal(size=n), rng.normal(size=n) + unit
    x = z @ [1.0, -0.5] + 0.6 * u + 2 * unit - t + rng.normal(size=n)
    y = 1.5 * x - 0.7 * w + 5 * unit + 3 * np.sin(t) + season + u
    df = spark.createDataFrame([(f"u{unit[k]}", int(t[k]), int(season[k]), *map(float, (y[k], x[k], w[k], *z[k]))) for k in range(n)], "od string, t int, season int, y double, x double, w double, z1 double, z2 double")
    # the same with explicit columns, independent ones only
    dummies = {f"d{i}": c for i, c in enumerate([*[unit == v for v in range(1, units)], *[t == v for v in range(1, months)], *[season == v for v in (1, 2, 3)]])}
    kept, full = {}, np.ones((n, 1))
    for name, c in dummies.items():
        if np.linalg.matrix_rank(wide := np.column_stack([full, c])) == wide.shape[1]:
            kept[name], full = c, wide
    at = {(f"u{unit[k]}", int(t[k])): k for k in range(n)}
    rows = [(*r, *[float(c[at[r["od"], r["t"]]]) for c in kept.values()]) for r in df.collect()]
    long = spark.createDataFrame(rows, [*df.columns, *kept]).cache()
    effects, exog = ["od", "t", "season"], ["w", *kept]
    a, b = R.ols(df, "y", ["x", "w"], effects=effects), R.ols(long, "y", ["x", *exog])
    assert a["names"] == ["x", "w"] and a["k"] == b["k"] and np.allclose(a["b"], b["b"][1:3]) and np.allclose(a["se"], b["se"][1:3]) and a["rss"] == pytest.approx(b["rss"])
    a, b = R.liml(df, "y", ["w"], ["x"], ["z1", "z2"], effects=effects), R.liml(long, "y", exog, ["x"], ["z1", "z2"])
    assert np.allclose(a["b"], [b["b"][1], b["b"][-1]]) and a["kappa"] == pytest.approx(b["kappa"])
    a, b = R.gmm(df, "y", ["w"], ["x"], ["z1"], effects=effects), R.gmm(long, "y", exog, ["x"], ["z1"])
    assert np.allclose(a["b"], [b["b"][1], b["b"][-1]]) and np.allclose(a["se"], [b["se"][1], b["se"][-1]])
    a, b = R.rank_tests(df, ["w"], ["x"], ["z1", "z2"], bandwidth=2, effects=effects), R.rank_tests(long, exog, ["x"], ["z1", "z2"], bandwidth=2)
    assert all(a[k] == pytest.approx(b[k]) for k in b) and {"kp_lm_0", "kp_wald_0_p"} <= set(a)


def test_queries_with_effects(spark):
    sf = "/root/testdata/sf0.001"
    rows = Q._with_effects(spark, sf)
    assert set(Q.EFFECTS) <= set(rows.columns) and rows.where(F.greatest(*[c for c in Q.EFFECTS if c.startswith("season")]) == 0).isEmpty()
    assert [r["name"] for r in Q.ols_effects(spark, sf).collect()] == ["x"] and [r["name"] for r in Q.liml_panel(spark, sf).collect()] == ["w", "x"]


def plain_lagged(keys, m, bandwidth, by_unit):
    """Bartlett-weighted sums by loops over pairs of rows in order of unit and month."""
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    out = m.T @ m
    for a in range(len(order)):
        for b in range(a):
            (u1, t1), (u0, t0) = keys[order[a]], keys[order[b]]
            lag = t1 - t0 if by_unit and u1 == u0 else 0 if by_unit else a - b
            if 0 < lag <= bandwidth:
                g = np.outer(m[order[a]], m[order[b]])
                out = out + (1 - lag / (bandwidth + 1)) * (g + g.T)
    return out


@pytest.mark.parametrize("by_unit", [True, False])
@pytest.mark.parametrize("parts", [1, 5, 40])
def test_lagged_products_over_any_partitions(spark, by_unit, parts):
    rng = np.random.default_rng(2)
    keys = [(f"u{u}", t) for u, n in (("a", 40), ("b", 1), ("c", 2), ("d", 17)) for t in sorted(rng.choice(60, n, replace=False).tolist())]
    if by_unit:
        keys += [("ua", keys[3][1]), ("ud", keys[-1][1])]  # a month that stands twice counts with all its pairs
    m = rng.normal(size=(len(keys), 2))
    df = spark.createDataFrame([(*k, *map(float, v)) for k, v in zip(keys, m, strict=True)], "od string, t int, a double, b double").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = R.lagged_moments(df, "od", "t", ["a", "b"], 4, by_unit)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert np.allclose(got, plain_lagged(keys, m, 4, by_unit))


def made_panel(spark, n_units=12, months=20, seed=9):
    rng = np.random.default_rng(seed)
    n = n_units * months
    unit, t = np.repeat(range(n_units), months), np.tile(range(months), n_units)
    z, w, u = rng.normal(size=(n, 4)), rng.normal(size=n) + 3, rng.normal(size=n)
    x = z @ rng.normal(size=(4, 2)) + 0.5 * u[:, None] + 0.3 * w[:, None] + rng.normal(size=(n, 2))
    y = 1000 + x @ [1.0, -2.0] + 0.4 * w + u
    rows = [(f"u{unit[k]:02d}", int(t[k]), float(y[k]), float(w[k]), float(2 * w[k] - 1), *map(float, x[k]), *map(float, z[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "od string, t int, y double, w double, w2 double, x1 double, x2 double, z1 double, z2 double, z3 double, z4 double")
    return df, [(r[0], r[1]) for r in rows], y, w, x, z


def plain_rank(keys, y, z, w, bandwidth, q, restricted):
    """The statistic of rank ``q`` from the rows themselves."""
    c = np.column_stack([np.ones(len(w)), w])
    y, z = (a - c @ np.linalg.lstsq(c, a, rcond=None)[0] for a in (y, z))
    n, m, l = len(y), y.shape[1], z.shape[1]
    zz = z.T @ z / n
    pi = np.linalg.solve(zz, z.T @ y / n)
    v = y - z @ pi
    root = lambda a, p: (lambda e, t: (t * e**p) @ t.T)(*np.linalg.eigh(a))
    fz, gv = root(zz, 0.5), root(v.T @ v / n, -0.5)
    theta = fz @ pi @ gv
    left, sizes, right = np.linalg.svd(theta)
    if restricted:
        v = y - z @ (np.linalg.inv(fz) @ (left[:, :q] * sizes[:q]) @ right[:q] @ np.linalg.inv(gv))
    moments = np.column_stack([z[:, i] * v[:, j] for j in range(m) for i in range(l)])
    omega = plain_lagged(keys, moments, bandwidth, True) / n
    turn = np.kron(gv, fz) @ np.kron(np.eye(m), np.linalg.inv(zz))
    k = np.kron(right[q:].T, left[:, q:])
    lam = (left[:, q:].T @ theta @ right[q:].T).ravel(order="F")
    return n * lam @ np.linalg.solve(k.T @ turn @ omega @ turn.T @ k, lam)


def test_rank_statistics_of_every_rank(spark):
    df, keys, _, w, x, z = made_panel(spark)
    found = R.panel(df, ["w", "x1", "x2", "z1", "z2", "z3", "z4"], bandwidth=3)
    got = found.rank_tests(["w"], ["x1", "x2"], ["z1", "z2", "z3", "z4"])
    for q in (0, 1):
        assert got[f"kp_df_{q}"] == (4 - q) * (2 - q)
        assert got[f"kp_lm_{q}"] == pytest.approx(plain_rank(keys, x, z, w, 3, q, True)) and got[f"kp_wald_{q}"] == pytest.approx(plain_rank(keys, x, z, w, 3, q, False))
    # with equal and independent errors the statistics of the greatest rank are the classical ones
    plain = found.rank_tests(["w"], ["x1", "x2"], ["z1", "z2", "z3", "z4"], iid=True)
    assert plain["kp_wald_1"] == pytest.approx(plain["cragg_donald"]) and plain["kp_lm_1"] == pytest.approx(plain["anderson_lm"])
    assert plain["cragg_donald"] > plain["anderson_lm"] > 0


def test_columns_that_follow_from_others_go(spark):
    df, *_ = made_panel(spark)
    a, b = R.ols(df, "y", ["w", "x1"]), R.ols(df, "y", ["w", "w2", "x1"])
    assert a["names"] == b["names"] == ["1", "w", "x1"] and np.allclose(a["b"], b["b"]) and a["k"] == b["k"]
    a, b = (R.gmm(df, "y", exog, ["x1", "x2"], ["z1", "z2", "z3", *more]) for exog, more in ((["w"], []), (["w", "w2"], ["w2"])))
    assert np.allclose(a["b"], b["b"]) and a["j_df"] == b["j_df"] == 1 and a["j"] == pytest.approx(b["j"])
    flat = df.selectExpr("*", "7D AS always")
    assert R.ols(flat, "y", ["always", "x1"])["names"] == ["1", "x1"]
    with pytest.raises(ValueError, match="instruments"):
        R.gmm(df, "y", ["w"], ["x1", "x2"], ["z1", "w2"])


def test_two_step_gmm_is_the_plain_one(spark):
    df, keys, y, w, x, z = made_panel(spark)
    got = R.gmm(df, "y", ["w"], ["x1", "x2"], ["z1", "z2", "z3", "z4"], bandwidth=2)
    one = np.ones(len(y))
    xs, zs, n = np.column_stack([one, w, x]), np.column_stack([one, w, z]), len(y)
    step = lambda a: np.linalg.solve(xs.T @ zs @ a @ zs.T @ xs, xs.T @ zs @ a @ zs.T @ y)
    spread = lambda b: plain_lagged(keys, zs * (y - xs @ b)[:, None], 2, True) / n
    a = np.linalg.inv(spread(step(np.linalg.inv(zs.T @ zs / n))))
    b = step(a)
    g = zs.T @ (y - xs @ b) / n
    bread = np.linalg.inv(xs.T @ zs @ a @ zs.T @ xs / n / n)
    cov = bread @ (xs.T @ zs / n @ a @ spread(b) @ a @ zs.T @ xs / n) @ bread / (n - 4)
    assert np.allclose(got["b"], b) and np.allclose(got["se"], np.sqrt(np.diag(cov)), rtol=1e-6) and got["j"] == pytest.approx(n * g @ a @ g)
    assert got["rss"] == pytest.approx(((y - xs @ b) ** 2).sum())


def test_tables_are_their_single_fits(spark):
    df, *_ = made_panel(spark)
    specs = [R.Specification("a", 1, "y", ("w",), ("x1", "x2"), ("z1", "z2", "z3", "z4")), R.Specification("a", 2, "y", ("w",), ("x1",), (), "ols"), R.Specification("a", 3, "y", ("w",), ("x1", "x2"), ("z1", "z2", "z3"), "liml")]
    got = {(r["column"], r["effects"], r["name"]): r for r in R.tables(df, specs, {"none": None, "both": ["od", "t"]}).collect()}
    for name, effects in (("none", None), ("both", ["od", "t"])):
        fit = R.gmm(df, "y", ["w"], ["x1", "x2"], ["z1", "z2", "z3", "z4"], effects=effects)
        for n, b, se in zip(fit["names"], fit["b"], fit["se"], strict=True):
            assert got[1, name, n]["value"] == pytest.approx(b) and got[1, name, n]["error"] == pytest.approx(se)
        assert all(got[1, name, k]["value"] == pytest.approx(fit[k]) for k in ("n", "k", "j", "j_df", "j_p", "rmse", "adj_r2"))
        assert got[2, name, "x1"]["value"] == pytest.approx(R.ols(df, "y", ["w", "x1"], effects=effects)["b"][-1])
        assert got[3, name, "kappa"]["value"] == pytest.approx(R.liml(df, "y", ["w"], ["x1", "x2"], ["z1", "z2", "z3"], effects=effects)["kappa"])
        assert got[1, name, "kp_wald_f_1"]["value"] > 0


def test_many_levels_by_conjugate_gradients(spark):
    rng = np.random.default_rng(6)
    n = 4000
    a, b, c = rng.integers(0, 300, n), rng.integers(0, 120, n), rng.integers(0, 7, n)
    x = rng.normal(size=n) + a / 50 + np.sin(b)
    y = 2 * x + a / 10 + b**0.5 + c
    df = spark.createDataFrame([(int(a[k]), f"b{b[k]}", int(c[k]), float(x[k]), float(y[k])) for k in range(n)], "a int, b string, c int, x double, y double")
    few, many = (without_effects(df, ["x", "y"], ["b", "c", "a"], dense) for dense in (1500, 10))
    for left, taken in (few, many):
        rows = np.array([(r["x"], r["y"]) for r in left.collect()])
        assert np.allclose(rows[:, 1], 2 * rows[:, 0], atol=1e-7) and taken == 299 + 119 + 6
        assert max(abs(v) for r in left.groupBy("b").agg(F.avg("x"), F.avg("y")).collect() for v in r[1:]) < 1e-8


def test_a_hundred_thousand_units(spark):
    rows = spark.range(400_000).selectExpr("id % 100000 AS od", "cast(id div 100000 * 3 + id % 3 AS int) AS t", "cast(hash(id) % 1000 AS double) / 500 AS e")
    rows = rows.selectExpr("od", "t", "e + od % 17 + t AS x", "3 * (e + od % 17 + t) + od % 5 - t * t AS y")
    fit = R.panel(rows, ["y", "x"], effects=["od", "t"], errors=False)
    assert fit.own(["x"], fit.block(["x"], ["y"])[0] / fit.block(["x"], ["x"])[0], None, "y")[0][0] == pytest.approx(3) and fit.absorbed == 99_999 + 9  # three sets of units share no month
