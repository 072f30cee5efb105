import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import boost
from skyledger.operators import evaluate as E
from skyledger.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = [(str(k), 1995 + k % 5, x if k % 7 else None, rng.random(), rng.choice("abcd"), int(x > 0.5), int(x > 0.8) if k % 11 else None) for k in range(3000) for x in [rng.random()]]
    return spark.createDataFrame(made, "leg_id string, year int, x double, noise double, kind string, y int, z int").cache()


def test_every_fold_target_and_horizon(spark, rows):
    folds = Q.all_folds(rows)
    assert [(f.train, f.valid, f.test) for f in folds] == [((1995,), 1996, (1997,)), ((1995, 1996), 1997, (1998,)), ((1995, 1996, 1997), 1998, (1999,))]
    scored = E.rolling_scores(rows, folds, ["y", "z"], {"a": ["noise", "kind"], "b": ["noise", "kind", "x"]}, ["kind"], boost.Settings(trees=3, depth=2, least_weight=5.0))
    got = E.rolling_metrics(scored)
    found = {(r["fold"], r["target"], r["horizon"]): r for r in got.collect()}
    tested = {(f"rolling_{r['year']}", t): r[t] for r in rows.groupBy("year").agg(F.count("y").alias("y"), F.count("z").alias("z")).collect() for t in "yz"}
    assert len(found) == 12 and all(r["n"] == tested[k[:2]] for k, r in found.items())
    assert all(r["auc"] > 0.9 if k[2] == "b" else r["auc"] < 0.7 for k, r in found.items())
    summary = {(r["target"], r["horizon"]): r for r in E.fold_summary(got).collect()}
    assert len(summary) == 4 and all(r["folds"] == 3 and r["min_auc"] <= r["median_auc"] <= r["max_auc"] for r in summary.values())
    assert summary["y", "b"]["min_auc"] == min(r["auc"] for k, r in found.items() if k[1:] == ("y", "b"))


def plain_boost(parts, category, base, settings):
    """Boosted trees by loops over rows, nodes and cuts; ``parts``: training and validation bins and labels."""
    (x, y), (vx, vy) = parts
    margin, other = np.full(x.shape[1], np.float32(base), float), np.full(vx.shape[1], np.float32(base), float)
    trees, losses = [], []

    def grow(rows, g, h, depth):
        G, H = g[rows].sum(), h[rows].sum()
        best = None
        if depth < settings.depth:
            for f in range(len(x)):
                bins = sorted(set(x[f, rows]))
                sums = {b: (g[rows][x[f, rows] == b].sum(), h[rows][x[f, rows] == b].sum()) for b in bins}
                if category[f]:
                    order = sorted((b for b in bins if sums[b][1] > 0), key=lambda b: (sums[b][0] / (sums[b][1] + settings.l2), b))
                    cuts = [order[: k + 1] for k in range(len(order))]
                else:
                    order = [b for b in bins if b]
                    cuts = [c for k in range(len(order)) for c in (order[: k + 1], [*order[: k + 1], 0])]
                for left in cuts:
                    lg, lh = sum(sums.get(b, (0, 0))[0] for b in left), sum(sums.get(b, (0, 0))[1] for b in left)
                    if lh >= settings.least_weight and H - lh >= settings.least_weight:
                        gain = lg**2 / (lh + settings.l2) + (G - lg) ** 2 / (H - lh + settings.l2) - G**2 / (H + settings.l2)
                        if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-12)):
                            best = (gain, f, set(left))
        value = -settings.rate * G / (H + settings.l2)
        if best is None:
            return value
        _, f, left = best
        goes = np.isin(x[f, rows], list(left))
        if not category[f]:  # bins between two that occur go with the lower one
            top = max([b for b in left if b], default=0)
            goes = np.where(x[f, rows] == 0, 0 in left, x[f, rows] <= top)
            left = set(range(1, top + 1)) | (left & {0})
        return f, left, grow(rows[goes], g, h, depth + 1), grow(rows[~goes], g, h, depth + 1)

    def value(tree, column):
        while isinstance(tree, tuple):
            tree = tree[2] if column[tree[0]] in tree[1] else tree[3]
        return tree

    for n in range(settings.trees + 1):
        losses.append((np.logaddexp(0, other) - vy * other).mean())
        if n == settings.trees or n - int(np.argmin(losses)) >= settings.patience:
            break
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(x.shape[1]), np.round((p - y) * boost.UNIT) / boost.UNIT, np.round(p * (1 - p) * boost.UNIT) / boost.UNIT, 0)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        margin += [value(tree, c) for c in x.T]
        other += [value(tree, c) for c in vx.T]
        if (n + 1) % settings.stored_every == 0:
            margin, other = margin.astype(np.float32).astype(float), other.astype(np.float32).astype(float)
    return [lambda column, t=t: value(t, column) for t in trees[: int(np.argmin(losses))]]


def unpacked(blocks, fold, role, label):
    """The bins and labels of a part of a fold, and the ids, from the written blocks."""
    xs, ys, ids = [], [], []
    for r in blocks.rows.where((F.col("fold") == fold) & (F.col("role") == role)).collect():
        y = np.frombuffer(r["y"], np.uint8).reshape(-1, r["n"])[label]
        xs.append(np.frombuffer(r["x"], np.uint8).reshape(-1, r["n"])[:, y != 255])
        ys.append(y[y != 255].astype(float))
        ids += [i for i, known in zip(r["ids"], y != 255, strict=True) if known]
    return np.concatenate(xs, axis=1), np.concatenate(ys), ids


@pytest.mark.parametrize("made", [True, False])
def test_trees_are_those_of_plain_loops(spark, rows, made):
    if made:
        table, lists, targets, category = rows, {"a": ["noise", "kind", "x"]}, ["y", "z"], ["kind"]
    else:  # the real features, with all their nulls and categories
        table, both = Q._model_rows(spark, SF)
        lists, targets, category = {"H-1": both["H-1"]}, ["late15_arr"], Q.CATEGORICAL
    settings = boost.Settings(trees=4, depth=3, least_weight=8.0, stored_every=2, bins=16)
    folds = Q.all_folds(table)[-1:]
    blocks = boost.binned(table, folds, targets, lists, category, settings)
    trees = boost.boost(blocks, settings)
    scored = {(r["target"], r["id"]): r["p"] for r in boost.scores(blocks, trees).where("y is not null").collect()}
    for k, target in enumerate(targets):
        found = plain_boost([unpacked(blocks, 0, role, k)[:2] for role in (boost.TRAIN, boost.VALID)], [c in category for c in blocks.features], blocks.base[k], settings)
        x, _, ids = unpacked(blocks, 0, boost.TEST, k)
        margins = [np.float32(blocks.base[k]) + sum(t(c) for t in found) for c in x.T]
        assert found and len(found) == len(trees[k])
        assert np.allclose([scored[target, i] for i in ids], 1 / (1 + np.exp(-np.array(margins))), atol=1e-5)


def test_nulls_go_where_they_gain_and_unseen_values_somewhere(spark):
    made = [(str(k), 1995 + k % 3, None if k % 4 == 0 else float(k % 4), "ab"[k % 2] if k % 3 < 2 else "new", int(k % 4 in (0, 3))) for k in range(1200)]
    table = spark.createDataFrame(made, "leg_id string, year int, v double, kind string, y int")
    settings = boost.Settings(trees=6, depth=2, rate=0.5, least_weight=1.0)
    blocks = boost.binned(table, Q.all_folds(table), ["y"], {"a": ["v", "kind"]}, ["kind"], settings)
    trees = boost.boost(blocks, settings)
    assert trees[0][0].feature[0] == 0 and trees[0][0].left[0][0] & 1 == 0  # one cut tells all: nulls go with 3, to the right
    assert E.rolling_metrics(boost.scores(blocks, trees)).first()["auc"] == 1.0


def test_a_target_of_one_class_or_without_rows(spark, rows):
    table = rows.withColumns({"y": F.lit(1), "z": F.lit(None).cast("int")})
    got = E.rolling_metrics(E.rolling_scores(table, Q.all_folds(table)[-1:], ["y", "z"], {"a": ["x", "kind"]}, ["kind"], boost.Settings(trees=2))).collect()
    assert [(r["target"], r["auc"], r["base_rate"]) for r in got] == [("y", None, 1.0)]


def test_importance_permutes_each_column(spark, rows):
    settings = boost.Settings(trees=5, depth=2, least_weight=5.0)
    blocks = boost.binned(rows, Q.all_folds(rows)[-1:], ["y"], {"a": ["kind", "x", "noise"]}, ["kind"], settings)
    trees = boost.boost(blocks, settings)
    got = {r["feature"]: r for r in E.permutation_importance(blocks, trees).collect()}
    # half of the pairs are in the wrong order once the one column that tells is dealt anew
    assert set(got) == {"kind", "x", "noise"} and got["x"]["auc_drop"] > 0.35 and abs(got["kind"]["auc_drop"]) < 0.05 and got["x"]["auc_drop_sd"] > 0
    gains = [(r["feature"], r["gain"]) for r in E.gain_importance(spark, blocks, trees).collect()]
    assert gains[0][0] == "x" and [g for _, g in gains] == sorted((g for _, g in gains), reverse=True) and len(gains) == 3
    # the counts of a permuted column are those of all test rows
    counts = boost.permuted_counts(blocks, trees, 2, 0).groupBy("feature", "repeat").agg(F.sum("pos").alias("pos"), F.sum(F.col("pos") + F.col("neg")).alias("n")).collect()
    assert {(r["n"], r["pos"]) for r in counts} == {(600, rows.where("year = 1999").agg(F.sum("y")).first()[0])}


def test_areas_of_permuted_columns_are_those_of_their_counts_without_a_row_for_each(spark, rows, monkeypatch):
    monkeypatch.setattr(boost, "CHUNK_ROWS", 150)
    settings = boost.Settings(trees=5, depth=3, least_weight=5.0)
    table = rows.withColumn("z", F.when(F.rand(2) < 0.9, F.col("z")))
    blocks = boost.binned(table, Q.all_folds(table)[-1:], ["y", "z"], {"a": ["kind", "noise"], "b": ["kind", "x", "noise"]}, ["kind"], settings)
    trees = boost.boost(blocks, settings)
    keys = ["target", "horizon", "feature", "repeat"]
    counts = boost.permuted_counts(blocks, trees, 2, 0)
    want = {tuple(r[k] for k in keys): r["auc"] for r in E.metrics_of_counts(counts.groupBy(*keys, "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), keys).collect()}
    got = {tuple(r[k] for k in keys): r["auc"] for r in boost.permuted_areas(blocks, trees, 2, 0).collect()}
    assert set(got) == set(want) and len(got) > 10 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # what is shuffled has a row for each bin of each chunk, and four bytes for each test row
    packed = boost.permuted_margins(blocks, trees, 2, 0)
    assert {r["n"] for r in packed.where("model < 2").groupBy("model", "feature", "repeat").agg((F.sum(F.length("rows")) / 4).alias("n")).collect()} == {600}


def test_walks_and_sums_are_those_of_every_row_by_itself():
    rng = np.random.default_rng(1)
    tree, x = boost.Tree.empty(4), rng.integers(0, 256, (6, 500)).astype(np.uint8)
    for node in (0, 1, 2, 4, 5, 9, 11):  # nodes without a split among them
        tree.feature[node], tree.left[node] = rng.integers(0, 6), rng.integers(0, 256, 32)
    tree.value[:] = rng.normal(size=len(tree.value))

    def walk(column, levels):
        at = 0
        for _ in range(levels):
            if tree.feature[at] >= 0:
                b = int(column[tree.feature[at]])
                at = 2 * at + 2 - (tree.left[at, b >> 3] >> (b & 7) & 1)
        return at

    for levels in range(5):
        assert tree.nodes(x, levels).tolist() == [walk(c, levels) for c in x.T]
    some = np.array([3, 77, 499])
    assert np.array_equal(boost.Walk(tree).values(x, some), tree.values(x)[some])
    asked = boost.Walk(tree).asked(x)
    for f in range(6):  # rows that are not asked for a column keep their value without it
        other = x.copy()
        other[f] = rng.permutation(x[f])
        free = ~(asked == f).any(axis=0)
        assert np.array_equal(tree.values(other)[free], tree.values(x)[free])


def test_sums_hold_the_bins_of_training_rows_only(spark, rows):
    """A flag takes three bins of a node's sums and not those of the widest column; no training row is beyond."""
    table = rows.withColumns({"flag": F.pmod(F.xxhash64("leg_id"), F.lit(2)), "many": F.pmod(F.xxhash64("leg_id"), F.lit(400)).cast("string")})
    blocks = boost.binned(table, Q.all_folds(table), ["y"], {"a": ["flag", "kind", "many", "noise"]}, ["kind", "many"], boost.Settings(bins=16))
    assert blocks.widths.shape == (len(blocks.folds), 4) and blocks.widths[:, [0, 1]].max() < 10 < blocks.widths[:, 3].max() == 17
    assert blocks.widths[:, 2].max() == blocks.n_bins > 200
    for r in blocks.rows.where(F.col("role") == boost.TRAIN).collect():
        x = np.frombuffer(r["x"], np.uint8).reshape(4, -1)
        assert (x.max(axis=1) < blocks.widths[r["fold"]]).all()
    sums = np.arange(2 * 5.0).reshape(2, 5)
    assert boost.whole_bins(sums, np.array([2, 3]), 4).tolist() == [[[0, 1, 0, 0], [5, 6, 0, 0]], [[2, 3, 4, 0], [7, 8, 9, 0]]]


@pytest.mark.parametrize("held", [64 << 20, 0])
def test_rows_of_one_of_two_siblings_are_added_up(spark, rows, monkeypatch, held):
    """The other one's sums are what they leave of the parent's; with no room for these both are added up, to the same trees."""
    settings = boost.Settings(trees=2, depth=3, least_weight=5.0)
    blocks = boost.binned(rows, Q.all_folds(rows), ["y", "z"], {"a": ["kind", "x", "noise"]}, ["kind"], settings)
    whole = boost.boost(blocks, settings)
    passes, level = [], boost._level

    def seen(*args):
        found = level(*args)
        passes.append((args[6], {(r["model"], r["node"]) for r in found if r["node"] >= 0}))
        return found

    monkeypatch.setattr(boost, "_level", seen)
    monkeypatch.setattr(boost, "HELD_BYTES", held)
    again = boost.boost(blocks, settings)
    assert all(np.array_equal(getattr(a, c), getattr(b, c)) for m in whole for a, b in zip(whole[m], again[m], strict=True) for c in ("feature", "left", "value", "gain"))
    added = [({(m, node) for m, nodes in open_.items() for node in nodes}, found) for open_, found in passes if any(node for nodes in open_.values() for node in nodes)]
    assert added and all(open_ <= found for open_, found in added)
    assert all(len(found) == (2 * len(open_) if held else len(open_)) for open_, found in added)


def test_bundles_and_packed_sums_are_those_of_every_row_by_itself():
    rng = np.random.default_rng(2)
    widths, category = np.array([65, 3, 4, 5, 7, 256, 3]), np.array([False, False, True, True, False, True, False])
    joint = boost.Joint(widths, category, 256, [0, 0, 0, 0, 0, 0, 1])
    assert sorted(f for b in joint.bundles for f in b) == list(range(7)) and len(joint.bundles) < 5 and [6] in joint.bundles
    assert all(joint.size(b) <= 256 for b in joint.bundles)
    x = np.stack([rng.integers(0, w, 20_000) for w in widths]).astype(np.uint8)
    columns, slot = np.array([0, 2, 3, 5]), rng.integers(0, 2, 20_000)
    g, h = np.where(rng.random(20_000) < 0.9, boost.UNIT, -boost.UNIT), np.full(20_000, boost.UNIT / 4)  # the greatest there are
    sums = boost.Sums(2, joint, columns)
    for rows in np.array_split(rng.permutation(20_000), 3):
        sums.add(joint.cells(x), rows, slot[rows], g[rows], h[rows])
    want = [[np.concatenate([np.bincount(x[f][slot == k], w[slot == k], widths[f]) for f in columns]) for w in (g, h)] for k in (0, 1)]
    assert np.array_equal(sums.done(), np.array(want))
    # a tree over cells is the tree over bins, also for categories that no training row has
    tree = boost.Tree.empty(4)
    for node in (0, 1, 2, 4, 5, 9, 11):
        tree.feature[node], tree.left[node] = rng.integers(0, 7), rng.integers(0, 256, 32)
    tree.value[:] = rng.normal(size=len(tree.value))
    x[2:4] = np.where(rng.random((2, 20_000)) < 0.1, 255, x[2:4])
    assert np.array_equal(boost.Walk(joint.tree(tree)).values(joint.cells(x)), tree.values(x))


@pytest.mark.parametrize("columns", [["kind", "x", "noise", "many"], ["x", "noise"], ["kind", "many"]])
def test_rows_are_binned_out_of_three_arrays(spark, rows, monkeypatch, columns):
    """Spark hands on an array of each kind and not a column for each feature; values are counted in the years of training alone."""
    table = rows.withColumns({"many": F.when(F.col("leg_id") % 7 > 0, F.col("leg_id") % 9).cast("string"), "noise": F.when(F.col("noise") > 0.1, F.col("noise")).otherwise(float("nan"))})
    seen, borders = [], boost._borders
    monkeypatch.setattr(boost, "_borders", lambda typed, *args: seen.append(typed) or borders(typed, *args))
    folds = Q.all_folds(table)[:2]
    blocks = boost.binned(table, folds, ["y", "z"], {"a": columns}, ["kind", "many"], boost.Settings(bins=8))
    assert set(seen[0].columns) == {"_id", "_h", "year", "_v", "_s", "_y"}
    assert {r["year"] for r in boost._trained(seen[0], folds).select("year").distinct().collect()} == {1995, 1996}
    made = {r["leg_id"]: r for r in table.collect()}
    ranks = [{c: {v: k + 1 for k, v in enumerate(sorted({r[c] for r in made.values() if r[c]}, key=lambda v: (-sum(r[c] == v for r in made.values() if r["year"] in f.train), v)))} for c in ("kind", "many")} for f in folds]
    for b in blocks.rows.collect():
        x, y = (np.frombuffer(b[c], np.uint8).reshape(-1, b["n"]) for c in ("x", "y"))
        for i, r in enumerate(made[leg] for leg in b["ids"]):
            for j, c in enumerate(columns):
                if c in ("kind", "many"):
                    want = ranks[b["fold"]][c][r[c]] if r[c] else 0
                else:
                    want = 0 if r[c] is None or np.isnan(r[c]) else 1 + int(np.searchsorted(blocks.borders[b["fold"]][c], r[c]))
                assert x[j, i] == want
            assert (y[0, i], y[1, i]) == (r["y"], 255 if r["z"] is None else r["z"])


def test_the_queries_run_all_folds_targets_and_columns(spark):
    got = Q.gbt_rolling(spark, SF).collect()
    years = sorted({r["fold"] for r in got})
    assert years == [f"rolling_{y}" for y in range(1997, 2002)] and len(got) == len(years) * 4 * 2
    assert {r["target"] for r in got} == {"late15_arr", "late30_arr", "late15_dep", "cancelled"}
    assert Q.fold_summary(spark, SF).count() == 8
    found = Q.permutation_importance(spark, SF)
    assert found.where("horizon = 'D-1'").count() == 46 and found.where("horizon = 'H-1'").count() == 49
    assert Q.gain_importance(spark, SF).count() == 95
