"""Trees, their contributions, boosting and metrics against plain brute force on small data."""

import itertools
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerweave.operators import boosting, ml, trees


def expected_value(tree, node, x, known, of):
    """What the tree gives when only the ``known`` features of a row are."""
    if tree.feature[node] < 0:
        return tree.value[node][of]
    f, left, right = tree.feature[node], tree.left[node], tree.right[node]
    if f in known:
        return expected_value(tree, left if x[f] <= tree.cut[node] else right, x, known, of)
    return sum(tree.cover[n] / tree.cover[node] * expected_value(tree, n, x, known, of) for n in (left, right))


def shapley(tree, x, of):
    m = len(x)
    out = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for s in range(m):
            for known in itertools.combinations(others, s):
                w = math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m)
                out[i] += w * (expected_value(tree, 0, x, {*known, i}, of) - expected_value(tree, 0, x, set(known), of))
    return out


def random_tree(rng, features, depth, classes):
    nodes = {"feature": [], "cut": [], "left": [], "right": [], "cover": [], "value": []}

    def grow(level, cover):
        at = len(nodes["feature"])
        leaf = level == depth or rng.random() < 0.15
        for name, v in (("feature", -1 if leaf else rng.randrange(features)), ("cut", rng.uniform(-1, 1)), ("left", 0), ("right", 0), ("cover", cover), ("value", [rng.gauss(0, 1) for _ in range(classes)] if leaf else [0.0] * classes)):
            nodes[name].append(v)
        if not leaf:
            share = rng.uniform(0.1, 0.9)
            nodes["left"][at] = grow(level + 1, cover * share)
            nodes["right"][at] = grow(level + 1, cover * (1 - share))
        return at

    grow(0, 100.0)
    return trees.Tree(*(np.array(v) for v in nodes.values()))


@pytest.mark.parametrize("seed", range(6))
def test_contributions_equal_all_subsets(seed):
    rng = random.Random(seed)
    tree = random_tree(rng, 5, 6, 2)
    x = np.array([[rng.uniform(-1.5, 1.5) for _ in range(5)] for _ in range(7)])
    of = np.array([rng.randrange(2) for _ in range(7)])
    got = tree.contributions(x, of)
    for i in range(7):
        assert got[i] == pytest.approx(shapley(tree, x[i], of[i]), abs=1e-12)
    assert got.sum(axis=1) + tree.expected()[of] == pytest.approx(tree.value[tree.leaves(x), of], abs=1e-12)


def test_contributions_of_many_rows_are_those_of_one():
    rng, rows = random.Random(9), np.random.default_rng(9)
    tree = random_tree(rng, 5, 6, 3)
    tree.value[:, 1:] = 0.0  # as a boosted tree, which gives to one class
    x, of = rows.uniform(-1.5, 1.5, (200, 5)), rows.integers(0, 3, 200)
    got = tree.contributions(x, of)
    assert got == pytest.approx(np.vstack([tree.contributions(x[i : i + 1], of[i : i + 1]) for i in range(200)]), abs=1e-12)
    assert got[:5] == pytest.approx(np.array([shapley(tree, x[i], of[i]) for i in range(5)]), abs=1e-12)
    assert got.any() and not got[of > 0].any()


def test_queries_grow_all_iterations_of_the_models():
    from ledgerweave.plans import registry_models

    assert (registry_models.WIDE.iterations, registry_models.WIDE.max_leaves) == (300, 31) and (registry_models.DEEP.iterations, registry_models.DEEP.max_depth) == (500, 6)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        x, y, z = rng.gauss(0, 1), rng.randint(0, 5), rng.random()
        rows.append((k, (0 if x > 0.4 else 1 if y > 2 else 2) if rng.random() < 0.9 else rng.randrange(3), 1.0 + (k % 3) / 2, x, float(y), round(z, 1)))
    return spark.createDataFrame(rows, "id long, label int, weight double, x double, y double, z double").repartition(4).cache()


def test_forest_of_spark_ml(spark, points, tmp_path):
    columns = ["x", "y", "z"]
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(points)
    model = RandomForestClassifier(numTrees=5, maxDepth=5, minInstancesPerNode=2, weightCol="weight", seed=7).fit(data)
    found = trees.forest_trees(model, columns, str(tmp_path))
    want = {r.id: r.p for r in model.transform(data).select("id", vector_to_array("probability").alias("p")).collect()}
    rows = points.select("id", *columns).collect()
    margin = found.margin(np.array([r[1:] for r in rows]))
    assert margin == pytest.approx(np.array([want[r.id] for r in rows]), abs=1e-9)
    for r in trees.contributions(points, "id", found, k=3).collect():
        assert r.base + r.total == pytest.approx(r.margin, abs=1e-9)
        assert r.predicted == int(np.argmax(want[r.id]))
        assert [abs(t.contribution) for t in r.top] == sorted((abs(t.contribution) for t in r.top), reverse=True)
        assert sum(t.contribution for t in r.top) == pytest.approx(r.total, abs=1e-9)
    shares = found.importances()
    assert sum(s for _, s, _ in shares) == pytest.approx(1) and {c for c, _, _ in shares} == set(columns)


def boosted_by_hand(x, label, weight, edges, classes, s):
    """One process, plain loops: the same rule on the same cuts."""
    share = np.array([weight[label == k].sum() for k in range(classes)])
    scores = np.tile(np.log(share / share.sum()), (len(x), 1))
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)

    def gain(g, h):
        return g.sum() ** 2 / (h.sum() + s.ridge)

    for _ in range(s.iterations):
        p = boosting.softmax(scores)
        add = np.zeros_like(scores)
        for k in range(classes):
            g, h = (p[:, k] - (label == k)) * weight, p[:, k] * (1 - p[:, k]) * weight
            leaves, level = [], [np.arange(len(x))]
            depth = 0
            while level:
                found = []
                for n, rows in enumerate(level):
                    best = None
                    for f in range(x.shape[1]):
                        for b in range(len(edges[f])):
                            left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                            if min(len(left), len(right)) < s.least_rows or min(h[left].sum(), h[right].sum()) < s.least_hessian:
                                continue
                            v = gain(g[left], h[left]) + gain(g[right], h[right]) - gain(g[rows], h[rows])
                            if best is None or v > best[0] + 1e-9:
                                best = (v, left, right)
                    if best and best[0] > 1e-12 and depth < s.max_depth:
                        found.append((-best[0], n, best))
                total, split, nxt = len(leaves) + len(level), set(), []
                for _, n, (_, left, right) in sorted(found, key=lambda v: v[:2]):
                    if total >= s.max_leaves:
                        break
                    split.add(n)
                    nxt += [left, right]
                    total += 1
                leaves += [rows for n, rows in enumerate(level) if n not in split]
                if total >= s.max_leaves:
                    leaves, nxt = leaves + nxt, []
                level, depth = nxt, depth + 1
            for rows in leaves:
                add[rows, k] = -s.rate * g[rows].sum() / (h[rows].sum() + s.ridge)
        scores += add
    return scores


@pytest.mark.parametrize("settings", [
    boosting.Settings(iterations=3, rate=0.3, max_leaves=5, least_rows=10),
    boosting.Settings(iterations=2, rate=0.5, max_leaves=64, max_depth=3, least_rows=1, least_hessian=2.0),
])
def test_boosting_equals_one_process(points, settings):
    columns = ["x", "y", "z"]
    model = boosting.fit(points, "id", columns, 3, settings)
    edges = boosting.bin_edges(points, columns)
    rows = points.orderBy("id").collect()
    x, label, weight = np.array([[r.x, r.y, r.z] for r in rows]), np.array([r.label for r in rows]), np.array([r.weight for r in rows])
    assert model.margin(x) == pytest.approx(boosted_by_hand(x, label, weight, edges, 3, settings), abs=1e-6)
    assert len(model.trees) == 3 * settings.iterations
    leaves = [int((t.feature < 0).sum()) for t in model.trees]
    assert max(leaves) <= settings.max_leaves and min(leaves) > 1
    got = boosting.predict(points, model, ["id", "label"]).collect()
    assert np.mean([r.predicted == r.label for r in got]) > 0.8
    assert all(sum(r.probabilities) == pytest.approx(1) and r.confidence == max(r.probabilities) for r in got)


def test_sampling_of_rows_and_features(points):
    s = boosting.Settings(iterations=2, rate=0.3, max_leaves=8, least_rows=5, rows=0.6, features=0.67)
    model = boosting.fit(points, "id", ["x", "y", "z"], 3, s)
    assert all(len({f for f in t.feature.tolist() if f >= 0}) <= 2 for t in model.trees)
    assert all(150 < t.cover[0] < 330 for t in model.trees)
    again = boosting.fit(points.repartition(2), "id", ["x", "y", "z"], 3, s)
    x = np.random.default_rng(1).normal(size=(50, 3))
    assert model.margin(x) == pytest.approx(again.margin(x), abs=1e-6)


@pytest.mark.parametrize("settings", [boosting.Settings(iterations=4, rate=0.3, max_leaves=6, least_rows=10), boosting.Settings(iterations=4, rate=0.3, max_leaves=32, max_depth=3, least_rows=1, least_hessian=2.0, rows=0.8, features=0.6)])
def test_one_task_grows_the_trees_of_the_rounds(points, settings, monkeypatch):
    data = points.withColumns({"again": F.col("x") * 2, "same": F.col("y") + 1, "none": F.lit(0.0)})
    columns = ["none", "x", "again", "y", "same", "z"]
    one = boosting.fit(data, "id", columns, 3, settings)
    made = []

    class Watched(boosting.Rounds):
        def __init__(self, spark):
            super().__init__(spark)
            made.append(self)

    monkeypatch.setattr(boosting, "Rounds", Watched)
    monkeypatch.setattr(boosting, "ONE_TASK", 0)
    rounds = boosting.fit(data, "id", columns, 3, settings)
    assert [(a.feature.tolist(), a.cut.tolist(), a.left.tolist()) for a in one.trees] == [(b.feature.tolist(), b.cut.tolist(), b.left.tolist()) for b in rounds.trees]
    assert all(a.value == pytest.approx(b.value, abs=1e-9) and a.cover == pytest.approx(b.cover) for a, b in zip(one.trees, rounds.trees, strict=True))
    assert {f for t in one.trees for f in t.feature.tolist()} >= {-1, 1, 3}
    assert [p.name for p in Path(made[0].path.removeprefix("file:")).iterdir() if not p.name.startswith(".")] == ["2"]  # the scores of earlier rounds are gone


def test_of_equal_features_the_first_allowed_is_counted():
    same = [(0, 0), (1, 1), (1, 1), (1, 3), (0, 0)]
    assert boosting.counted_features(same, np.ones(5, bool)).tolist() == [True, True, False, True, False]
    assert boosting.counted_features(same, np.array([False, False, True, True, True])).tolist() == [False, False, True, True, True]


def test_imputation_learns_from_train_alone(spark):
    df = spark.createDataFrame([(1, 1.0, None, None), (2, 3.0, 5.0, None), (3, float("nan"), 7.0, None), (4, 100.0, None, 2.0)], "id int, a double, b double, c double")
    train = df.filter("id < 4")
    filled, names = ml.imputed(df, train, ["a", "b", "c"])
    assert names == ["a", "b", "c", "a_missing", "b_missing", "c_missing"]
    got = {r.id: tuple(r[n] for n in names) for r in filled.collect()}
    assert got[3] == (1.0, 7.0, 0.0, 1.0, 0.0, 1.0) and got[4] == (100.0, 5.0, 2.0, 0.0, 1.0, 0.0)


def test_metrics_by_window(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        p = [rng.choice([1, 2, 3, 4]) for _ in range(3)]
        p = [v / sum(p) for v in p]
        rows.append((rng.choice(["early", "late"]), rng.randrange(3), int(np.argmax(p)), p))
    df = spark.createDataFrame(rows, "w string, label int, predicted int, probabilities array<double>")
    areas = {(r.w, r["class"]): r for r in ml.ranked_areas(df, "w", 3).collect()}
    got = {r.w: r for r in ml.metrics_by(df, "w", 3).collect()}
    for w in ("early", "late"):
        own = [r for r in rows if r[0] == w]
        rocs, prs, f1 = [], [], []
        for c in range(3):
            pos, neg = [r[3][c] for r in own if r[1] == c], [r[3][c] for r in own if r[1] != c]
            rocs.append(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
            prs.append(sum(sum(x == s for x in pos) / len(pos) * sum(x >= s for x in pos) / sum(x >= s for x in pos + neg) for s in set(pos)))
            assert areas[w, c].roc_auc == pytest.approx(rocs[-1]) and areas[w, c].pr_auc == pytest.approx(prs[-1])
            hit = sum(r[1] == c == r[2] for r in own)
            f1.append(2 * hit / (sum(r[1] == c for r in own) + sum(r[2] == c for r in own)))
        assert got[w].roc_auc == pytest.approx(np.mean(rocs)) and got[w].pr_auc == pytest.approx(np.mean(prs)) and got[w].macro_f1 == pytest.approx(np.mean(f1))
        assert got[w].accuracy == pytest.approx(np.mean([r[1] == r[2] for r in own])) and got[w].n == len(own)
        assert got[w].log_loss == pytest.approx(np.mean([-math.log(r[3][r[1]]) for r in own]))
        assert got[w].brier == pytest.approx(np.mean([sum((p - (i == r[1])) ** 2 for i, p in enumerate(r[3])) for r in own]))
    deltas = {r.metric: r.delta for r in ml.window_deltas(ml.metrics_by(df, "w", 3), "w", "early", "late").collect()}
    assert deltas["accuracy"] == pytest.approx(got["late"].accuracy - got["early"].accuracy) and set(deltas) == set(ml.METRICS)


def test_areas_without_one_kind(spark):
    df = spark.createDataFrame([("a", 0, [0.5, 0.5]), ("a", 0, [0.4, 0.6])], "w string, label int, probabilities array<double>")
    assert [(r["class"], r.roc_auc, r.pr_auc) for r in ml.ranked_areas(df, "w", 2).orderBy("class").collect()] == [(0, None, 1.0), (1, None, None)]
    assert ml.ranked_areas(df.limit(0).withColumn("w", F.lit("a")), "w", 2).collect() == []


def test_isolation_scores_are_those_of_rows_that_walk_alone():
    rng = np.random.default_rng(4)

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree

    for known in (rng.normal(size=(500, 3)), np.round(rng.normal(size=(40, 3))), np.zeros((9, 3)), np.zeros((0, 3))):
        forest = ml.IsolationForest(20).fit(known)
        rows = np.vstack([rng.normal(size=(50, 3)), known[:5], [[np.inf, -np.inf, 0.0]]])
        want = [2 ** (-np.mean([walk(t, r) for t in forest.trees]) / max(forest.norm, 1e-9)) for r in rows]
        assert forest.score(rows).tolist() == pytest.approx(want, rel=1e-12)
        assert len(forest.score(rows[:0])) == 0


def test_model_data_read_the_transactions_once(spark, sf_dir, monkeypatch):
    from ledgerweave.plans import registry_more

    read, plain = [], registry_more.d.canonical
    monkeypatch.setattr(registry_more.d, "canonical", lambda *a: read.append(1) or plain(*a))
    data = registry_more.dataset(spark, sf_dir)
    assert len(read) == 1 and data.columns[-2:] == ["label", "part"]
    assert data.count() == data.select("txid").distinct().count() == plain(spark, sf_dir).count()
