"""Shapley values against all subsets, boosted trees against forests and loops, models as they are frozen."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import boosting, model
from tracelake.operators.trees import Tree, shapley


def random_tree(rng, features, depth, outputs):
    rows = []

    def grow(d, size):
        at = len(rows)
        rows.append([-1, 0.0, -1, -1, size, rng.normal(size=outputs)])
        if d and rng.random() < 0.85:
            cut = rng.integers(1, 10) / 10
            rows[at][:2] = int(rng.integers(features)), float(rng.normal())
            rows[at][2] = grow(d - 1, size * cut)
            rows[at][3] = grow(d - 1, size * (1 - cut))
        return at

    grow(depth, 100.0)
    return Tree(*[np.array(c) for c in zip(*rows)])


def known(tree, x, subset, node=0):
    """What the tree expects of a row of which only a subset of features is known."""
    if tree.feature[node] < 0:
        return tree.value[node]
    a, b = tree.left[node], tree.right[node]
    if tree.feature[node] in subset:
        return known(tree, x, subset, a if x[tree.feature[node]] <= tree.threshold[node] else b)
    return (tree.size[a] * known(tree, x, subset, a) + tree.size[b] * known(tree, x, subset, b)) / tree.size[node]


def by_enumeration(tree, x):
    m = len(x)
    out = np.zeros((m, tree.value.shape[1]))
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for k in range(m):
            for s in combinations(others, k):
                out[i] += factorial(k) * factorial(m - k - 1) / factorial(m) * (known(tree, x, {*s, i}) - known(tree, x, {*s}))
    return out


@pytest.mark.parametrize("features, depth", [(6, 1), (6, 4), (6, 7), (2, 6), (1, 5)])
def test_values_are_those_of_all_subsets(features, depth):
    rng = np.random.default_rng(features * 10 + depth)
    for _ in range(4):
        tree, x = random_tree(rng, features, depth, 2), rng.normal(size=(5, features))
        found = shapley(tree, x)
        assert np.abs(found - np.array([by_enumeration(tree, r) for r in x])).max() < 1e-9
        assert np.abs(found.sum(1) + tree.expected() - tree.value[tree.leaves(x)]).max() < 1e-9


def test_a_leaf_alone_and_no_rows():
    leaf = Tree(np.array([-1]), np.zeros(1), np.array([-1]), np.array([-1]), np.ones(1), np.ones((1, 1)))
    assert not shapley(leaf, np.zeros((3, 2))).any() and shapley(leaf, np.zeros((0, 2))).shape == (0, 2, 1)


def spirals(spark, n=900):
    """Three classes that no single split and no sum of single splits tells apart, and two features that say nothing."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        c, r = i % 3, rng.uniform(0.2, 1)
        angle = 2 * np.pi * (c / 3 + r) + rng.normal(0, 0.15)
        rows.append((i, f"class{c}", float(r * np.cos(angle)), float(r * np.sin(angle)), *map(float, rng.normal(size=2))))
    return spark.createDataFrame(rows, "id long, category string, x double, y double, u double, v double")


FEATURES = ["x", "y", "u", "v"]


@pytest.fixture(scope="module")
def boosted(spark):
    return model.train_boosted(spirals(spark), FEATURES, "category", "id", rounds=12, depth=4, bins=32)


def test_boosted_trees_beat_a_forest(spark, boosted):
    forest = model.train(spirals(spark), FEATURES, "category", "id", trees=12, depth=4)
    assert boosted.metrics["f1_macro"] > forest.metrics["f1_macro"] + 0.02 and boosted.metrics["f1_macro"] > 0.85


def test_rounds_lower_the_loss(spark, boosted):
    rows = spirals(spark).collect()
    x, y = np.array([r[2:] for r in rows]), np.array([int(r.category[-1]) for r in rows])
    losses = []
    for n in (1, 4, 8, 12):
        p = boosting.Boosted(FEATURES, boosted.classes, boosted.model.start, boosted.model.rounds[:n]).probabilities(x)
        losses.append(-np.log(p[np.arange(len(y)), y]).mean())
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0] / 2


def test_margins_are_kept_over_rounds(spark, boosted, monkeypatch):
    """The same trees whether margins are written after every round or never."""
    monkeypatch.setattr(boosting, "KEEP", 1)
    again = model.train_boosted(spirals(spark), FEATURES, "category", "id", rounds=3, depth=4, bins=32).model
    for one, two in zip(again.rounds, boosted.model.rounds):
        for a, b in zip(one, two):
            assert (a.feature == b.feature).all() and np.allclose(a.threshold, b.threshold) and np.allclose(a.value, b.value)


def test_a_round_is_that_of_a_loop(spark):
    """One split per class, found by trying all of them."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, (200, 3)).astype(float), rng.integers(0, 2, 200)
    x[:, 1] += 2 * y
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)], "a double, b double, c double, y int")
    found = boosting.fit(df, ["a", "b", "c"], "y", ["0", "1"], rounds=1, depth=1, rate=1.0)
    p = np.array([(y == 0).mean(), (y == 1).mean()])
    for c in (0, 1):
        g, h = p[c] - (y == c), np.full(200, 2 * p[c] * (1 - p[c]))
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        gains = {(f, t): score(x[:, f] <= t) + score(x[:, f] > t) for f in range(3) for t in np.unique(x[:, f])[:-1]}
        tree = found.rounds[0][c]
        assert gains[int(tree.feature[0]), float(tree.threshold[0])] == pytest.approx(max(gains.values()))
        low = x[:, tree.feature[0]] <= tree.threshold[0]
        assert tree.value[1, 0] == pytest.approx(-g[low].sum() / (h[low].sum() + 1)) and tree.size[1] == low.sum()


def test_frozen_and_explained(spark, boosted, tmp_path):
    manifest = model.certify(spark, boosted, str(tmp_path), "v1")
    assert manifest["kind"] == "boosted" and manifest["class_names"] == ["class0", "class1", "class2"]
    frozen = model.FrozenClassifier(spark, str(tmp_path), "v1")
    rows = spirals(spark, 60)
    found = frozen.explain(frozen.predict(rows), 4).orderBy("id").collect()
    x = np.array([[r[f] for f in FEATURES] for r in found])
    p, margins, base = boosted.model.probabilities(x), boosted.model.margins(x), boosted.model.base()
    for i, r in enumerate(found):
        c = int(np.argmax(p[i]))
        assert r.prediction.attack_cat == f"class{c}" and r.prediction.probability == pytest.approx(p[i, c])
        assert sum(r.prediction.class_probabilities.values()) == pytest.approx(1)
        assert sum(f.shap_value for f in r.top_features) + base[c] == pytest.approx(margins[i, c])
    one = boosted.model.contributions(x[:1])[0]
    summed = sum(np.stack([by_enumeration(t, x[0])[:, 0] for t in trees], 1) for trees in boosted.model.rounds)
    assert np.abs(one - summed).max() < 1e-9
    odd = frozen.predict(spark.createDataFrame([(1, None, float("nan"), 0.0, 0.0)], "id long, x double, y double, u double, v double")).first()
    assert 0 < odd.prediction.probability <= 1
    spark.createDataFrame(boosted.model.table()[1:], boosting.NODES).write.mode("overwrite").parquet(f"{tmp_path}/model_v1")
    with pytest.raises(model.ModelIntegrityError):
        model.FrozenClassifier(spark, str(tmp_path), "v1")


def test_forest_contributions_are_those_of_all_subsets(spark):
    trained = model.train(spirals(spark), FEATURES, "category", "id", trees=4, depth=5)
    forest = model.Forest.of(trained.model)
    x = np.array([r[2:] for r in spirals(spark, 3).collect()])
    want = [sum(by_enumeration(t, r) for t in forest.trees) / 4 for r in x]
    assert np.abs(forest.contributions(x) - np.array(want)).max() < 1e-9


def test_boosted_languages_read_the_texts_once(spark):
    """What is scored and explained comes from the stored features, not from the texts again."""
    from tracelake.plans import catalog

    plan = catalog.m6_m10_boosted_languages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan
