"""Forests, boosting and logistic regression: both plans grow the same trees, results against plain formulas, save and load."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from colonnade.functions import growth
from colonnade.functions.growth import Cells, Rule
from colonnade.operators import attribute, score
from colonnade.plans import candidates, compare, curves, ensembles, tune
from colonnade.plans.ensembles import TreeBoosting, TreeForest, TreeModel
from colonnade.plans.labels import LABEL
from colonnade.plans.logistic import LogisticNewton


def table(rng, n=400, features=4):
    x = rng.integers(0, 20, (features, n)).astype(np.uint8)
    return x, 2.0 * x[0] - x[1] * (x[2] > 9) + rng.normal(size=n), rng.integers(0, 1 << 52, n)


def grow_by_hand(x, rows, target, depth, least):
    """A tree by trying every cut on the rows themselves: nested tuples (feature, cut, left, right) or (sum, rows)."""
    total, n = target[rows].sum(), len(rows)
    best = None
    if depth and n >= 2 * least:
        for f in range(len(x)):
            for cut in range(19):
                left = rows[x[f, rows] <= cut]
                m = len(left)
                if min(m, n - m) >= max(least, 1):
                    s = target[left].sum()
                    gain = s * s / m + (total - s) ** 2 / (n - m) - total * total / n
                    if gain > 1e-10 * total * total / n and (best is None or gain > best[0]):
                        best = gain, f, cut
    if best is None:
        return total, n
    _, f, cut = best
    sides = rows[x[f, rows] <= cut], rows[x[f, rows] > cut]
    return (f, cut, *(grow_by_hand(x, side, target, depth - 1, least) for side in sides))


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[0, node], tree.rows[node]
    return tree.feature[node], tree.cut[node], nested(tree, tree.left[node]), nested(tree, tree.left[node] + 1)


@pytest.mark.parametrize("least, cells", [(1, 2_000_000), (7, 2_000_000), (3, 300)])
def test_a_tree_is_the_best_of_all_cuts(monkeypatch, least, cells):
    monkeypatch.setattr(growth, "CELLS", cells)
    x, y, _ = table(np.random.default_rng(least))
    target = np.rint(y * 1000)
    rule = Rule(True, growth.IDENTITY, 1, 1, 4, least=least)
    tree = growth.grow(x, None, [target], rule, 0, Cells.of([20] * len(x)))
    assert nested(tree) == grow_by_hand(x, np.arange(x.shape[1]), target, 4, least)


def test_boosting_follows_its_formula():
    x, y, place = table(np.random.default_rng(3))
    label, rule = (y > y.mean()).astype(float), Rule(True, growth.LOGISTIC, 1, 4, 3, step=0.5)
    margin, rounds = np.zeros(len(y)), []
    growth.boost(x, label, place, np.zeros(1), 1.0, rule, Cells.of([20] * 4), lambda t, trees: rounds.append(trees[0]))
    losses = []
    for tree in rounds:
        leaf, p = tree.leaf_of(x), 1 / (1 + np.exp(-margin))
        for node in np.unique(leaf):
            mine = leaf == node
            assert tree.value[0, node] == pytest.approx(0.5 * (label - p)[mine].sum() / ((p * (1 - p))[mine].sum() + 1), abs=1e-4)
        margin += tree.value[0][leaf]
        losses.append(np.mean(np.log1p(np.exp(np.where(label == 1, -margin, margin)))))
    assert losses == sorted(losses, reverse=True)


@pytest.mark.parametrize("link, outputs", [(growth.IDENTITY, 1), (growth.LOGISTIC, 1), (growth.SOFTMAX, 3), ("shares", 1), ("forest of numbers", 1)])
@pytest.mark.parametrize("rate", [1.0, 0.6])
def test_rows_of_equal_bins_are_one(monkeypatch, link, outputs, rate):
    """Trees grown on kinds of rows are those grown on the rows, and many rows are few kinds."""
    rng, sizes = np.random.default_rng(4), [16, 3, 2, 2]
    x = np.stack([rng.integers(0, s, 6000) for s in sizes]).astype(np.uint8)
    y = x[0] + x[1] * x[2] + rng.normal(size=6000) * 3
    start, spread = np.array([y.mean()]), np.abs(y - y.mean()).max()
    numbers = link in (growth.IDENTITY, "forest of numbers")
    if not numbers:
        y, start, spread = np.clip(y // 6, 0, max(1, outputs - 1)), np.zeros(outputs), 1.0
    boosted, place, cells = link in (growth.IDENTITY, growth.LOGISTIC, growth.SOFTMAX), rng.integers(0, 1 << 52, 6000), Cells.of(sizes)
    rule = Rule(boosted, growth.IDENTITY if numbers else link, outputs, 3, 5, step=0.3, rate=rate, subset=0 if boosted else 2)
    found = []
    for rows in (growth.ROWS_A_KIND, 1 << 30):
        monkeypatch.setattr(growth, "ROWS_A_KIND", rows)
        assert (growth.Alike(x, y, place, start, spread, rule, cells).x.shape[1] < 600) == (rows < 1 << 30)
        trees = []
        if boosted:
            growth.boost(x, y, place, start, spread, rule, cells, lambda _, new: trees.extend(new))
        else:
            growth.plant(x, y, place, start, spread, rule, cells, range(3), lambda _, new: trees.extend(new))
        found.append(trees)
    assert len(found[0]) == 3 * (outputs if boosted else 1)
    for a, b in zip(*found):
        assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("feature", "cut", "left", "rows", "gain", "value"))


def test_bundles_count_what_single_features_count():
    rng, sizes = np.random.default_rng(5), [64, 2, 50, 64, 7]
    x = np.stack([rng.integers(0, s, 50_000) for s in sizes]).astype(np.uint8)
    cells, rows, target = Cells.of(sizes), np.flatnonzero(rng.random(50_000) < 0.7), np.rint(rng.normal(size=50_000) * 1000)
    slot, bundles = rng.integers(0, 3, len(rows)), growth.bundled(x, cells)
    assert len(bundles) < len(sizes) and sorted(f for b in bundles for f in b.features) == list(range(5)) and bundles[0].pays(len(rows), 3)
    got = growth.bundle_histograms(x, bundles, rows, slot, 3, cells, None, [target])
    expected = growth.histograms(x, rows, slot, 3, None, cells, None, [target])
    assert np.array_equal(got[0], expected[0]) and np.array_equal(got[1], expected[1])


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        a, b, c = rng.normal(), rng.normal(), float(rng.integers(0, 2))
        number = 3 * a - b * c
        rows.append((i, a, b, c, number, "high" if number > 1 else "low", ["x", "y", "z"][int(np.clip(number + 1, 0, 2))]))
    return spark.createDataFrame(rows, "id int, a double, b double, c double, number double, half string, third string").repartition(5)


ROLES = {"a": "numerical", "b": "numerical", "c": "numerical"}
TARGETS = ("number", "half", "third")


def task_for(vectors, target):
    return compare.Task.of(vectors.select("id", "a", "b", "c", target), target, ["id"], ROLES)


PLANS = [
    ("number", "boosting_fast", ({"maxIter": 3, "maxDepth": 2}, {"maxIter": 2, "maxDepth": 2}, {"maxIter": 1, "maxDepth": 3, "subsamplingRate": 0.6})),
    ("third", "boosting_fast", ({"maxIter": 2, "maxDepth": 2},)),
    ("half", "random_forest", ({"numTrees": 2, "maxDepth": 3}, {"numTrees": 1, "maxDepth": 2}, {"numTrees": 1, "maxDepth": 2, "minInstancesPerNode": 9})),
]


@pytest.mark.parametrize("target, name, settings", PLANS)
def test_both_plans_grow_the_same_trees_alone_and_together(vectors, monkeypatch, target, name, settings):
    task = task_for(vectors, target)
    base = candidates.candidates(task.problem)[name]
    variants = {str(i): tune.with_params(base, s) for i, s in enumerate(settings)}
    found = []
    for limit in (1 << 30, 0):
        monkeypatch.setattr(ensembles, "IN_TASK_BYTES", limit)
        monkeypatch.setattr(ensembles, "TASK_CELLS", 1500)
        monkeypatch.setattr(ensembles, "KEEP_ROUNDS", 2)
        found.append({r[:3]: pytest.approx(r[3], rel=1e-12) for r in compare.cross_validate(task, variants, 2)})
    assert found[0] == {k: v.expected for k, v in found[1].items()} and len(found[0]) == 2 * 2 * len(variants)
    # A setting that shares a growth with others scores as it does by itself.
    monkeypatch.setattr(ensembles, "IN_TASK_BYTES", 1 << 30)
    for r in compare.cross_validate(task, {"1": variants["1"]} if "1" in variants else variants, 2):
        assert found[0][r[:3]] == r[3]


def test_a_fit_over_all_rows_where_they_lie(vectors, monkeypatch):
    task = task_for(vectors, "number")
    family = tune.with_params(candidates.candidates("regression")["boosting_fast"], {"maxIter": 2, "maxDepth": 2})
    guesses = []
    for limit in (1 << 30, 0):
        monkeypatch.setattr(ensembles, "IN_TASK_BYTES", limit)
        guesses.append(sorted((r["id"], r["prediction"]) for r in score.score_batch(task.fit(family), vectors).collect()))
    assert guesses[0] == guesses[1]


def test_several_classes_have_probabilities_that_add_up(vectors, tmp_path):
    task = task_for(vectors, "third")
    for name, settings in (("boosting_fast", {"maxIter": 20, "maxDepth": 3}), ("random_forest", {"numTrees": 20})):
        fitted = task.fit(tune.with_params(candidates.candidates("classification")[name], settings))
        path = str(tmp_path / name)
        fitted.write().save(path)
        again = PipelineModel.load(path)
        scored = score.score_batch(fitted, vectors)
        assert sorted(scored.collect()) == sorted(score.score_batch(again, vectors).collect())
        assert scored.where("prediction = third").count() > 0.93 * vectors.count()
        model = next(s for s in again.stages if isinstance(s, TreeModel))
        assert model.featureImportances.toArray().sum() == pytest.approx(1) and model.featureImportances.toArray()[0] > 0.5
        assert curves.feature_importance(again, vectors.sparkSession).first()["feature"] == "a"
        vector = model.transform(ready(fitted, vectors)).select("__probability").first()[0].toArray()
        assert len(vector) == 3 and vector.sum() == pytest.approx(1)


def ready(fitted, df):
    for stage in fitted.stages:
        if isinstance(stage, TreeModel):
            return df
        df = stage.transform(df)


def test_attributions_of_own_trees_add_up(vectors):
    for target, name, settings in (("half", "boosting_fast", {"maxIter": 6, "maxDepth": 3}), ("number", "boosting_fast", {"maxIter": 6, "maxDepth": 3}),
                                   ("half", "random_forest", {"numTrees": 6, "maxDepth": 4}), ("number", "random_forest", {"numTrees": 6, "maxDepth": 4})):
        task = task_for(vectors, target)
        df = vectors.select("id", "a", "b", "c", target)
        fitted = task.fit(tune.with_params(candidates.candidates(task.problem)[name], settings))
        explainer = attribute.make_explainer(fitted, df, ["id"], background_rows=8)
        output = {r["id"]: r["output"] for r in attribute.explained_output(attribute.explain_sample(explainer, df, ["id"], 20), ["id"]).collect()}
        column = "prediction_probability" if target == "half" else "prediction"
        scored = {r["id"]: r[column] for r in score.score_batch(fitted, df).collect()}
        assert len(output) == 20 and all(v == pytest.approx(scored[k], abs=1e-9) for k, v in output.items())


def test_constant_labels_and_one_row(spark):
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(Vectors.dense(1.0, float(i)), 4.0) for i in range(3)], ["features", LABEL])
    for family in (TreeBoosting(maxIter=2), TreeForest(numTrees=2)):
        for df in (rows, rows.limit(1)):
            assert [r["__prediction"] for r in family.fit(df).transform(df).collect()] == [4.0] * df.count()


def test_newton_finds_the_minimum(vectors):
    task = task_for(vectors, "third")
    prepared = task.prepare(task.train)
    df = task.vectors(prepared, task.train).cache()
    for classes, labelled in ((3, df), (2, df.withColumn(LABEL, F.when(F.col(LABEL) > 0, 1.0).otherwise(0.0)))):
        model = LogisticNewton(regParam=0.01, classes=classes).fit(labelled)
        weights = np.array(model.learned["weights"])
        data = labelled.toPandas()
        x = np.column_stack([np.stack([v.toArray() for v in data["features"]]), np.ones(len(data))])
        y = data[LABEL].to_numpy().astype(int)
        m = x @ weights.T
        m = np.column_stack([np.zeros(len(m)), m]) if classes == 2 else m
        p = np.exp(m - m.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = (p - np.eye(classes)[y]).T @ x / len(y)
        penalty = np.append(np.full(x.shape[1] - 1, 0.01), 0.0)
        slope = (slope[1:] if classes == 2 else slope) + penalty * weights
        assert np.abs(slope).max() < 1e-6
        made = model.transform(labelled).select("__probability", "__prediction").toPandas()
        assert np.abs(np.stack([v.toArray() for v in made["__probability"]]) - p).max() < 1e-9
        assert (made["__prediction"].to_numpy() == p.argmax(1)).all()


def test_a_comparison_goes_on_after_a_break(vectors, tmp_path, monkeypatch):
    task = task_for(vectors, "number")
    models = {"linear": candidates.candidates("regression")["linear_regression"], "mean": lambda shape: candidates.Baseline("regression"),
              "few": tune.with_params(candidates.candidates("regression")["boosting_fast"], {"maxIter": 3, "maxDepth": 2})}
    whole = [r[:4] for r in compare.cross_validate(task, models, 3)]
    path, fits = str(tmp_path / "ledger"), []
    fit = candidates.Baseline._fit

    def broken(self, df):
        fits.append(1)
        if len(fits) == 2:
            raise RuntimeError("Job aborted: ExecutorLostFailure (executor 3 exited)")
        return fit(self, df)

    monkeypatch.setattr(candidates.Baseline, "_fit", broken)
    with pytest.raises(RuntimeError, match="resume it with the ledger"):
        compare.cross_validate(task, models, 3, resume=path)
    kept = vectors.sparkSession.read.parquet(path)
    assert kept.count() == 4
    assert [r[:4] for r in compare.cross_validate(task, models, 3, resume=path)] == whole
    assert len(fits) == 4
    assert [r[:4] for r in compare.cross_validate(task, models, 3, resume=path)] == whole and len(fits) == 4


def test_faults_of_models_and_of_the_cluster():
    assert compare.is_models_fault(ValueError("depth")) and compare.is_models_fault(ZeroDivisionError())
    for text in ("ExecutorLostFailure", "Job 3 cancelled because SparkContext was shut down"):
        assert not compare.is_models_fault(RuntimeError(text)) and not compare.is_models_fault(ValueError(text))
    assert not compare.is_models_fault(ConnectionRefusedError()) and not compare.is_models_fault(RuntimeError("unknown"))


@pytest.mark.parametrize("target", ["number", "half", "third"])
def test_kinds_counted_where_rows_lie_give_the_same_models(vectors, target, monkeypatch):
    monkeypatch.setattr(ensembles, "IN_TASK_BYTES", 1 << 30)
    spark, classes = vectors.sparkSession, {"number": 0, "half": 2, "third": 3}[target]
    rng = np.random.default_rng(5)
    x, n = rng.integers(0, 4, (6_000, 3)), 6_000
    y = x[:, 0] * 1.7 + rng.normal(size=n) if not classes else (x[:, 0] + rng.integers(0, 2, n)) % classes
    rows = [(float(v), [float(c) for c in r], int(p)) for v, r, p in zip(y, x, rng.integers(0, 1 << 52, n))]
    df = spark.createDataFrame(rows, f"{LABEL} double, x array<double>, {ensembles.PLACE} bigint").withColumn("features", array_to_vector("x")).drop("x")
    families = {
        "few": TreeForest(numTrees=5, maxDepth=3, classes=classes, featureSubset="sqrt"), "more": TreeForest(numTrees=14, maxDepth=6, classes=classes, featureSubset="sqrt"),
        "all": TreeBoosting(maxIter=4, maxDepth=3, classes=classes), "part": TreeBoosting(maxIter=5, maxDepth=3, subsamplingRate=0.7, classes=classes),
        "most": TreeBoosting(maxIter=3, maxDepth=2, subsamplingRate=0.9, classes=classes),
    }
    found = []
    for least in (1 << 40, 1):
        monkeypatch.setattr(ensembles, "COUNT_ROWS", least)
        monkeypatch.setattr(ensembles, "TASK_CELLS", 40_000)
        folds = ensembles.Folds(spark)
        for k in range(2):
            folds.add(k, df.where(F.col(ensembles.PLACE) % 2 != k), df.where(F.col(ensembles.PLACE) % 2 == k), families)
        assert (ensembles._Counted.of(folds) is not None) == (least == 1)
        found.append((folds.models(), [r[:3] for r in folds.scores(classes > 0)]))
    (one, scores), (two, others) = found
    for (k, name, score, *_), (fold, same, other, *_) in zip(scores, others, strict=True):
        assert (k, name) == (fold, same) and score == pytest.approx(other, rel=1e-12)
    for name, model in one.items():
        for (a, limits), (b, same) in zip(model.trees, two[name].trees, strict=True):
            assert all((getattr(a, f) == getattr(b, f)).all() for f in ("feature", "cut", "left", "rows", "value")) and (limits == same).all()


def test_spread_trees_of_a_forest_share_their_jobs(vectors, monkeypatch):
    df = task_for(vectors, "half")
    prepared = df.prepare(df.train)
    rows = df.kept_vectors(prepared, df.train)
    forest, found, calls = TreeForest(numTrees=7, maxDepth=3, classes=2, featureSubset="sqrt"), [], []
    cuts = ensembles._Spread._cuts
    monkeypatch.setattr(ensembles._Spread, "_cuts", lambda self, *rest: calls.append(1) or cuts(self, *rest))
    for limit in (1 << 40, 0):
        monkeypatch.setattr(ensembles, "IN_TASK_BYTES", limit)
        monkeypatch.setattr(ensembles, "TOGETHER", 5)
        found.append(forest.fit(rows))
    # Three levels of the first five trees and three of the other two.
    assert len(calls) <= 6
    for (a, _), (b, _) in zip(found[0].trees, found[1].trees, strict=True):
        assert all((getattr(a, f) == getattr(b, f)).all() for f in ("feature", "cut", "left", "rows", "value"))
