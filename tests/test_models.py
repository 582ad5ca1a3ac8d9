"""Evaluation, comparison, tuning, scoring, attribution and versions."""

import math
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from colonnade.functions import shapley
from colonnade.operators import attribute, metrics, running, score
from colonnade.plans import candidates, compare, curves, labels, tune
from colonnade.plans.steps import MissingColumns
from colonnade.sources import versions
from colonnade.sources.runs import RunLog
from colonnade.sources.tables import TableError, land, malformed_lines, read_csv, read_parquet, write_csv
from colonnade.sources.versions import ModelStore, UnknownVersion
from colonnade.streaming.scoring import read_stream, start_scoring

# Metrics.


def judged(spark, truth, guess, scores=None):
    scores = scores or [None] * len(truth)
    kind = "string" if isinstance(truth[0], str) else "double"
    return spark.createDataFrame(list(zip(truth, guess, scores)), f"label {kind}, prediction {kind}, score double")


def test_perfect_predictions(spark):
    df = judged(spark, ["a", "b", "a"], ["a", "b", "a"])
    assert rows(metrics.classification_scores(df)) == [(1.0, 1.0, 1.0, 1.0)]
    assert rows(metrics.confusion(df)) == [("a", "a", 2), ("a", "b", 0), ("b", "a", 0), ("b", "b", 1)]
    numbers = metrics.regression_scores(judged(spark, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0])).first()
    assert numbers[:] == (0.0, 0.0, 1.0, 0.0)


def test_class_that_is_never_predicted_or_never_true(spark):
    df = judged(spark, ["a", "a", "b"], ["a", "c", "a"])
    scored = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.class_scores(df).collect()}
    assert scored == {"a": (0.5, 0.5, 0.5), "b": (0.0, 0.0, 0.0), "c": (0.0, 0.0, 0.0)}
    assert metrics.confusion(df).count() == 9


def test_mape_is_null_with_a_zero_and_r2_of_a_constant(spark):
    assert metrics.regression_scores(judged(spark, [0.0, 2.0], [1.0, 2.0])).first()["mape"] is None
    assert metrics.regression_scores(judged(spark, [2.0, 2.0], [1.0, 2.0])).first()["r2"] == 0.0


def test_auc_counts_ties_half_and_needs_two_labels(spark):
    df = judged(spark, [1.0, 0.0, 1.0, 0.0], [1.0] * 4, [0.9, 0.5, 0.5, 0.1])
    assert metrics.roc_auc(df).first()[0] == 0.875
    assert metrics.roc_auc(df.where("label = 1")).first()[0] is None
    assert metrics.roc_auc(df.withColumn("label", F.when(F.col("score") > 0.8, 2.0).otherwise(F.col("label")))).first()[0] is None


@pytest.mark.parametrize("bucket_rows", [1000, 63, 10, 1])
def test_running_sums_over_many_buckets(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(running, "BUCKET_ROWS", bucket_rows)
    df = spark.range(500).select((F.col("id") * 7 % 500).cast("double").alias("x"), F.lit(1).cast("bigint").alias("n"))
    out = running.running_sums(df, "x", ["n"])
    assert out.where(F.col("n_upto") != 500 - F.col("x")).isEmpty()
    assert out.where("n_total != 500").isEmpty() and out.count() == 500


def test_points_do_not_depend_on_the_number_of_ranges(spark, monkeypatch):
    df = spark.range(20_000).select(
        (F.xxhash64("id") % 7919 / 100.0).alias("score"), (F.xxhash64("id", F.lit(1)) % 3 == 0).cast("double").alias("label"))
    def results():
        return rows(metrics.roc_points(df)), rows(metrics.pr_points(df)), metrics.roc_auc(df).first()[0]

    monkeypatch.setattr(running, "BUCKET_ROWS", 1_000)
    few = results()
    monkeypatch.setattr(running, "BUCKET_ROWS", 80)
    monkeypatch.setattr(running, "BROADCAST_RANGES", 100)
    assert results() == few and len(few[0]) > 5_000


@pytest.mark.parametrize("bucket_rows", [1000, 7])
def test_dense_numbers_of_texts(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(running, "BUCKET_ROWS", bucket_rows)
    texts = ["", "A", "a", "ä", "zz", *(f"t{i}" for i in range(60))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert rows(running.dense_numbers(df, "text")) == sorted(((t, i) for i, t in enumerate(sorted(texts))), key=repr)
    assert running.dense_numbers(df.limit(0), "text").isEmpty()


def test_very_many_classes(spark, tmp_path, monkeypatch):
    """50,000 labels are numbered, decoded and counted without coming to the driver."""
    monkeypatch.setattr(running, "BUCKET_ROWS", 7_000)
    df = spark.range(100_000).select("id", (F.col("id") % 50_000 * 3 - 1).alias("y"))
    found = labels.sorted_labels(df, "y")
    assert isinstance(found, labels.LabelTable) and len(found) == 50_000
    numbered = labels.indexed(df, "y", found)
    assert numbered.where(F.col(labels.LABEL) != F.col("id") % 50_000).isEmpty() and numbered.count() == 100_000
    decoder = labels.LabelDecoder.for_target(df, "y", found)
    decoder.write().save(str(tmp_path / "decoder"))
    for model in (decoder, labels.LabelDecoder.load(str(tmp_path / "decoder"))):
        out = model.transform(numbered.withColumn(labels.PREDICTION, F.col(labels.LABEL)))
        assert out.columns == ["id", "y", "prediction"] and out.where("y = prediction").count() == 100_000
    cells = metrics.confusion(out, "y", zero_filled=False)
    assert cells.where("actual = predicted AND n = 2").count() == 50_000
    with pytest.raises(Exception, match="unknown label: 1"):
        labels.indexed(df.select("id", F.lit(1).alias("y")), "y", found).collect()


def test_a_table_of_labels_is_the_same_as_a_list(spark, task, monkeypatch):
    def scored(fitted):
        out = score.score_batch(fitted, task.train)
        return rows(out.withColumn("prediction_probability", F.round("prediction_probability", 9)))

    expected = scored(task.fit(FEW["logistic_regression"]))
    monkeypatch.setattr(labels, "INLINE_CLASSES", 1)
    many = compare.Task.of(task.train, task.target, task.key_cols, task.roles)
    assert isinstance(many.labels, labels.LabelTable) and len(many.labels) == len(task.labels)
    assert scored(many.fit(FEW["logistic_regression"])) == expected


def test_confusion_fills_pairs(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "c"), ("c", None)], "label string, prediction string")
    filled = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion(df).collect()}
    assert len(filled) == 10 and {k: n for k, n in filled.items() if n} == {("a", "b"): 1, ("c", "c"): 1, ("c", None): 1}
    assert metrics.confusion(df.limit(0)).isEmpty()


# Models.

FEW = {
    "logistic_regression": lambda shape: LogisticRegression(maxIter=20, regParam=0.01),
    "most_frequent": lambda shape: candidates.Baseline("classification"),
}


@pytest.fixture(scope="module")
def classified(spark):
    return spark.createDataFrame(
        [(i, (1.3 * i) % 17, "xyz"[i % 3], 1 if (1.3 * i) % 17 > 8 else 0) for i in range(60)],
        "id int, feature_a double, feature_b string, y int")


@pytest.fixture(scope="module")
def task(classified):
    return compare.Task.of(classified, "y", ["id"])


@pytest.fixture(scope="module")
def line_task(spark):
    df = spark.createDataFrame([(i, 2.1 * i, 3 * 2.1 * i + 5) for i in range(60)], "id int, feature_a double, y double")
    return compare.Task.of(df, "y", ["id"])


def test_comparison_beats_the_baseline_and_skips_failures(task):
    models = {**FEW, "broken": lambda shape: 1 / 0}
    scores = compare.compare_models(task, models, folds=3)
    board = compare.leaderboard(scores, task.problem).collect()
    assert [r["model"] for r in board] == ["logistic_regression", "most_frequent"]
    assert board[0]["accuracy"] > board[1]["accuracy"]
    name, fitted = compare.fit_best(task, scores, models)
    assert name == "logistic_regression"
    predicted = score.score_batch(fitted, task.train)
    assert predicted.count() == 60 and predicted.schema["prediction"].dataType.simpleString() == "int"
    assert compare.held_out_score(fitted, task.train, "y", task.problem).first()["score"] > 0.8


def test_regression_comparison_and_order(line_task):
    models = {"linear": lambda shape: LinearRegression(), "mean": lambda shape: candidates.Baseline("regression")}
    board = compare.leaderboard(compare.compare_models(line_task, models, folds=2), "regression").collect()
    assert board[0]["model"] == "linear" and board[0]["r2"] > 0.9 and board[0]["neg_rmse"] > board[1]["neg_rmse"]


def test_no_scores_is_an_error(spark, task):
    with pytest.raises(ValueError, match="no candidate"):
        compare.best_model(spark.createDataFrame([], compare.FOLD_SCORES), task.problem)


def test_candidates_and_spaces():
    names = {p: list(candidates.candidates(p)) for p in ("classification", "regression")}
    assert names["classification"] == ["logistic_regression", "random_forest", *candidates.BOOSTING_PRESETS, "neural_network"]
    assert names["regression"] == ["linear_regression", "random_forest", *candidates.BOOSTING_PRESETS]
    with pytest.raises(ValueError):
        candidates.candidates("clustering")
    for name, space in candidates.SEARCH_SPACES.items():
        first, again = candidates.draws(space, 25), candidates.draws(space, 25)
        assert first == again and len(first) == 25
        for draw in first:
            for key, value in draw.items():
                limits = space[key]
                if isinstance(limits, candidates.Whole):
                    assert limits.low <= value < limits.high
                else:
                    assert limits.low <= value <= limits.low + limits.width
        assert candidates.grid(candidates.GRIDS[name]) or not candidates.GRIDS[name]
    with pytest.raises(ValueError, match="lists"):
        candidates.grid(candidates.search_space("random_forest"))


@pytest.mark.parametrize("name", ["neural_network", "random_forest", "boosting_fast"])
def test_multiclass_families(spark, name):
    df = spark.createDataFrame([(float(i % 30), 1 + 9 * (i % 30 // 10)) for i in range(90)], "x double, y int")
    task = compare.Task.of(df, "y", overrides={"x": "numerical"})
    assert task.labels == ["1", "10", "19"]
    family = candidates.candidates("classification")[name]
    small = {"random_forest": {"numTrees": 5}, "boosting_fast": {"maxIter": 3, "maxDepth": 3}}.get(name, {})
    scored = score.score_batch(task.fit(tune.with_params(family, small)), df)
    assert {r["prediction"] for r in scored.collect()} <= {1, 10, 19}
    assert scored.where("prediction_probability BETWEEN 0 AND 1").count() == 90


def test_tuning(task, line_task):
    logistic = candidates.candidates("classification")["logistic_regression"]
    grid = tune.tune(task, "logistic_regression", logistic, "grid", {"c": [0.1, 1.0], "fitIntercept": [True, False]}, folds=2)
    assert (grid.method, grid.tried) == ("grid", 4) and set(grid.params) == {"c", "fitIntercept"}
    drawn = tune.tune(task, "logistic_regression", logistic, count=2, folds=2, parallelism=2)
    assert drawn.tried == 2 and 0.01 <= drawn.params["c"] <= 10
    plain = tune.tune(line_task, "linear_regression", LinearRegression())
    assert (plain.method, plain.tried, plain.params) == ("none", 0, {}) and math.isnan(plain.score)
    with pytest.raises(ValueError, match="method"):
        tune.tune(task, "logistic_regression", logistic, "bayesian")


def test_learning_curve_and_importance(spark, task):
    scores = curves.learning_scores(task, FEW["logistic_regression"], folds=2, shares=(0.5, 1.0))
    curve = curves.learning_curve(scores).collect()
    assert [r["share"] for r in curve] == [0.5, 1.0] and curve[0]["train_rows"] < curve[1]["train_rows"] == 30
    fitted = task.fit(FEW["logistic_regression"])
    importance = curves.feature_importance(fitted, spark)
    assert importance.first()["feature"] == "feature_a" and importance.count() == 4
    assert curves.top_features(importance, 2).count() == 2
    assert curves.feature_importance(task.fit(FEW["most_frequent"]), spark) is None


# Scoring.

def test_parts_of_a_curve_read_their_own_rows(line_task):
    """The table lies by the thresholds that rows have passed; each part has the rows below its own."""
    shares = (1.0, 0.2, 0.6)
    found = {(r["share"], r["fold"]): r["train_rows"] for r in curves.learning_scores(line_task, LinearRegression(solver="normal"), 2, shares).collect()}
    place = F.pmod(curves.row_hash(line_task.train, line_task.key_cols or None, line_task.seed + 1), F.lit(1_000_000))
    folded = line_task.folded(2, **{curves.PASSED: F.when(place < 200_000, 0).when(place < 600_000, 1).otherwise(2)})
    for (share, k), n in found.items():
        assert n == folded.where((F.col(compare.FOLD) != k) & (place < round(share * 1_000_000))).count()
    first = folded.where((F.col(compare.FOLD) == 0) & (F.col(curves.PASSED) == 0))
    assert first.count()
    assert "PartitionFilters: [" in first._jdf.queryExecution().toString() and curves.PASSED in first._jdf.queryExecution().toString().split("PartitionFilters")[1]


def test_scoring_checks_and_keeps_columns(classified, task):
    fitted = task.fit(FEW["logistic_regression"])
    new = classified.select("feature_b", F.lit(7).alias("extra"), "feature_a")
    scored = score.score_batch(fitted, new)
    assert scored.columns == ["feature_b", "extra", "feature_a", "prediction", "prediction_probability"]
    assert rows(scored, *new.columns) == rows(new)
    with pytest.raises(MissingColumns, match="feature_a"):
        score.score_batch(fitted, classified.drop("feature_a"))


def test_stream_scores_like_the_table(spark, classified, task, tmp_path):
    fitted = task.fit(FEW["logistic_regression"])
    classified.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), classified.schema)
    start_scoring(fitted, stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(score.score_batch(fitted, classified))
    # A second run finds nothing new.
    start_scoring(fitted, stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
    with pytest.raises(MissingColumns):
        start_scoring(fitted, stream.drop("feature_a"), str(tmp_path / "o2"), str(tmp_path / "p2"))


# Attribution.

def brute_force(output, x, background):
    """Shapley values by summing over all subsets of features."""
    d = len(x)

    def worth(chosen):
        hybrid = background.copy()
        hybrid[:, list(chosen)] = x[list(chosen)]
        return output(hybrid)

    values = np.zeros((d, len(background)))
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for size in range(d):
            weight = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
            for chosen in combinations(others, size):
                values[i] += weight * (worth((*chosen, i)) - worth(chosen))
    return values


@pytest.fixture(scope="module")
def explained(spark):
    data = []
    for i in range(80):
        a, b, c = (7 * i) % 23, (5 * i) % 11, (3 * i) % 7
        data.append((i, float(a), float(b), float(c), "big" if a * b + 3 * c > 60 else "little", float(a * b + 3 * c)))
    return spark.createDataFrame(data, "id int, a double, b double, c double, size string, y double")


NUMBERS = dict.fromkeys("abc", "numerical")
TREES = {
    "forest": ("size", lambda shape: RandomForestClassifier(numTrees=4, maxDepth=4, seed=1)),
    "boosted": ("size", lambda shape: GBTClassifier(maxIter=4, maxDepth=3, seed=1)),
    "forest_numbers": ("y", lambda shape: RandomForestRegressor(numTrees=4, maxDepth=4, seed=1)),
    "boosted_numbers": ("y", lambda shape: GBTRegressor(maxIter=4, maxDepth=3, seed=1)),
}


@pytest.mark.parametrize("family", list(TREES))
def test_attribution_is_exact(explained, family):
    target, model = TREES[family]
    other = "y" if target == "size" else "size"
    df = explained.drop(other)
    fitted = compare.Task.of(df, target, ["id"], NUMBERS).fit(model)
    explainer = attribute.make_explainer(fitted, df, ["id"], background_rows=9)
    shap = attribute.explain_sample(explainer, df, ["id"], 12)
    assert shap.count() == 12 * len(explainer.names)

    output = {r["id"]: r["output"] for r in attribute.explained_output(shap, ["id"]).collect()}
    column = "prediction_probability" if target == "size" else "prediction"
    scored = {r["id"]: r[column] for r in score.score_batch(fitted, df).collect()}
    assert len(output) == 12
    for key, value in output.items():
        assert value == pytest.approx(scored[key], abs=1e-9)

    ensemble, background = explainer.ensemble, explainer.background
    for row in background[:3]:
        row = row + 0.25
        got = shapley.shapley_values(ensemble, row[None, :], background)[0]
        per_pair = brute_force(ensemble.raw, row, background)
        if ensemble.logistic:
            raw, raw_z = ensemble.raw(row[None, :])[0], ensemble.raw(background)
            rise = ensemble.output(row[None, :])[0] - ensemble.output(background)
            run = raw - raw_z
            per_pair = per_pair * np.where(np.abs(run) < 1e-12, 0.0, rise / np.where(np.abs(run) < 1e-12, 1.0, run))
        assert got == pytest.approx(per_pair.mean(axis=1), abs=1e-9)


def test_patterns_of_long_and_short_paths():
    source = np.random.default_rng(5)
    for size in (1, shapley.TABLE_BITS, shapley.TABLE_BITS + 1):
        codes = source.integers(0, 1 << size, 300)
        found, place = shapley._distinct(codes, size)
        assert (found[place] == codes).all() and (np.diff(found) > 0).all()
        assert (shapley._bits(found, size) @ (1 << np.arange(size)) == found).all()


def test_long_paths_and_odd_values_are_attributed_alike(monkeypatch):
    """Paths beyond the table of pairs give what those within it give; a value that is no number meets no condition."""
    source = np.random.default_rng(6)
    leaves = []
    for size in (1, 4, 12, 3):
        features = np.sort(source.choice(14, size, replace=False))
        low, high = source.normal(-1.5, 1, size), source.normal(1.5, 1, size)
        low[source.random(size) < 0.3], high[source.random(size) < 0.3] = -np.inf, np.inf
        leaves.append(shapley.Leaf(features, low, high, float(source.normal())))
    ensemble = shapley.Ensemble(leaves, 14)
    x, background = source.normal(size=(40, 14)), source.normal(size=(30, 14))
    found = []
    for bits in (shapley.PAIR_BITS, 0):
        monkeypatch.setattr(shapley, "PAIR_BITS", bits)
        found.append(shapley.shapley_values(ensemble, x, background))
    assert found[0] == pytest.approx(found[1], abs=1e-12)
    assert found[0].sum(axis=1) == pytest.approx(ensemble.raw(x) - ensemble.raw(background).mean(), abs=1e-12)
    x[:, leaves[0].features[0]] = np.nan
    assert ensemble.raw(x) == pytest.approx(sum(leaf.value * leaf.satisfied(x).prod(axis=1) for leaf in leaves), abs=1e-12)


def test_rows_of_one_file_are_explained_by_many_tasks(explained, monkeypatch):
    monkeypatch.setattr(attribute, "MOST_ROWS", 20)
    df = explained.drop("size").coalesce(1)
    explainer = attribute.make_explainer(compare.Task.of(df, "y", ["id"], NUMBERS).fit(TREES["forest_numbers"][1]), df, ["id"], 5)
    shap = attribute.explain(explainer, df, ["id"])
    sizes = [r["n"] for r in shap.groupBy(F.spark_partition_id()).agg(F.count_distinct("id").alias("n")).collect()]
    assert len(sizes) > 1 and sum(sizes) == 80 and max(sizes) <= 21 and shap.count() == 80 * len(explainer.names)


def test_fits_do_not_depend_on_parts(explained):
    df = explained.drop("size")
    guesses = []
    for parts in (1, 5):
        fitted = compare.Task.of(df.repartition(parts), "y", ["id"], NUMBERS).fit(TREES["forest_numbers"][1])
        guesses.append({r["id"]: r["prediction"] for r in score.score_batch(fitted, df).collect()})
    assert guesses[0].keys() == guesses[1].keys()
    assert all(guesses[1][k] == pytest.approx(v, abs=1e-9) for k, v in guesses[0].items())


def test_attribution_reports_and_limits(explained, task):
    df = explained.drop("y")
    fitted = compare.Task.of(df, "size", ["id"], NUMBERS).fit(TREES["forest"][1])
    explainer = attribute.make_explainer(fitted, df, ["id"], background_rows=5)
    shap = attribute.explain(explainer, df, ["id"])
    assert attribute.top_global(shap, 2).count() == 2
    swarm = attribute.beeswarm(shap, ["id"], 3)
    assert swarm.count() == 240 and swarm.agg(F.min("position"), F.max("position")).first()[:] == (0.0, 1.0)
    falls = attribute.waterfall(shap, ["id"], 4)
    assert falls.groupBy("id").count().select("count").distinct().collect()[0][0] == 4
    assert attribute.explain_row(explainer, df.where("id = 3"), ["id"]).count() == len(explainer.names)
    for wrong in (df.where("id < 0"), df.where("id < 2")):
        with pytest.raises(ValueError, match="exactly one row"):
            attribute.explain_row(explainer, wrong, ["id"])
    with pytest.raises(ValueError, match="tree model"):
        attribute.tree_model(task.fit(FEW["logistic_regression"]))


# Versions, runs, files.

def test_model_store(spark, task, tmp_path):
    fitted = task.fit(FEW["logistic_regression"])
    store = ModelStore(spark, str(tmp_path / "store"))
    with pytest.raises(UnknownVersion):
        store.load("nothing")
    assert store.datasets().isEmpty()

    def save(dataset, promote=True):
        return store.save(dataset, "logistic", task.problem, fitted, {"accuracy": 0.9}, {"c": 1.0}, list(task.roles), 60, promote)

    assert [save("My data.csv")["version"], save("other.csv")["version"], save("My data.csv", promote=False)["version"]] == [1, 1, 2]
    record = store.metadata("My data.csv")
    assert (record["version"], record["dataset"], record["metrics"], record["feature_columns"]) == (
        1, "my_data", {"accuracy": 0.9}, ["feature_a", "feature_b"])
    store.promote("My data.csv", 2)
    assert store.metadata("my_data")["version"] == 2
    assert [r["version"] for r in store.list_versions("My data.csv").collect()] == [2, 1]
    store.delete("My data.csv", 2)
    assert store.metadata("my_data")["version"] == 1
    # Numbers are not used again, and an unpromoted version does not take over.
    assert save("My data.csv", promote=False)["version"] == 3
    assert store.metadata("my_data")["version"] == 1
    for action in (lambda: store.promote("my_data", 2), lambda: store.load("my_data", 9), lambda: store.delete("my_data", 2)):
        with pytest.raises(UnknownVersion):
            action()
    assert rows(store.datasets()) == [("my_data",), ("other",)]
    assert rows(score.score_batch(store.load("my_data"), task.train)) == rows(score.score_batch(fitted, task.train))


def test_numbers_of_writers_at_once(spark, tmp_path):
    """Sessions that draw at the same time get numbers of their own."""
    folder = str(tmp_path / "store")
    stores = [ModelStore(spark.newSession(), folder) for _ in range(3)]
    with ThreadPoolExecutor(3) as pool:
        drawn = list(pool.map(lambda store: [store._claim("data"), store._claim("data")], stores))
    numbers = [n for pair in drawn for n in pair]
    assert len(set(numbers)) == 6 and all(first < second for first, second in drawn)


def test_a_rival_claim_is_seen(spark, tmp_path, monkeypatch):
    """A claim that arrives between reading and writing makes the writer draw again."""
    monkeypatch.setattr(versions, "CLAIM_WAIT", 0.0)
    store, rival = ModelStore(spark, str(tmp_path / "store")), ModelStore(spark, str(tmp_path / "store"))
    append, late = store._append, [1, 2]

    def append_late(table, schema, row):
        if late and row[1] == late[0]:
            rival._append(table, schema, (row[0], late.pop(0), "rival"))
        append(table, schema, row)

    monkeypatch.setattr(store, "_append", append_late)
    assert store._claim("data") == 3 and rival._claim("data") == 4


def test_run_log(spark, task, tmp_path):
    log = RunLog(spark, str(tmp_path / "runs"))
    first = log.append("by hand", {"depth": 3}, {"accuracy": 0.5}, {"stage": "trial"})
    log.append_comparison(compare.compare_models(task, FEW, folds=2), "data", task.problem, 2)
    runs = {r["run_name"]: r for r in log.read().collect()}
    assert set(runs) == {"by hand", *FEW}
    assert runs["by hand"]["run_id"] == first and runs["by hand"]["params"] == {"depth": "3"}
    assert set(runs["most_frequent"]["metrics"]) == {"accuracy", "accuracy_std", "f1", "f1_std", "fit_seconds"}


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("name,n\nMüller,1\nÅsa,2\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes("name,n\nMüller,1\nÅsa,2\n".encode())
    for file in ("latin.csv", "utf.csv"):
        assert rows(read_csv(spark, str(tmp_path / file))) == [("Müller", 1), ("Åsa", 2)]
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(TableError, match="no rows"):
        read_csv(spark, str(tmp_path / "empty.csv"))
    with pytest.raises(TableError):
        read_csv(spark, str(tmp_path / "absent.csv"))


def test_csv_quoting_and_errors(spark, tmp_path):
    cells = [("plain", 1), ('says "no", twice', 2), ("two\nlines", 3), ("  spaced ", 4), (None, 5)]
    df = spark.createDataFrame(cells, "text string, n int")
    write_csv(df.coalesce(1), str(tmp_path / "quoted"))
    assert rows(read_csv(spark, str(tmp_path / "quoted"), df.schema)) == rows(df)
    part = next((tmp_path / "quoted").glob("part*"))
    assert pd.read_csv(part)["text"].tolist()[:4] == [c[0] for c in cells[:4]]
    (tmp_path / "windows.csv").write_bytes("name,n\n“Müller” €,1\n".encode("cp1252"))
    assert rows(read_csv(spark, str(tmp_path / "windows.csv"))) == [("“Müller” €", 1)]
    (tmp_path / "late.csv").write_text("a,b\n1,2\nx,3\n")
    with pytest.raises(TableError, match="does not fit"):
        read_csv(spark, str(tmp_path / "late.csv"), "a int, b int")


@pytest.mark.parametrize("split", [37, 64, 1000])
def test_csv_line_breaks_by_many_tasks(spark, tmp_path, split):
    """Records that cross any number of splits, in two files, with every kind of line break and the mark itself."""
    cells = [f"row {i}" + ["", "\n\nmore", ' "quoted"\n', "\r\nwindows", "\u0001n", "\n" * 40 + "long", ',"",'][i % 7] for i in range(60)]
    for part in range(2):
        with open(tmp_path / f"part{part}.csv", "w", encoding="utf-8", newline="") as file:
            file.write("number,words\n")
            for i in range(part, 60, 2):
                quoted = '"' + cells[i].replace('"', '""') + '"'
                file.write(f"{i},{quoted}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        for schema in (None, "number int, words string"):
            read = read_csv(spark, str(tmp_path), schema)
            assert read.dtypes == [("number", "int"), ("words", "string")]
            assert rows(read) == sorted(enumerate(cells), key=repr)
        with pytest.raises(TableError, match="header"):
            read_csv(spark, str(tmp_path), "number int, text string")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,2\nx,3\n4,5\n")
    schema = spark.createDataFrame([], "a int, b int").schema
    assert rows(malformed_lines(spark, str(tmp_path / "bad.csv"), schema)) == [("x,3",)]


def test_write_and_land(spark, classified, tmp_path):
    write_csv(classified, str(tmp_path / "out"))
    assert rows(read_csv(spark, str(tmp_path / "out"), classified.schema)) == rows(classified)
    path = land(classified, str(tmp_path), "../../My set.v1.csv")
    assert path == f"{tmp_path}/______my_set_v1"
    assert rows(read_parquet(spark, path)) == rows(classified)
    with pytest.raises(TableError):
        land(classified, str(tmp_path), "???.csv")


def test_registered_fits_are_the_whole_job(spark, small, monkeypatch):
    """The queries compare, tune and explain the default families on default folds, draws, grids and backgrounds."""
    from colonnade.plans import catalog

    class Seen(Exception):
        pass

    def settings(model, shape=candidates.Shape(100, 5, 2)):
        estimator = model(shape)
        return type(estimator).__name__, {p.name: v for p, v in estimator.extractParamMap().items() if not p.name.endswith("Col")}

    def stop(*args, **named):
        raise Seen(args, named)

    def asked(name):
        with pytest.raises(Seen) as caught:
            catalog.REGISTRY[name](spark, small)
        return caught.value.args

    with monkeypatch.context() as patch:
        patch.setattr(compare, "cross_validate", stop)
        patch.setattr(tune, "cross_validate", stop)
        for name in ("compare_classifiers", "compare_regressors"):
            (task, models, folds, _, _), _ = asked(name)
            families = candidates.candidates(task.problem)
            assert folds == 5 and {k: settings(m) for k, m in models.items()} == {k: settings(m) for k, m in families.items()}
        for name, family, tried in (
            ("tune_random", "boosting_fast", candidates.draws(candidates.SEARCH_SPACES["boosting_fast"], 25)),
            ("tune_grid", "random_forest", candidates.grid(candidates.GRIDS["random_forest"])),
        ):
            (task, variants, folds, _, _), _ = asked(name)
            model = candidates.candidates(task.problem)[family]
            assert folds == 5 and [settings(v) for v in variants.values()] == [settings(tune.with_params(model, p)) for p in tried]
    for name in ("feature_importance", "shap_adds_up", "shap_boosted_adds_up", "shap_global", "shap_one_row"):
        with monkeypatch.context() as patch:
            patch.setattr(compare.Task, "fit", stop)
            (task, model), _ = asked(name)
            family = "boosting_fast" if name == "shap_boosted_adds_up" else "random_forest"
            assert settings(model) == settings(candidates.candidates(task.problem)[family])
            if name != "feature_importance":
                patch.setattr(compare.Task, "fit", lambda *_: None)
                patch.setattr(attribute, "make_explainer", stop)
                assert "background_rows" not in asked(name)[1]
