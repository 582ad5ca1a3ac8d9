"""Cross-validated comparison of candidates, leaderboard, choice and refit.

The preparation is fitted once per fold on that fold's training rows; its
output is kept for the fold and every candidate is fitted and scored on it.
Forests and boosting wait until all folds are prepared and are grown together,
folds and settings being keys of the same jobs. What reaches the driver is one
row of scores per candidate and fold; finished rows are written to a ledger, so
that a comparison that the cluster broke off goes on where it was.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, IllegalArgumentException, PySparkException
from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.columns import col, row_hash
from colonnade.operators.metrics import classification_scores, regression_scores
from colonnade.operators.roles import CLASSIFICATION, REGRESSION, problem_type
from colonnade.operators.split import FOLDS, SEED, with_folds
from colonnade.operators.validate import drop_missing_target
from colonnade.plans.candidates import Factory, Shape, candidates, with_columns_of_ours
from colonnade.plans.ensembles import PLACE, Folds, TreeFamily
from colonnade.plans.labels import LABEL, PREDICTION, LabelDecoder, Labels, indexed, sorted_labels
from colonnade.plans.prepare import feature_names, feature_roles, fit_preparation
from colonnade.session import scratch_path

log = logging.getLogger(__name__)

# The scores of each kind of problem, the deciding one first.
SCORES = {CLASSIFICATION: ("accuracy", "f1"), REGRESSION: ("neg_rmse", "r2")}
FOLD = "__fold"
# Parts that learners work on: at least so many, and of about so many rows.
LEAST_PARTS = 8
PART_ROWS = 500_000
FOLD_SCORES = "model string, fold int, metric string, score double, seconds double"


@dataclass
class Task:
    """One modelling task: a table, its target, and what was found out about them."""

    train: DataFrame
    target: str
    problem: str
    roles: dict[str, str]
    key_cols: tuple[str, ...]
    labels: Labels | None
    missing: str = "error"
    scaling: str = "standard"
    seed: int = SEED

    @classmethod
    def of(
        cls,
        train: DataFrame,
        target: str,
        key_cols: Sequence[str] = (),
        overrides: Mapping[str, str] | None = None,
        problem: str | None = None,
        scaling: str = "standard",
        missing: str = "error",
        seed: int = SEED,
    ) -> Task:
        train = drop_missing_target(train, target)
        problem = problem or problem_type(train, target)
        roles = feature_roles(train, overrides, [target, *key_cols])
        labels = sorted_labels(train, target) if problem == CLASSIFICATION else None
        train = train.select(*[col(c) for c in dict.fromkeys([*roles, *key_cols, target])])
        return cls(train, target, problem, roles, tuple(key_cols), labels, missing, scaling, seed)

    @property
    def primary(self) -> str:
        return SCORES[self.problem][0]

    def labelled(self, df: DataFrame) -> DataFrame:
        """Adds the number the models learn: a class index or the target itself."""
        if self.labels is not None:
            return indexed(df, self.target, self.labels)
        return df.withColumn(LABEL, col(self.target).cast("double"))

    def folded(self, folds: int, **beside: Column) -> DataFrame:
        """The training table with its folds, written once and partitioned by fold and by the columns given beside.

        Every fold reads it many times; written, it is read column by column and
        fold by fold, needs no recomputation and outlives lost executors.
        """
        stratify = self.target if self.problem == CLASSIFICATION else None
        placed = with_folds(self.train, folds, self.key_cols or None, self.seed, stratify, FOLD).withColumns(beside)
        spark, path = placed.sparkSession, scratch_path(placed.sparkSession, "folds")
        placed.write.partitionBy(FOLD, *beside).parquet(path)
        return spark.read.schema(placed.schema).parquet(path)

    def prepare(self, df: DataFrame) -> PipelineModel:
        return fit_preparation(df, self.roles, self.scaling, missing=self.missing)

    def vectors(self, prepared: PipelineModel, df: DataFrame) -> DataFrame:
        made = prepared.transform(self.labelled(df))
        return made.select(F.col(LABEL), F.col("features"), *[F.col(c) for c in (PLACE,) if c in made.columns])

    def kept_vectors(self, prepared: PipelineModel, df: DataFrame) -> DataFrame:
        """Persisted vectors, to be unpersisted by the caller."""
        return self.vectors(prepared, laid_out(df, self.key_cols, self.seed)).persist(StorageLevel.MEMORY_AND_DISK)

    def shape(self, vectors: DataFrame, prepared: PipelineModel) -> Shape:
        return Shape(vectors.count(), len(feature_names(prepared)), len(self.labels or ()))

    def scores(self, predictions: DataFrame) -> dict[str, float]:
        """The scores of this kind of problem, from one aggregation."""
        if self.problem == CLASSIFICATION:
            row = classification_scores(predictions, LABEL, PREDICTION).first()
            return {"accuracy": row["accuracy"], "f1": row["f1"]}
        row = regression_scores(predictions, LABEL, PREDICTION).first()
        return {"neg_rmse": -row["rmse"], "r2": row["r2"]}

    def fit(self, estimator: Factory | Estimator) -> PipelineModel:
        """Preparation, model and label decoding, fitted on all training rows."""
        prepared = self.prepare(self.train)
        vectors = self.kept_vectors(prepared, self.train)
        try:
            model = made(estimator, self.shape(vectors, prepared)).fit(vectors)
        finally:
            vectors.unpersist()
        decoder = LabelDecoder.for_target(self.train, self.target, self.labels)
        return PipelineModel([*prepared.stages, model, decoder])


def laid_out(df: DataFrame, key_cols: Sequence[str], seed: int) -> DataFrame:
    """The rows in parts and in an order that follow from their hashes and number alone.

    Learners sample within parts, so a fit would otherwise depend on how many files and cores there are. They pass over the
    rows many times, and this is one shuffle. Without key columns equal rows share a part: name keys where a few contents
    make up much of a table.
    """
    parts = max(LEAST_PARTS, -(-df.count() // PART_ROWS))
    placed = df.withColumn(PLACE, row_hash(df, key_cols or None, seed))
    return placed.repartition(parts, PLACE).sortWithinPartitions(PLACE)


def made(estimator: Factory | Estimator, shape: Shape) -> Estimator:
    return with_columns_of_ours(estimator if isinstance(estimator, Estimator) else estimator(shape))


# What the messages of errors say that come from the cluster and not from a model.
CLUSTER_SIGNS = (
    "ExecutorLost", "executor lost", "SparkContext was shut down", "stopped SparkContext", "cancelled", "FetchFailed", "Connection",
    "OutOfMemoryError", "No space left", "SparkContext has been shutdown", "Answer from Java side is empty",
)


def is_models_fault(error: Exception) -> bool:
    """Whether an error comes from a model's settings or data, so that the others can go on without it."""
    text = str(error)
    if isinstance(error, (ConnectionError, OSError, MemoryError)) or any(sign in text for sign in CLUSTER_SIGNS):
        return False
    if isinstance(error, (IllegalArgumentException, AnalysisException)):
        return True
    if isinstance(error, (PySparkException, Py4JError)):
        # Of what Spark reports, errors raised in its learners or in a task's Python code are the model's.
        return any(mark in text for mark in ("org.apache.spark.ml", "breeze.", "Traceback (most recent call last)"))
    return isinstance(error, (ValueError, TypeError, ArithmeticError, LookupError))


class Ledger:
    """Score rows that are finished, as a table that survives the session."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path, self.rows = spark, path or scratch_path(spark, "ledger"), []
        if path:
            try:
                self.rows = [tuple(r) for r in spark.read.schema(FOLD_SCORES).parquet(path).collect()]
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise

    def has(self, name: str, fold: int) -> bool:
        return any(r[0] == name and r[1] == fold for r in self.rows)

    def add(self, rows: Sequence[tuple]) -> None:
        if rows:
            self.rows += rows
            self.spark.createDataFrame(list(rows), FOLD_SCORES).coalesce(1).write.mode("append").parquet(self.path)


def cross_validate(
    task: Task, estimators: Mapping[str, Factory | Estimator], folds: int = FOLDS, parallelism: int = 1, resume: str | None = None
) -> list[tuple]:
    """Score rows of every estimator on every fold; one that fails is left out with a warning.

    Only errors of the estimator count as that. Others are raised; what was finished stands in a ledger, whose path the log
    names, and ``resume`` with that path does the rest. ``parallelism`` estimators are fitted side by side on the vectors of a
    fold; trees are grown together for all folds.
    """
    spark = task.train.sparkSession
    ledger, together = Ledger(spark, resume), Folds(spark)
    log.info("finished folds are kept in %s", ledger.path)
    folded = task.folded(folds)
    failed: set[str] = set()

    def skip(name: str, k: int, error: Exception) -> None:
        if not is_models_fault(error):
            raise RuntimeError(f"the comparison broke off at {name}, fold {k}; resume it with the ledger {ledger.path}") from error
        log.warning("candidate %s failed on fold %d and is skipped: %s", name, k, error)
        failed.add(name)

    for k in range(folds):
        if all(ledger.has(name, k) for name in estimators):
            continue
        training, held_out = folded.where(F.col(FOLD) != k).drop(FOLD), folded.where(F.col(FOLD) == k).drop(FOLD)
        prepared = task.prepare(training)
        seen = task.kept_vectors(prepared, training)
        unseen = task.kept_vectors(prepared, held_out)
        try:
            shape, present = task.shape(seen, prepared), {}
            for name in estimators:
                if name not in failed and not ledger.has(name, k):
                    try:
                        present[name] = made(estimators[name], shape)
                    except Exception as error:
                        skip(name, k, error)
            trees = {n: e for n, e in present.items() if isinstance(e, TreeFamily)}
            if trees:
                together.add(k, seen, unseen, trees)

            def one(name: str) -> list[tuple]:
                started = time.perf_counter()
                try:
                    scores = task.scores(present[name].fit(seen).transform(unseen))
                except Exception as error:
                    skip(name, k, error)
                    return []
                seconds = time.perf_counter() - started
                return [(name, k, metric, float(score), seconds) for metric, score in scores.items()]

            names = [n for n in present if n not in trees]
            if parallelism > 1:
                with ThreadPoolExecutor(parallelism) as pool:
                    found = list(pool.map(inheritable_thread_target(one), names))
            else:
                found = [one(n) for n in names]
            ledger.add([r for group in found for r in group])
        finally:
            seen.unpersist()
            unseen.unpersist()
    if together.names:
        scored = together.scores(task.labels is not None)
        ledger.add([(name, k, metric, float(scores[metric]), seconds) for k, name, scores, seconds in scored for metric in SCORES[task.problem]])
    order = {name: i for i, name in enumerate(estimators)}
    rows = [r for r in ledger.rows if r[0] in order and r[0] not in failed and r[1] < folds]
    return sorted(rows, key=lambda r: (r[1], order[r[0]]))


def compare_models(
    task: Task, models: Mapping[str, Factory | Estimator] | None = None, folds: int = FOLDS, parallelism: int = 1, resume: str | None = None
) -> DataFrame:
    """``(model, fold, metric, score, seconds)`` for every candidate; ``resume`` as in ``cross_validate``."""
    rows = cross_validate(task, models or candidates(task.problem), folds, parallelism, resume)
    return task.train.sparkSession.createDataFrame(rows, FOLD_SCORES)


def score_summary(fold_scores: DataFrame) -> DataFrame:
    """``(model, metric, mean, std, seconds)`` over folds, with the population deviation."""
    return fold_scores.groupBy("model", "metric").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.sum("seconds").alias("seconds")
    )


def leaderboard(fold_scores: DataFrame, problem: str) -> DataFrame:
    """One row per model, best first by the deciding score, equal ones by name."""
    metrics = SCORES[problem]
    parts = [F.max("seconds").alias("fit_seconds")]
    for m in metrics:
        parts += [
            F.round(F.max(F.when(F.col("metric") == m, F.col("mean"))), 4).alias(m),
            F.round(F.max(F.when(F.col("metric") == m, F.col("std"))), 4).alias(f"{m}_std"),
        ]
    return score_summary(fold_scores).groupBy("model").agg(*parts).orderBy(F.col(metrics[0]).desc(), "model")


def best_model(fold_scores: DataFrame, problem: str) -> str:
    """Name of the best model by the mean of the deciding score; the first name wins a tie."""
    primary = score_summary(fold_scores).where(F.col("metric") == SCORES[problem][0])
    best = primary.orderBy(F.col("mean").desc(), "model").first()
    if best is None:
        raise ValueError("no candidate has a score")
    return best["model"]


def fit_best(
    task: Task, fold_scores: DataFrame, models: Mapping[str, Factory | Estimator] | None = None
) -> tuple[str, PipelineModel]:
    """The winner, refitted with its preparation on all training rows."""
    name = best_model(fold_scores, task.problem)
    return name, task.fit((models or candidates(task.problem))[name])


def held_out_score(fitted: PipelineModel, test: DataFrame, target: str, problem: str) -> DataFrame:
    """Accuracy or R2 on rows the model has not seen: ``(metric, score)``."""
    from colonnade.operators.score import score_batch

    scored = score_batch(fitted, drop_missing_target(test, target))
    if problem == CLASSIFICATION:
        return classification_scores(scored, target, "prediction").select(
            F.lit("accuracy").alias("metric"), F.col("accuracy").alias("score"))
    return regression_scores(scored, target, "prediction").select(F.lit("r2").alias("metric"), F.col("r2").alias("score"))
