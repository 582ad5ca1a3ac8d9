"""Candidate model families per kind of problem, with their defaults and search spaces."""

from __future__ import annotations

import logging
import random
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from itertools import product

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import col
from colonnade.operators.roles import CLASSIFICATION, REGRESSION
from colonnade.plans.ensembles import TreeBoosting, TreeForest
from colonnade.plans.labels import LABEL, PREDICTION, PROBABILITY, RAW
from colonnade.plans.logistic import MOST_WEIGHTS, LogisticNewton
from colonnade.plans.steps import _Fitted

log = logging.getLogger(__name__)

# Fixed values of the candidates.
SEED = 42
LOGISTIC_ITERATIONS = 2000
LOGISTIC_C = 1.0
FOREST_TREES = 200
NETWORK_LAYERS = (32, 16)
NETWORK_ITERATIONS = 30
NETWORK_BLOCK = 32

# Forests need a finite depth.
FOREST_DEPTH = 10

# Three ways to spend a boosting budget: few deep steps, many careful ones, a long run.
BOOSTING_PRESETS = {
    "boosting_fast": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3},
    "boosting_steady": {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1},
    "boosting_long": {"maxIter": 300, "maxDepth": 6, "stepSize": 0.03},
}


@dataclass(frozen=True)
class Shape:
    """What a family has to know about the training data."""

    rows: int
    features: int
    classes: int = 0


Factory = Callable[[Shape], Estimator]


def _logistic(shape: Shape, c: float = LOGISTIC_C, **params) -> Estimator:
    penalty = 1.0 / (c * max(shape.rows, 1))
    if (shape.features + 1) * (shape.classes if shape.classes > 2 else 1) <= MOST_WEIGHTS:
        return LogisticNewton(maxIter=LOGISTIC_ITERATIONS, regParam=penalty, classes=shape.classes, **params)
    # The same minimum, without a number for each pair of weights.
    return LogisticRegression(maxIter=LOGISTIC_ITERATIONS, regParam=penalty, elasticNetParam=0.0, standardization=False, **params)


def _network(shape: Shape) -> Estimator:
    return MultilayerPerceptronClassifier(
        layers=[shape.features, *NETWORK_LAYERS, max(shape.classes, 2)], maxIter=NETWORK_ITERATIONS,
        blockSize=NETWORK_BLOCK, seed=SEED,
    )


def _forest(problem: str) -> Callable[..., Estimator]:
    def make(shape: Shape, **params) -> Estimator:
        subset = {"classes": shape.classes, "featureSubset": "sqrt"} if problem == CLASSIFICATION else {"featureSubset": "all"}
        return TreeForest(**{"numTrees": FOREST_TREES, "maxDepth": FOREST_DEPTH, "seed": SEED, **subset, **params})

    return make


def _boosting(problem: str, preset: str) -> Callable[..., Estimator]:
    def make(shape: Shape, **params) -> Estimator:
        classes = shape.classes if problem == CLASSIFICATION else 0
        return TreeBoosting(**{"classes": classes, "seed": SEED, **BOOSTING_PRESETS[preset], **params})

    return make


def candidates(problem: str) -> dict[str, Factory]:
    """The families compared for a kind of problem, in a fixed order."""
    if problem not in (CLASSIFICATION, REGRESSION):
        raise ValueError(f"unknown problem {problem!r}")
    families: dict[str, Factory] = (
        {"logistic_regression": _logistic} if problem == CLASSIFICATION
        else {"linear_regression": lambda shape: LinearRegression(regParam=0.0, solver="normal")}
    )
    families["random_forest"] = _forest(problem)
    families.update({name: _boosting(problem, name) for name in BOOSTING_PRESETS})
    if problem == CLASSIFICATION:
        families["neural_network"] = _network
    else:
        log.warning("no neural network for regression; candidate skipped")
    return families


def with_columns_of_ours(estimator: Estimator) -> Estimator:
    """A copy that reads and writes the library's work columns."""
    ours = {"featuresCol": "features", "labelCol": LABEL, "predictionCol": PREDICTION,
            "probabilityCol": PROBABILITY, "rawPredictionCol": RAW}
    copy = estimator.copy()
    if isinstance(copy, OneVsRest):
        # It reads the raw column of its inner models under their own name.
        del ours["rawPredictionCol"]
    copy._set(**{name: value for name, value in ours.items() if copy.hasParam(name)})
    return copy


class Baseline(Estimator):
    """The most frequent label, or the mean: what a candidate has to beat."""

    def __init__(self, problem: str):
        super().__init__()
        self.problem = problem

    def _fit(self, df: DataFrame) -> BaselineModel:
        y = col(LABEL)
        best = F.mode(y, True) if self.problem == CLASSIFICATION else F.avg(y)
        return BaselineModel.of(df.agg(best.cast("double")).first()[0])


class BaselineModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PREDICTION, F.lit(self.learned).cast("double"))


@dataclass(frozen=True)
class Whole:
    """Whole numbers from ``low`` up to, not including, ``high``."""

    low: int
    high: int

    def draw(self, source: random.Random) -> int:
        return source.randrange(self.low, self.high)


@dataclass(frozen=True)
class Span:
    """Real numbers from ``low`` over ``width``."""

    low: float
    width: float

    def draw(self, source: random.Random) -> float:
        return self.low + self.width * source.random()


_BOOSTING_SPACE = {
    "maxIter": Whole(100, 500), "maxDepth": Whole(3, 12), "stepSize": Span(0.01, 0.29), "subsamplingRate": Span(0.6, 0.4),
}

# What random search draws from.
SEARCH_SPACES: dict[str, dict[str, Whole | Span]] = {
    "random_forest": {"numTrees": Whole(100, 500), "maxDepth": Whole(3, 20), "minInstancesPerNode": Whole(1, 10)},
    "boosting_fast": _BOOSTING_SPACE,
    "boosting_steady": _BOOSTING_SPACE,
    "boosting_long": {"maxIter": Whole(100, 500), "maxDepth": Whole(3, 10), "stepSize": Span(0.01, 0.29)},
    "logistic_regression": {"c": Span(0.01, 9.99)},
    "linear_regression": {},
}

# Lists for grid search.
GRIDS: dict[str, dict[str, list]] = {
    "random_forest": {"numTrees": [100, 300], "maxDepth": [5, 10, 15]},
    "boosting_fast": {"maxIter": [100, 300], "maxDepth": [3, 6], "stepSize": [0.1, 0.3]},
    "boosting_steady": {"maxIter": [100, 300], "maxDepth": [3, 6], "stepSize": [0.05, 0.1]},
    "boosting_long": {"maxIter": [300, 500], "maxDepth": [4, 6], "stepSize": [0.03]},
    "logistic_regression": {"c": [0.01, 0.1, 1.0, 10.0]},
    "linear_regression": {},
}


def search_space(name: str) -> dict[str, Whole | Span]:
    return SEARCH_SPACES.get(name, {})


def draws(space: Mapping[str, Whole | Span | list], count: int, seed: int = SEED) -> list[dict]:
    """Seeded random draws; a list is drawn from evenly."""
    source = random.Random(seed)
    return [
        {k: source.choice(v) if isinstance(v, list) else v.draw(source) for k, v in space.items()}
        for _ in range(count)
    ]


def grid(space: Mapping[str, list]) -> list[dict]:
    """Every combination of the lists."""
    unlisted = [k for k, v in space.items() if not isinstance(v, list)]
    if unlisted:
        raise ValueError(f"grid search needs lists, not ranges: {', '.join(unlisted)}")
    return [dict(zip(space, values)) for values in product(*space.values())]


__all__ = ["Model", "Shape", "candidates", "Baseline", "search_space", "draws", "grid"]
