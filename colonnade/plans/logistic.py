"""Logistic regression by Newton's method: one aggregate a step, and few steps.

Each step sums up loss, slope and curvature over all rows in one pass. The objective is strictly convex, so the steps end at
its one minimum, also where classes are all but separable and first-order methods take thousands of passes. A step that does
not lower the loss is halved.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import TASK_GROUPS
from colonnade.plans.labels import LABEL, PREDICTION, PROBABILITY
from colonnade.plans.steps import _Fitted

# Half the last step's promise of a lower loss, per row, at which the steps end.
ENOUGH = 1e-12
# Keeps intercepts finite and, of several classes, unique.
INTERCEPT_PENALTY = 1e-9
# Weights up to which the curvature, a number for each pair of them, is added up.
MOST_WEIGHTS = 2_000


class LogisticNewton(Estimator):
    """Minimises the mean log-loss and half ``regParam`` times the squared coefficients; intercepts are free."""

    regParam = Param(Params._dummy(), "regParam", "penalty on squared coefficients", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "steps at most", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    fitIntercept = Param(Params._dummy(), "fitIntercept", "whether there is an intercept", TypeConverters.toBoolean)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(regParam=0.0, maxIter=2000, classes=2, fitIntercept=True)
        self._set(**params)

    def _fit(self, df: DataFrame) -> LogisticModel:
        get = self.getOrDefault
        outputs = get(self.classes) if get(self.classes) > 2 else 1
        rows = df.select(F.col(LABEL).cast("double").alias("y"), vector_to_array("features").alias("x"))
        width = len(df.select("features").first()["features"]) + 1
        penalty = np.full(width, max(get(self.regParam), INTERCEPT_PENALTY))
        penalty[-1] = INTERCEPT_PENALTY
        weights = np.zeros((outputs, width))
        free = np.ones(width, bool)
        free[-1] = get(self.fitIntercept)
        loss, slope, curve = _sums(rows, weights, penalty)
        for _ in range(get(self.maxIter)):
            some = np.tile(free, outputs)
            step = np.zeros(weights.size)
            step[some] = np.linalg.lstsq(curve[np.ix_(some, some)], slope[some], rcond=1e-14)[0]
            promise = float(step @ slope)
            if promise < ENOUGH:
                break
            part = 1.0
            while True:
                new = weights - part * step.reshape(weights.shape)
                found = _sums(rows, new, penalty)
                if found[0] <= loss or part < 1e-6:
                    break
                part /= 2
            if found[0] > loss:
                break
            weights, (loss, slope, curve) = new, found
        if outputs > 1:
            weights[:, -1] -= weights[:, -1].mean()
        return LogisticModel.of({"weights": weights.tolist()})


def _sums(rows: DataFrame, weights: np.ndarray, penalty: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss, its slope and its curvature at ``weights``, the penalty included."""
    outputs, width = weights.shape
    size = weights.size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(2 + size + size * size)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            y = batch.column("y").to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, width - 1), np.ones(n)])
            margins = x @ weights.T
            if outputs == 1:
                p = 1.0 / (1.0 + np.exp(-margins))
                total[1] += np.logaddexp(0.0, np.where(y == 1, -margins[:, 0], margins[:, 0])).sum()
                off = p - y[:, None]
            else:
                top = margins.max(axis=1, keepdims=True)
                e = np.exp(margins - top)
                p = e / e.sum(axis=1, keepdims=True)
                mine = y.astype(int)
                total[1] += (np.log(e.sum(axis=1)) + top[:, 0] - margins[np.arange(n), mine]).sum()
                off = p - np.eye(outputs)[mine]
            total[0] += n
            total[2:2 + size] += (off.T @ x).ravel()
            curve = np.empty((outputs, width, outputs, width))
            for a in range(outputs):
                for b in range(a + 1):
                    bend = p[:, a] * ((a == b) - p[:, b])
                    curve[a, :, b, :] = (x * bend[:, None]).T @ x
                    curve[b, :, a, :] = curve[a, :, b, :].T
            total[2 + size:] += curve.ravel()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    def merged(found: pa.Table) -> pa.Table:
        found = found.sort_by("part")
        total = sum(np.frombuffer(b.as_py()) for b in found.column("total"))
        return pa.table({"part": found.column("part")[:1], "total": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, "part int, total binary")
    if rows.rdd.getNumPartitions() > TASK_GROUPS:
        parts = parts.withColumn("group", F.col("part") % TASK_GROUPS).groupBy("group").applyInArrow(lambda t: merged(t.drop(["group"])), "part int, total binary")
    # A row for each task, or for each group of tasks.
    total = sum(np.frombuffer(r["total"]) for r in sorted(parts.collect(), key=lambda r: r["part"]))
    n, every = total[0], np.tile(penalty, outputs)
    flat = weights.ravel()
    curve = total[2 + size:].reshape(size, size) / n + np.diag(every)
    return total[1] / n + 0.5 * float(every @ (flat * flat)), total[2:2 + size] / n + every * flat, curve


class LogisticModel(_Fitted):
    """Adds the class probabilities and the likeliest class, as column expressions."""

    @property
    def coefficientMatrix(self) -> DenseMatrix:
        weights = np.array(self.learned["weights"])[:, :-1]
        return DenseMatrix(*weights.shape, weights.T.ravel())

    def _transform(self, df: DataFrame) -> DataFrame:
        weights = self.learned["weights"]
        x = vector_to_array(F.col("features"))

        def margin(row: list[float]):
            # One pass over the features, in their order.
            total = F.aggregate(F.zip_with("__x", F.array(*[F.lit(w) for w in row[:-1]]), lambda a, b: a * b), F.lit(row[-1]), lambda s, v: s + v)
            return total

        out = df.withColumn("__x", x)
        if len(weights) == 1:
            p = 1.0 / (1.0 + F.exp(-margin(weights[0])))
            out = out.withColumn("__p", p).withColumn("__shares", F.array(1 - F.col("__p"), F.col("__p"))).drop("__p")
        else:
            out = out.withColumn("__m", F.array(*[margin(row) for row in weights]))
            out = out.withColumn("__m", F.transform("__m", lambda m: F.exp(m - F.array_max("__m"))))
            out = out.withColumn("__shares", F.transform("__m", lambda m: m / F.aggregate("__m", F.lit(0.0), lambda s, v: s + v))).drop("__m")
        best = F.array_position("__shares", F.array_max("__shares")) - 1
        return out.withColumn(PROBABILITY, array_to_vector("__shares")).withColumn(PREDICTION, best.cast("double")).drop("__x", "__shares")
