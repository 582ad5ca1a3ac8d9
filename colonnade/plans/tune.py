"""Random and grid search for one family."""

from __future__ import annotations

import inspect
import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel

from colonnade.operators.split import FOLDS, SEED
from colonnade.plans.candidates import Factory, Shape, draws, grid, search_space
from colonnade.plans.compare import Task, cross_validate

# Fixed value: combinations tried by random search.
DRAWS = 25
METHODS = ("randomized", "grid")


@dataclass(frozen=True)
class Tuned:
    model: str
    method: str
    score: float
    params: dict
    fitted: PipelineModel
    tried: int


def tune(
    task: Task,
    name: str,
    model: Factory | Estimator,
    method: str = "randomized",
    space: Mapping | None = None,
    count: int = DRAWS,
    folds: int = FOLDS,
    parallelism: int = 1,
    seed: int = SEED,
    resume: str | None = None,
) -> Tuned:
    """Searches the space of a family on shared folds and refits the best combination.

    A family without a space is fitted with its defaults. The preparation of a
    fold is fitted once and serves all combinations. ``resume`` as in ``cross_validate``.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}, not {method!r}")
    space = search_space(name) if space is None else space
    if not space:
        return Tuned(name, "none", math.nan, {}, task.fit(model), 0)
    tried = draws(space, count, seed) if method == "randomized" else grid(space)
    variants = {str(i): with_params(model, params) for i, params in enumerate(tried)}
    totals: dict[str, list[float]] = {}
    for variant, _, metric, score, _ in cross_validate(task, variants, folds, parallelism, resume):
        if metric == task.primary:
            totals.setdefault(variant, []).append(score)
    if not totals:
        raise ValueError(f"no combination of {name} could be fitted")
    means = {v: sum(scores) / len(scores) for v, scores in totals.items()}
    best = min(means, key=lambda v: (-means[v], int(v)))
    return Tuned(name, method, means[best], tried[int(best)], task.fit(variants[best]), len(tried))


def with_params(model: Factory | Estimator, params: Mapping) -> Factory:
    """The family with some settings replaced."""

    def make(shape: Shape) -> Estimator:
        if isinstance(model, Estimator):
            return model.copy({model.getParam(k): v for k, v in params.items()})
        accepts = inspect.signature(model).parameters
        if all(k in accepts for k in params) or any(p.kind is p.VAR_KEYWORD for p in accepts.values()):
            return model(shape, **params)
        estimator = model(shape)
        return estimator.copy({estimator.getParam(k): v for k, v in params.items()})

    return make
