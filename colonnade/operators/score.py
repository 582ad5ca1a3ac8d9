"""Scoring with a fitted pipeline; the same code serves tables and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import col
from colonnade.plans.steps import ColumnCheck

PREDICTION, PROBABILITY = "prediction", "prediction_probability"
_INPUT = "__input"


def required_columns(fitted: PipelineModel) -> list[str]:
    """The raw columns a fitted pipeline was trained on, in order."""
    for stage in fitted.stages:
        if isinstance(stage, ColumnCheck):
            return stage.learned
    raise ValueError("this pipeline does not say which columns it needs")


def score_batch(fitted: PipelineModel, df: DataFrame, outputs: Sequence[str] = (PREDICTION, PROBABILITY)) -> DataFrame:
    """All input columns, then ``prediction`` and, if the model has one, ``prediction_probability``.

    Missing columns are an error, further columns are kept and not looked at.
    """
    required = ColumnCheck.check(df, required_columns(fitted))
    # Preparation rewrites feature columns, so the input travels beside them.
    beside = df.select(F.struct(*[col(c) for c in df.columns]).alias(_INPUT), *[col(c) for c in required])
    scored = fitted.transform(beside)
    made = [c for c in outputs if c in scored.columns]
    kept = [F.col(_INPUT)[c].alias(c) for c in df.columns if c not in made]
    return scored.select(*kept, *[col(c) for c in made])
