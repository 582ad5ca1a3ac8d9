"""Outliers of the numerical columns by quartile fences and by z-score.

Pass 1 fits the bounds (a few numbers per column), pass 2 applies them as
literals, which also reach the scan as filters.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import INTEGER, col, kinds, nan_to_null
from colonnade.operators.quantiles import exact_quantiles
from colonnade.operators.roles import NUMERICAL, infer_roles, of_role

# Fixed values of the two methods.
FENCE = 1.5
Z_LIMIT = 3.0

REPORT = (
    "column string, n_present bigint, lower double, upper double, iqr_count bigint, iqr_pct double, "
    "zscore_count bigint, zscore_pct double"
)


@dataclass(frozen=True)
class Bounds:
    column: str
    lower: float | None
    upper: float | None
    mean: float | None
    std: float | None

    def beyond_fences(self) -> Column:
        x = col(self.column).cast("double")
        return (x < F.lit(self.lower)) | (x > F.lit(self.upper))

    def beyond_fences_as(self, kind: str) -> Column:
        """The same for integers without a cast, so that it reaches the reader."""
        if kind != INTEGER or self.lower is None:
            return self.beyond_fences()
        x = col(self.column)
        return (x < F.lit(math.ceil(self.lower))) | (x > F.lit(math.floor(self.upper)))

    def beyond_z(self) -> Column:
        if not self.std:
            return F.lit(False)
        return F.abs((col(self.column).cast("double") - F.lit(self.mean)) / F.lit(self.std)) > Z_LIMIT


def fit_bounds(
    df: DataFrame, roles: Mapping[str, str] | None = None, columns: Sequence[str] | None = None
) -> list[Bounds]:
    df = nan_to_null(df)
    if columns is None:
        columns = of_role(infer_roles(df) if roles is None else roles, NUMERICAL)
    columns = list(columns)
    if not columns:
        return []
    moments = df.agg(F.count(F.lit(1)), *[
        F.struct(F.avg(col(c).cast("double")).alias("mean"), F.stddev_samp(col(c).cast("double")).alias("std")).alias(f"m{i}")
        for i, c in enumerate(columns)
    ]).first()
    quartiles = exact_quantiles(df, columns, (0.25, 0.75), rows=moments[0])
    bounds = []
    for c, m in zip(columns, moments[1:]):
        q1, q3 = quartiles[c]
        lower, upper = (None, None) if q1 is None else (q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1))
        bounds.append(Bounds(c, lower, upper, m["mean"], m["std"]))
    return bounds


def outlier_report(df: DataFrame, bounds: Sequence[Bounds]) -> DataFrame:
    """Counts and shares by both methods for all columns in one pass."""
    if not bounds:
        return df.sparkSession.createDataFrame([], REPORT)
    df = nan_to_null(df)
    counts = df.agg(*[
        F.struct(
            F.lit(b.column).alias("column"), F.count(col(b.column)).alias("n_present"),
            F.lit(b.lower).cast("double").alias("lower"), F.lit(b.upper).cast("double").alias("upper"),
            F.count_if(b.beyond_fences()).alias("iqr_count"), F.count_if(b.beyond_z()).alias("zscore_count"),
        ).alias(f"o{i}")
        for i, b in enumerate(bounds)
    ])

    def pct(name: str) -> Column:
        return F.round(F.col(name) * 100.0 / F.greatest(F.col("n_present"), F.lit(1)), 2)

    return counts.select(F.inline(F.array(*[F.col(f"o{i}") for i in range(len(bounds))]))).select(
        "column", "n_present", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"),
        "iqr_count", pct("iqr_count").alias("iqr_pct"), "zscore_count", pct("zscore_count").alias("zscore_pct"),
    )


def outlier_rows(df: DataFrame, bounds: Sequence[Bounds], key_cols: Sequence[str]) -> DataFrame:
    """``(key..., column, value)`` of every value beyond its fences.

    One scan: rows without any outlier are filtered first, by comparisons that
    reach the parquet reader, and the rest unfold into a row per offending
    column. (NaN passes the first filter, being the largest value, and is gone
    before the second.)
    """
    keys = [col(c) for c in key_cols]
    if not bounds:
        return df.where(F.lit(False)).select(*keys, F.lit("").alias("column"), F.lit(0.0).alias("value"))
    kind = kinds(df)
    any_outlier = reduce(lambda a, b: a | b, [b.beyond_fences_as(kind[b.column]) for b in bounds])
    df = nan_to_null(df.where(any_outlier))
    cells = F.array(*[
        F.when(b.beyond_fences(), F.struct(F.lit(b.column).alias("column"), col(b.column).cast("double").alias("value")))
        for b in bounds
    ])
    return (
        df.select(*keys, F.explode(cells).alias("cell"))
        .where(F.col("cell").isNotNull())
        .select(*keys, "cell.column", "cell.value")
    )
