"""Aggregate expressions for moments and correlation, safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adjusted_skewness(x: Column) -> Column:
    """Bias-adjusted skewness: NULL below 3 values, 0 for a constant."""
    n = F.count(x).cast("double")
    g1 = F.when(F.stddev_pop(x) > 0, F.skewness(x)).otherwise(F.lit(0.0))
    return F.when(n >= 3, F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2))


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis: NULL below 4 values, 0 for a constant."""
    n = F.count(x).cast("double")
    adjusted = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when((n >= 4) & (F.stddev_pop(x) > 0), adjusted).when(n >= 4, F.lit(0.0))
