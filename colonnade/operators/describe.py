"""Descriptive statistics: numbers by moments and quantiles, the rest by value counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import OTHER, col, kinds, nan_to_null
from colonnade.functions.moments import adjusted_kurtosis, adjusted_skewness
from colonnade.operators.profile import frequent_values, modes, value_histogram
from colonnade.operators.quantiles import DIRECT_CELLS, exact_quantiles, linear_percentile
from colonnade.operators.roles import NUMERICAL, UNSUPPORTED, infer_roles, of_role
from colonnade.session import scratch_path

# Fixed values of the report.
TOP_VALUES = 10
QUARTILES = (0.25, 0.5, 0.75)

NUMERIC_SUMMARY = (
    "column string, n_present bigint, mean double, std double, min double, q25 double, "
    "median double, q75 double, max double, skewness double, kurtosis double"
)
CATEGORICAL_SUMMARY = "column string, n_present bigint, n_distinct bigint, mode string, mode_count bigint"


def table_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


def numeric_summary(df: DataFrame, roles: Mapping[str, str] | None = None, approximate: bool = False) -> DataFrame:
    """One row per column of role numerical; unrounded doubles.

    Little data takes one aggregate. Beyond the checked size the quantiles are
    narrowed down first (``approximate=True`` uses a sketch instead) and the
    moments stay one aggregate.
    """
    df = nan_to_null(df)
    roles = infer_roles(df) if roles is None else roles
    names = of_role(roles, NUMERICAL)
    if not names:
        return df.sparkSession.createDataFrame([], NUMERIC_SUMMARY)
    numbers = {c: col(c).cast("double") for c in names}
    if approximate:
        quartiles = {c: F.percentile_approx(x, list(QUARTILES), 10_000) for c, x in numbers.items()}
    else:
        rows = df.count()
        if rows * len(names) <= DIRECT_CELLS:
            quartiles = {c: linear_percentile(x, QUARTILES) for c, x in numbers.items()}
        else:
            found = exact_quantiles(df, names, QUARTILES, rows)
            quartiles = {c: F.array(*[F.lit(v).cast("double") for v in found[c]]) for c in names}
    summary = df.agg(*[
        F.struct(
            F.lit(c).alias("column"), F.count(x).alias("n_present"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.min(x).alias("min"), quartiles[c].alias("quartiles"),
            F.max(x).alias("max"), adjusted_skewness(x).alias("skewness"), adjusted_kurtosis(x).alias("kurtosis"),
        ).alias(f"s{i}")
        for i, (c, x) in enumerate(numbers.items())
    ])
    long = summary.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))])))
    return long.select(
        "column", "n_present", "mean", "std", "min",
        *[F.col("quartiles")[i].alias(q) for i, q in enumerate(("q25", "median", "q75"))],
        "max", "skewness", "kurtosis",
    )


def described_by_values(df: DataFrame, roles: Mapping[str, str]) -> list[str]:
    kind = kinds(df)
    return [c for c, role in roles.items() if role not in (NUMERICAL, UNSUPPORTED) and kind[c] != OTHER]


def categorical_summary(df: DataFrame, roles: Mapping[str, str] | None = None) -> DataFrame:
    """Distinct values and the mode of every column that is not numerical."""
    df = nan_to_null(df)
    roles = infer_roles(df) if roles is None else roles
    names = described_by_values(df, roles)
    if not names:
        return df.sparkSession.createDataFrame([], CATEGORICAL_SUMMARY)
    # Counted once: the totals and the modes both follow from it.
    path = scratch_path(df.sparkSession, "histogram")
    value_histogram(df, names, prefix=True).write.parquet(path)
    counted = df.sparkSession.read.parquet(path)
    totals = counted.groupBy("column").agg(F.sum("n").alias("n_present"), F.count(F.lit(1)).alias("n_distinct"))
    best = frequent_values(df, names, 1, counted).select("column", F.col("value").alias("mode"), F.col("n").alias("mode_count"))
    return totals.join(best, "column")


def top_values(df: DataFrame, roles: Mapping[str, str] | None = None, top: int = TOP_VALUES) -> DataFrame:
    """``(column, rank, value, n)``: the most frequent values, equal counts by value.

    The rank limit is applied inside every task before the shuffle, and long
    texts are not shuffled but for those that are among the first.
    """
    df = nan_to_null(df)
    roles = infer_roles(df) if roles is None else roles
    names = described_by_values(df, roles)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string, n bigint")
    return frequent_values(df, names, top)


def column_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_present, n_missing, missing_pct)`` from one aggregate."""
    df = nan_to_null(df)
    columns = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(col(c)).alias(f"p{i}") for i, c in enumerate(columns)])
    rows = F.col("rows")
    return counts.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(f"p{i}").alias("n_present"), (rows - F.col(f"p{i}")).alias("n_missing"),
            F.coalesce(F.round(F.try_divide((rows - F.col(f"p{i}")) * 100.0, rows), 2), F.lit(0.0)).alias("missing_pct"),
        )
        for i, c in enumerate(columns)
    ])))


__all__ = [
    "table_size", "numeric_summary", "categorical_summary", "top_values", "column_counts", "modes",
]
