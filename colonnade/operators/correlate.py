"""Pearson correlation of the numerical columns, in long form.

Every task keeps the moments of all pairs of columns about the pairs' own means
and merges them batch by batch; the tasks' moments are merged by a groupBy.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import TASK_GROUPS, col, nan_to_null
from colonnade.operators.roles import NUMERICAL, infer_roles, of_role

# Fixed value: pairs at least this strongly correlated are reported.
STRONG = 0.8

PAIRS = "col_a string, col_b string, corr double"


def correlation_pairs(
    df: DataFrame, roles: Mapping[str, str] | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """``(col_a, col_b, corr)`` for every pair, in schema order; NULL where undefined."""
    df = nan_to_null(df)
    if columns is None:
        columns = of_role(infer_roles(df) if roles is None else roles, NUMERICAL)
    columns = list(columns)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], PAIRS)
    return _pairwise(df, columns)


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    """The full square in long form: both orders of every pair and the diagonal."""
    mirrored = pairs.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr")
    both = pairs.select("col_a", "col_b", "corr").unionByName(mirrored)
    diagonal = both.groupBy("col_a").agg(
        F.when(F.count("corr") > 0, F.lit(1.0)).alias("corr")
    ).select("col_a", F.col("col_a").alias("col_b"), "corr")
    return both.unionByName(diagonal)


def strong_pairs(pairs: DataFrame, threshold: float = STRONG) -> DataFrame:
    """Pairs at or above the threshold in absolute value, strongest first."""
    return (
        pairs.where(F.abs("corr") >= threshold)
        .orderBy(F.abs("corr").desc(), "col_a", "col_b")
        .select("col_a", "col_b", F.round("corr", 4).alias("corr"))
    )


def target_ranking(pairs: DataFrame, target: str) -> DataFrame:
    """``(column, corr)`` of every other column with the target, strongest first.

    Empty unless the target is among the correlated columns.
    """
    other = F.when(F.col("col_a") == target, F.col("col_b")).otherwise(F.col("col_a"))
    return (
        pairs.where((F.col("col_a") == target) | (F.col("col_b") == target))
        .select(other.alias("column"), F.round("corr", 4).alias("corr"))
        .orderBy(F.abs("corr").desc_nulls_last(), "column")
    )


def _moments(x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per pair (a, b) over the rows where both are present: n, mean of b, squares of b, products; centred in two passes."""
    n = there.T.astype(float) @ there
    whole = there.all(axis=0)
    full = np.where(there, x, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, (there.T.astype(float) @ full) / n, 0.0)
    centre = np.where(whole, full.mean(axis=0), 0.0)
    d = np.where(there, x - centre, 0.0)
    d[:, ~whole] = 0.0
    products = d.T @ d
    squares = np.broadcast_to(np.diag(products), n.shape).copy()
    # Pairs with missing values are centred by their own means.
    holes = np.flatnonzero(~whole)
    for a in range(x.shape[1]):
        others = holes if whole[a] else np.arange(x.shape[1])
        rows = there[:, a]
        if not len(others) or not rows.any():
            products[a, others] = squares[a, others] = 0.0
            continue
        both = there[np.ix_(rows, others)]
        db = np.where(both, x[np.ix_(rows, others)] - mean[a, others], 0.0)
        da = np.where(both, x[rows, a][:, None] - mean[others, a], 0.0)
        squares[a, others] = (db * db).sum(axis=0)
        products[a, others] = (da * db).sum(axis=0)
        if whole[a]:
            squares[others, a] = (da * da).sum(axis=0)
            products[others, a] = products[a, others]
    return n, mean, squares, products


def _merged(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], mean_a: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Moments of both sets of rows from the moments of each."""
    n = one[0] + two[0]
    weight = np.divide(two[0], n, out=np.zeros_like(n), where=n > 0)
    step = two[1] - one[1]
    both = one[0] * weight
    return n, one[1] + step * weight, one[2] + two[2] + step * step * both, one[3] + two[3] + step * (mean_a[1] - mean_a[0]) * both


def _merge_squares(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    return _merged(one, two, (one[1].T, two[1].T))


def _pairwise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every pair from moments that are merged within each task, then in groups of tasks, then once more.

    A row of the moments of one column with all others travels, so what is shuffled grows with the number of columns and of
    tasks, not with the rows.
    """
    columns = list(columns)
    k = len(columns)
    numbers = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    parts = ("n", "mean", "other", "squares", "products")
    shape = "a int, " + ", ".join(f"{p} array<double>" for p in parts)

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            found = _moments(x, ~np.isnan(x))
            total = found if total is None else _merge_squares(total, found)
        if total is not None:
            n, mean, squares, products = total
            yield pd.DataFrame({
                "a": range(k), "n": list(n), "mean": list(mean), "other": list(mean.T.copy()), "squares": list(squares), "products": list(products),
            })

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(np.array(v, dtype=float) for v in r) for r in group[list(parts)].itertuples(index=False)]
        n, mean, other, squares, products = rows[0]
        for n2, mean2, other2, squares2, products2 in rows[1:]:
            weight = np.divide(n2, n + n2, out=np.zeros_like(n), where=n + n2 > 0)
            moved = _merged((n, mean, squares, products), (n2, mean2, squares2, products2), (other, other2))
            other = other + (other2 - other) * weight
            n, mean, squares, products = moved
        return pd.DataFrame({"a": [group["a"].iloc[0]], "n": [n], "mean": [mean], "other": [other], "squares": [squares], "products": [products]})

    moments = numbers.mapInPandas(collect, shape).withColumn("tasks", F.spark_partition_id() % TASK_GROUPS)
    grouped = moments.groupBy("a", "tasks").applyInPandas(merge, shape).groupBy("a").applyInPandas(merge, shape)
    names = F.array(*[F.lit(c) for c in columns])
    one = grouped.select("a", F.posexplode(F.arrays_zip("n", "mean", "squares", "products")).alias("b", "m")).select("a", "b", "m.*")
    # A constant's squares are rounding noise of its mean.
    noise = F.col("n") * F.pow(F.lit(1e-15) * F.col("mean"), 2)
    one = one.select("a", "b", "products", F.when(F.col("squares") > noise, F.col("squares")).alias("squares"))
    mirrored = one.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("squares").alias("squares_a"))
    pairs = one.where(F.col("a") < F.col("b")).join(mirrored, ["a", "b"])
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("a")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("a") < F.col("b"))
    spread = F.sqrt("squares") * F.sqrt("squares_a")
    corr = F.when(spread > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("products") / spread)))
    return every.join(pairs, ["a", "b"], "left").orderBy("a", "b").select(
        names[F.col("a")].alias("col_a"), names[F.col("b")].alias("col_b"), corr.alias("corr")
    )
