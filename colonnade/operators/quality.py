"""Missing cells and duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import col, nan_to_null, row_keys

# Fixed value: columns missing at least this many percent are of high risk.
HIGH_RISK_PCT = 40.0


def _missing_rows(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(c)).alias(f"present{i}") for i, c in enumerate(df.columns)],
    )
    return counts.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            (F.col("rows") - F.col(f"present{i}")).alias("n_missing"),
            F.col("rows").alias("n_rows"),
        )
        for i, c in enumerate(df.columns)
    ])))


def _pct(part, whole):
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 2), F.lit(0.0))


def missing_report(df: DataFrame) -> DataFrame:
    """``(column, n_missing, missing_pct)`` from one aggregate."""
    return _missing_rows(df).select("column", "n_missing", _pct(F.col("n_missing"), F.col("n_rows")).alias("missing_pct"))


def missing_total(df: DataFrame) -> DataFrame:
    """``(n_missing, n_cells, missing_pct)`` of the whole table."""
    return _missing_rows(df).agg(
        F.sum("n_missing").alias("n_missing"), F.sum("n_rows").alias("n_cells")
    ).select("n_missing", "n_cells", _pct(F.col("n_missing"), F.col("n_cells")).alias("missing_pct"))


def high_risk_columns(df: DataFrame, threshold_pct: float = HIGH_RISK_PCT) -> DataFrame:
    return missing_report(df).where(F.col("missing_pct") >= threshold_pct)


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(n_rows, n_duplicates, duplicate_pct)``: rows beyond the first of each group.

    Rows are grouped by their fixed-width columns and one digest of the rest.
    The count is combined before the shuffle, so a group holding a large share
    of the table costs one record per task.
    """
    df = nan_to_null(df)
    groups = df.groupBy(*row_keys(df, columns)).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    ).select("n_rows", "n_duplicates", _pct(F.col("n_duplicates"), F.col("n_rows")).alias("duplicate_pct"))


def duplicate_rows(df: DataFrame, key_cols: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The rows after the first (by key) of each group of equal rows; a missing key comes first.

    No group is ever brought together: the first key of each group comes from a combined minimum, and the duplicates are
    the rows with another key. Rows that are equal in their key as well, which a unique key does not have, are counted: all
    but one of those that come first are given, as copies of one of them.
    """
    df = nan_to_null(df)
    key_cols = list(key_cols)
    columns = list(columns or [c for c in df.columns if c not in key_cols])
    names = [f"__k{i}" for i in range(len(key_cols))]
    keys = [col(c).alias(n) for c, n in zip(key_cols, names)]
    content = F.sha2(F.to_json(F.struct(*row_keys(df, columns)), {"ignoreNullFields": "false"}), 256)
    marked = df.withColumn("__content", content)
    firsts = (
        marked.groupBy(F.col("__content").alias("__of")).agg(F.min(F.struct(*keys)).alias("first")).select("__of", "first.*")
    )

    def first_of(rows: DataFrame, how: str) -> DataFrame:
        same = F.col("__content") == F.col("__of")
        for c, n in zip(key_cols, names):
            same = same & col(c).eqNullSafe(F.col(n))
        return rows.join(firsts, same, how)

    later = first_of(marked, "left_anti").drop("__content")
    # Counted by digest and key first; the rows themselves are gathered only where there are several.
    several = marked.groupBy("__content", *[col(c) for c in key_cols]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    twins = first_of(several, "left_semi").select(F.col("__content").alias("__t"), *keys, "__n")
    same = F.col("__content") == F.col("__t")
    for c, n in zip(key_cols, names):
        same = same & col(c).eqNullSafe(F.col(n))
    copies = (
        marked.join(twins, same).groupBy("__t", *names)
        .agg(F.max("__n").alias("__n"), F.any_value(F.struct(*[col(c) for c in df.columns])).alias("row"))
        .select("row", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("__n"))))
    )
    return later.unionByName(copies.select("row.*"))
