"""Validation rules on a table and on a target column.

Every rule that fires is a row ``(rule, severity, column, value, message)``.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import OTHER, as_text, col, kind_of, kinds, nan_to_null
from colonnade.operators.quality import duplicate_count

ERROR, WARNING = "error", "warning"
FINDING = "rule string, severity string, column string, value double, message string"

# Fixed values of the rules.
MIN_ROWS = 10
MIN_COLUMNS = 2
NULL_SHARE = 0.5


def _finding(rule: str, severity: str, column: str | None, value: Column, message: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
        F.lit(column).cast("string").alias("column"), value.cast("double").alias("value"), message.alias("message"),
    )


def _fired(facts: DataFrame, findings: list[Column]) -> DataFrame:
    return facts.select(F.inline(F.array_compact(F.array(*findings))))


def _positional(df: DataFrame) -> DataFrame:
    """Columns renamed by position, so that repeated names can be counted too."""
    return nan_to_null(df.toDF(*[f"c{i}" for i in range(len(df.columns))]))


def validate_table(df: DataFrame) -> DataFrame:
    """All table rules; no rows means nothing to complain about."""
    names, plain = list(df.columns), _positional(df)
    facts = plain.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(F.col(c)).alias(c) for c in plain.columns]
    )
    rows = F.col("rows")
    findings = [
        F.when(rows < MIN_ROWS, _finding(
            "min_rows", ERROR, None, rows, F.format_string(f"%d rows; at least {MIN_ROWS} rows are needed", rows)))
    ]
    for c, name in zip(plain.columns, names):
        share = F.try_divide(rows - F.col(c), rows)
        findings += [
            F.when(F.col(c) == 0, _finding(
                "empty_column", ERROR, name, rows, F.lit(f"column {name} is entirely empty"))),
            F.when(share > NULL_SHARE, _finding(
                "mostly_missing", WARNING, name, share, F.lit(f"column {name} is missing in more than half of the rows"))),
        ]
    repeats = duplicate_count(plain).where(F.col("n_duplicates") > 0).select(
        F.inline(F.array(_finding(
            "duplicate_rows", WARNING, None, F.col("n_duplicates"),
            F.format_string("%d duplicate rows (%.1f%%)", F.col("n_duplicates"),
                            F.col("n_duplicates") * 100.0 / F.col("n_rows")))))
    )
    known = []
    if len(names) < MIN_COLUMNS:
        known.append(("min_columns", ERROR, None, float(len(names)), "a feature column and a target column are needed"))
    for name, times in Counter(names).items():
        if times > 1:
            known.append(("repeated_name", ERROR, name, float(times), f"column name {name} occurs {times} times"))
    report = _fired(facts, findings).unionByName(repeats)
    if known:
        report = report.unionByName(df.sparkSession.createDataFrame(known, FINDING))
    return report


def validate_target(df: DataFrame, target: str) -> DataFrame:
    """Rules on one target column; an absent column is the only finding then."""
    if target not in df.columns:
        return df.sparkSession.createDataFrame(
            [("target_absent", ERROR, target, None, f"{target} is not a column of this table")], FINDING)
    clean = nan_to_null(df.select(col(target)))
    kind = kinds(clean)[target]
    y = as_text(target, kind) if kind != OTHER else F.to_json(F.struct(col(target)))
    # One distinct value means that the smallest and the largest are the same.
    facts = clean.agg(
        F.count(F.lit(1)).alias("rows"), F.count(col(target)).alias("present"),
        F.min(y).alias("low"), F.max(y).alias("high"),
    )
    missing = F.col("rows") - F.col("present")
    return _fired(facts, [
        F.when(missing > 0, _finding(
            "target_missing", WARNING, target, missing,
            F.format_string(f"target {target.replace('%', '%%')} is missing in %d rows, which are dropped before training", missing))),
        F.when(F.col("present") == 0, _finding(
            "target_constant", ERROR, target, F.lit(0), F.lit(f"target {target} has no value"))),
        F.when(F.col("low") == F.col("high"), _finding(
            "target_constant", ERROR, target, F.lit(1), F.lit(f"target {target} has a single value"))),
    ])


def verdict(report: DataFrame) -> DataFrame:
    """``(is_valid, n_errors, n_warnings)``: valid means no error."""
    errors = F.count_if(F.col("severity") == ERROR)
    return report.agg(
        (errors == 0).alias("is_valid"), errors.alias("n_errors"),
        F.count_if(F.col("severity") == WARNING).alias("n_warnings"),
    )


def is_valid(report: DataFrame) -> bool:
    return report.where(F.col("severity") == ERROR).isEmpty()


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """Rows without a target cannot be trained or scored on."""
    kind_of(df.schema[target].dataType)
    return nan_to_null(df).where(col(target).isNotNull())
