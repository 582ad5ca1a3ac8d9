"""Column roles and the kind of problem, inferred from the data.

The thresholds are decided by the sketch of the profile pass wherever it is
clear of them; only columns near a threshold are counted exactly.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import (
    BOOLEAN, DATETIME, FLOAT, INTEGER, NUMERIC_KINDS, OTHER, STRING, col, kind_of, nan_to_null,
)
from colonnade.operators.profile import SKETCH_MARGIN, ColumnFacts, column_facts, exact_distinct

NUMERICAL, CATEGORICAL, ID_LIKE, UNSUPPORTED = "numerical", "categorical", "id_like", "unsupported"
ROLE_DATETIME, ROLE_BOOLEAN = "datetime", "boolean"
ROLES = (NUMERICAL, CATEGORICAL, ROLE_DATETIME, ROLE_BOOLEAN, ID_LIKE)

CLASSIFICATION, REGRESSION = "classification", "regression"

# Fixed values of the rules.
FEW_VALUES = 20
FEW_VALUES_SHARE = 0.05
ID_SHARE = 0.95
ID_MIN_ROWS = 20


def _effective_kind(facts: ColumnFacts) -> str:
    """Integers with missing values count as floats, and are never identifiers."""
    return FLOAT if facts.kind == INTEGER and facts.missing else facts.kind


def _contiguous(facts: ColumnFacts) -> bool:
    return facts.low is not None and facts.present >= 2 and facts.high - facts.low == facts.present - 1


def _needs_exact(facts: ColumnFacts) -> bool:
    kind, estimate, rows = _effective_kind(facts), facts.distinct_estimate, facts.rows
    if kind in (OTHER, BOOLEAN) or not rows:
        return False

    def near(threshold: float) -> bool:
        return abs(estimate - threshold) <= max(5.0, SKETCH_MARGIN * max(threshold, estimate))

    may_be_id = rows > ID_MIN_ROWS and kind != FLOAT and near(ID_SHARE * rows)
    if may_be_id and kind == INTEGER and not facts.hinted and not _contiguous(facts):
        may_be_id = False
    role_by_count = kind in NUMERIC_KINDS and (near(FEW_VALUES) or near(FEW_VALUES_SHARE * rows))
    sequence = kind == INTEGER and _contiguous(facts) and estimate > (ID_SHARE - SKETCH_MARGIN) * rows
    return may_be_id or role_by_count or sequence


def _is_id(facts: ColumnFacts, distinct: int) -> bool:
    kind = _effective_kind(facts)
    if facts.rows <= ID_MIN_ROWS or kind in (FLOAT, OTHER) or distinct / facts.rows <= ID_SHARE:
        return False
    return kind != INTEGER or facts.hinted or (_contiguous(facts) and distinct == facts.present)


def _role(facts: ColumnFacts, distinct: int) -> str:
    if facts.kind == OTHER:
        return UNSUPPORTED
    if _is_id(facts, distinct):
        return ID_LIKE
    if facts.kind == BOOLEAN:
        return ROLE_BOOLEAN
    if facts.kind == DATETIME:
        return ROLE_DATETIME
    if facts.kind in NUMERIC_KINDS:
        share = distinct / facts.rows if facts.rows else 0.0
        return CATEGORICAL if distinct <= FEW_VALUES or share <= FEW_VALUES_SHARE else NUMERICAL
    # Every present text has to be a date, not the first ones only.
    if facts.kind == STRING and facts.present and facts.dates == facts.present:
        return ROLE_DATETIME
    return CATEGORICAL


def infer_roles(df: DataFrame, facts: list[ColumnFacts] | None = None) -> dict[str, str]:
    """Role per column: one profile pass, and exact counts where the pass cannot decide."""
    df = nan_to_null(df)
    facts = facts or column_facts(df)
    exact = exact_distinct(df, [f.name for f in facts if _needs_exact(f)])
    return {f.name: _role(f, exact.get(f.name, f.distinct_estimate)) for f in facts}


def roles_frame(df: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """``(column, role)``, one row per column."""
    roles = with_overrides(infer_roles(df), overrides)
    return df.sparkSession.createDataFrame(list(roles.items()), "column string, role string")


def with_overrides(roles: Mapping[str, str], overrides: Mapping[str, str] | None) -> dict[str, str]:
    """The caller's roles win, for columns that are there; others are ignored."""
    merged = dict(roles)
    for name, role in (overrides or {}).items():
        if role not in ROLES:
            raise ValueError(f"unknown role {role!r} for column {name!r}; known: {', '.join(ROLES)}")
        if name in merged:
            merged[name] = role
    return merged


def of_role(roles: Mapping[str, str], *wanted: str) -> list[str]:
    return [name for name, role in roles.items() if role in wanted]


def problem_type(df: DataFrame, target: str) -> str:
    """Classification for texts, flags and few distinct numbers; otherwise regression.

    The sketch of the profile pass tells many from few; only near ``FEW_VALUES``
    are the values counted.
    """
    if kind_of(df.schema[target].dataType) not in NUMERIC_KINDS:
        return CLASSIFICATION
    clean = nan_to_null(df.select(col(target).alias("y")))
    if column_facts(clean)[0].distinct_estimate > 2 * FEW_VALUES:
        return REGRESSION
    values = clean.where(F.col("y").isNotNull()).distinct().limit(FEW_VALUES + 1).count()
    return CLASSIFICATION if values <= FEW_VALUES else REGRESSION


def problem_type_frame(df: DataFrame, targets: list[str]) -> DataFrame:
    rows = [(t, problem_type(df, t)) for t in targets]
    return df.sparkSession.createDataFrame(rows, "target string, problem string")
