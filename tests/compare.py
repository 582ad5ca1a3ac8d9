"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if hasattr(value, "hour") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, [tuple(_plain(r[n]) for n in names) for r in df.collect()]


def sql_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    header = [d[0] for d in result.description]
    order = sorted(range(len(header)), key=lambda i: header[i])
    return [header[i] for i in order], [tuple(_plain(row[i]) for i in order) for row in result.fetchall()]


def differences(ours: list[tuple], theirs: list[tuple], limit: int = 3) -> str:
    """Empty if both sides hold the same rows."""
    left, right = sorted(map(repr, ours)), sorted(map(repr, theirs))
    if left == right:
        return ""
    only_left, only_right = sorted(set(left) - set(right))[:limit], sorted(set(right) - set(left))[:limit]
    return f"{len(left)} rows against {len(right)}; only ours {only_left}; only SQL {only_right}"
