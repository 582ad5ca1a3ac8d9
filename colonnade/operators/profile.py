"""Facts about every column of a table, from one pass plus one histogram.

``column_facts`` is a single aggregate whose buffers do not grow with the data:
row and value counts, minimum and maximum, and a sketch of the number of
distinct values. ``value_histogram`` is the exact count of every value of the
given columns: one shuffle with map-side combine, shared by distinct counts,
modes, top values, one-hot levels and frequencies.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.functions.columns import (
    DATETIME, FLOAT, INTEGER, OTHER, STRING, as_text, by_task_group, col, kinds, nan_to_null, value_key,
)
from colonnade.functions.dates import read_datetime
from colonnade.functions.names import hints_at_id_column
from colonnade.session import scratch_path

# 2^14 registers: about 0.8 % standard error, 16 KB a column.
SKETCH_SIZE = 14
# Beyond this relative distance the sketch decides a threshold alone (7 standard errors).
SKETCH_MARGIN = 0.06
# What any of the layouts of a date has: it begins with a number or the short name of a month, and has nothing but digits,
# letters and a few signs. Trying a layout in vain costs far more than this look.
DATE_LIKE = "^(?:[A-Za-z]{3,4}[.]? |[+-]?[0-9])[0-9A-Za-z:/.,+ -]*$"
# Code points by which the order of long texts is first judged.
PREFIX = 64
# Keys of candidates, of some 300 bytes at most, are broadcast up to this many.
BROADCAST_CANDIDATES = 10_000


@dataclass(frozen=True)
class ColumnFacts:
    name: str
    kind: str
    rows: int
    present: int
    distinct_estimate: int
    low: int | None = None
    high: int | None = None
    #: Present texts that read as a date, and whether the name hints at an identifier.
    dates: int = 0
    hinted: bool = False

    @property
    def missing(self) -> int:
        return self.rows - self.present


def _sketched(name: str, kind: str):
    """Counted by 64-bit hash: collisions are far below the error of the sketch."""
    value = col(name).cast("double") + F.lit(0.0) if kind == FLOAT else col(name)
    return F.when(col(name).isNotNull(), F.xxhash64(value))


def _date_of(text):
    """The date that a text is; most texts are told by their length and signs, without trying every layout."""
    trimmed = F.trim(text)
    return F.when(F.length(trimmed).between(8, 40) & text.rlike("[0-9]{2}") & trimmed.rlike(DATE_LIKE), read_datetime(text))


def column_facts(df: DataFrame) -> list[ColumnFacts]:
    """One aggregate over all columns; the answer is one row on the driver.

    The sketches of all tasks are merged in groups first and then once more.
    """
    df = nan_to_null(df)
    kind = kinds(df)
    first, second = [F.count(F.lit(1)).alias("rows")], [F.sum("rows").alias("rows")]
    for i, c in enumerate(df.columns):
        first.append(F.count(col(c)).alias(f"present{i}"))
        second.append(F.sum(f"present{i}").alias(f"present{i}"))
        if kind[c] != OTHER:
            first.append(F.hll_sketch_agg(_sketched(c, kind[c]), F.lit(SKETCH_SIZE)).alias(f"distinct{i}"))
            second.append(F.hll_sketch_estimate(F.hll_union_agg(f"distinct{i}")).alias(f"distinct{i}"))
        if kind[c] == STRING:
            first.append(F.count(_date_of(col(c))).alias(f"dates{i}"))
            second.append(F.sum(f"dates{i}").alias(f"dates{i}"))
        if kind[c] == INTEGER:
            first += [F.min(col(c)).alias(f"low{i}"), F.max(col(c)).alias(f"high{i}")]
            second += [F.min(f"low{i}").alias(f"low{i}"), F.max(f"high{i}").alias(f"high{i}")]
    hinted = [hints_at_id_column(F.lit(c)).alias(f"hinted{i}") for i, c in enumerate(df.columns)]
    row = by_task_group(df).agg(*first).agg(*second).select("*", *hinted).first().asDict()
    return [
        ColumnFacts(
            c, kind[c], row["rows"] or 0, row[f"present{i}"] or 0, row.get(f"distinct{i}") or 0,
            row.get(f"low{i}"), row.get(f"high{i}"), row.get(f"dates{i}") or 0, row[f"hinted{i}"],
        )
        for i, c in enumerate(df.columns)
    ]


def value_histogram(df: DataFrame, columns: Sequence[str], digest: bool = False, prefix: bool = False) -> DataFrame:
    """``(column, value, n)`` for every present value of the given columns.

    ``digest=True`` is for counting only: long texts are then represented by
    their SHA-256. With ``prefix=True`` their first ``PREFIX`` code points stand
    before it, so that the order of all but texts with a common beginning shows.
    """
    df = nan_to_null(df)
    kind = kinds(df)
    # Values are counted in their own type and written as text afterwards. The
    # groups read disjoint columns, so together they are one scan of the table.
    typed: dict[str, list[str]] = {}
    for c in columns:
        typed.setdefault(_counted_type(df, c, kind[c]), []).append(c)
    parts = [_counted(df, names, as_type, digest, prefix) for as_type, names in typed.items()]
    return reduce(DataFrame.unionAll, parts)


def _counted_type(df: DataFrame, name: str, kind: str) -> str:
    if kind == INTEGER:
        return "bigint"
    if kind == FLOAT:
        return "double"
    return df.schema[name].dataType.simpleString() if kind == DATETIME else "string"


def _shortened(text: Column) -> Column:
    """Texts of up to ``PREFIX`` code points as they are; of longer ones the beginning and the SHA-256."""
    return F.when(F.char_length(text) > PREFIX, F.concat(F.substring(text, 1, PREFIX), F.sha2(text, 256))).otherwise(text)


def _counted(df: DataFrame, names: list[str], as_type: str, digest: bool, prefix: bool) -> DataFrame:
    def value(c: str):
        if as_type == "double":
            return col(c).cast("double") + F.lit(0.0)
        if as_type == "string":
            kind = kinds(df)[c]
            if prefix:
                return _shortened(as_text(c, kind))
            return value_key(c, kind) if digest else as_text(c, kind)
        return col(c).cast(as_type)

    if len(names) == 1:
        cells = df.select(F.lit(names[0]).alias("column"), value(names[0]).alias("value"))
    else:
        cells = df.select(*[value(c).alias(c) for c in names]).unpivot([], [col(c) for c in names], "column", "value")
    counted = cells.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("column", F.col("value").cast("string").alias("value"), "n")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n_distinct)``: exact, and present for columns without values too."""
    counted = value_histogram(df, columns, digest=True).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(F.broadcast(counted), "column", "left").select(
        "column", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct")
    )


def exact_distinct(df: DataFrame, columns: Iterable[str]) -> dict[str, int]:
    """Distinct counts on the driver: one number per column."""
    columns = list(columns)
    if not columns:
        return {}
    found = {c: 0 for c in columns}
    counted = value_histogram(df, columns, digest=True).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    found.update({row["column"]: row["n"] for row in counted.collect()})
    return found


def value_order(kind: str):
    """Sort keys that put the text form of values in the order of the values."""
    value = F.col("value")
    if kind in (INTEGER, FLOAT):
        return F.struct(F.expr("try_cast(value AS double)").alias("number"), value.alias("text"))
    return F.struct(F.lit(None).cast("double").alias("number"), value.alias("text"))


def ordered_values(histogram: DataFrame, kind: dict[str, str]) -> DataFrame:
    """Adds ``place``, by which equal counts are ordered: numbers as numbers, texts as texts."""
    numeric = [c for c, k in kind.items() if k in (INTEGER, FLOAT)]
    return histogram.withColumn(
        "place",
        F.when(F.col("column").isin(numeric), value_order(INTEGER)).otherwise(value_order(STRING))
        if numeric else value_order(STRING),
    )


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` of the most frequent value; ties go to the smallest."""
    return frequent_values(df, columns, 1).select("column", "value", "n")


def frequent_values(df: DataFrame, columns: Sequence[str], top: int, histogram: DataFrame | None = None) -> DataFrame:
    """``(column, rank, value, n)``: the ``top`` most frequent values, equal counts by value.

    Values are counted by keys of bounded length, exactly. The candidates are
    the values up to the rank limit by count and beginning, with all that tie;
    a second scan brings the whole text of the long ones, one copy from a task,
    and these settle the order. ``histogram`` is one made with ``prefix=True``.
    """
    df = nan_to_null(df)
    kind = {c: k for c, k in kinds(df).items() if c in set(columns)}
    histogram = value_histogram(df, columns, prefix=True) if histogram is None else histogram
    texts = [c for c in columns if _counted_type(df, c, kind[c]) == "string"]
    begun = ordered_values(histogram.withColumn("key", F.col("value")).withColumn("value", F.substring("value", 1, PREFIX)), kind)
    by_place = W.partitionBy("column").orderBy(F.col("n").desc(), F.col("place"))
    found = begun.withColumn("rank", F.rank().over(by_place)).where(F.col("rank") <= top).select(
        "column", F.col("key").alias("value"), "n")
    if texts:
        found = _with_whole_texts(df, texts, kind, found)
    whole = ordered_values(found, kind).withColumn("rank", F.row_number().over(by_place))
    return whole.where(F.col("rank") <= top).select("column", "rank", "value", "n")


def _with_whole_texts(df: DataFrame, texts: list[str], kind: dict[str, str], found: DataFrame) -> DataFrame:
    """``(column, value, n)`` with the texts that shortened values stand for."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "candidates")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    # Only whole long texts have keys that are longer than what a short text can be.
    shortened = F.col("column").isin(texts) & (F.char_length("value") > PREFIX)
    wanted = found.where(shortened).select("column", F.col("value").alias("key"))
    candidates = wanted.count()
    if not candidates:
        return found
    wanted = F.broadcast(wanted) if candidates <= BROADCAST_CANDIDATES else wanted
    cells = df.select(*[as_text(c, kind[c]).alias(c) for c in texts]).unpivot([], [col(c) for c in texts], "column", "text")
    long = cells.where(F.char_length("text") > PREFIX).withColumn("key", _shortened(F.col("text")))
    # Equal keys have equal texts, so a set holds one.
    named = long.join(wanted, ["column", "key"], "left_semi").groupBy("column", "key").agg(F.collect_set("text")[0].alias("text"))
    return found.withColumn("key", F.when(shortened, F.col("value"))).join(named, ["column", "key"], "left").select(
        "column", F.coalesce("text", "value").alias("value"), "n")


__all__ = [
    "ColumnFacts", "column_facts", "value_histogram", "distinct_counts", "exact_distinct", "modes", "frequent_values",
    "ordered_values", "DATETIME", "SKETCH_MARGIN",
]
