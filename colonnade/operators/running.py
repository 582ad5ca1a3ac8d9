"""Running sums and dense numbers over one global order, without one task holding the table.

A window without a partition key would sort everything in a single task. Here
the table is written once, range-partitioned by the ordered column with one
range for every ``BUCKET_ROWS`` rows, and every range has its own window. What
lies before a range is added in two levels: the ranges before it in a group of
about the root of their number, and the groups before that one. So no window
holds more than a range or about the root of the number of ranges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.session import scratch_path

# Ranges are not made smaller than this; a window streams over a range, so larger ones would be no harm.
BUCKET_ROWS = 250_000
# The table of what lies before each range is broadcast up to this many ranges: two numbers and a sum each.
BROADCAST_RANGES = 10_000

_RANGE, _GROUP = "__range", "__group"


def running_sums(df: DataFrame, order: str, sums: Sequence[str], descending: bool = True) -> DataFrame:
    """Adds ``<name>_upto`` for every summed column, and ``<name>_total``.

    ``order`` is a column of any type with an order, without NULLs, NaN or
    repeated values; group by it first. The totals cover the whole table.
    """
    parts, ranges = _in_ranges(df, order)
    by_value = F.col(order).desc() if descending else F.col(order)
    inside = W.partitionBy(_RANGE).orderBy(by_value).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = _before(parts, sums, ranges, descending)
    # Beyond the broadcast the join finds the rows dealt by range already, as the window wants them.
    before = F.broadcast(before) if ranges <= BROADCAST_RANGES else before
    return (
        parts.withColumns({f"__inside_{c}": F.sum(c).over(inside) for c in sums})
        .join(before, _RANGE)
        .withColumns({f"{c}_upto": F.col(f"__inside_{c}") + F.col(f"__before_{c}") for c in sums})
        .drop(_RANGE, *[f"__inside_{c}" for c in sums], *[f"__before_{c}" for c in sums])
    )


def dense_numbers(df: DataFrame, order: str, number: str = "number") -> DataFrame:
    """Adds ``number``: the place from 0 in the ascending order of a column without NULLs or repeated values."""
    run = running_sums(df.withColumn("__one", F.lit(1).cast("bigint")), order, ["__one"], descending=False)
    return run.withColumn(number, F.col("__one_upto") - 1).drop("__one", "__one_upto", "__one_total")


def _in_ranges(df: DataFrame, order: str) -> tuple[DataFrame, int]:
    """The table with the number of each row's range, and how many ranges there are.

    It is written, so that the sums and the windows see the same ranges even if
    an executor is lost between them, and the input is computed once.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "ordered")
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    ranges = max(1, -(-stored.count() // BUCKET_ROWS))
    if ranges == 1:
        return stored.withColumn(_RANGE, F.lit(0)), 1
    dealt = stored.repartitionByRange(ranges, order).withColumn(_RANGE, F.spark_partition_id())
    path = scratch_path(spark, "ranges")
    dealt.write.parquet(path)
    return spark.read.schema(dealt.schema).parquet(path), ranges


def _before(parts: DataFrame, sums: Sequence[str], ranges: int, descending: bool) -> DataFrame:
    """``(range, before..., total...)``: what lies before each range, and in all of them."""

    def earlier(*group: str, by: str) -> W:
        return W.partitionBy(*group).orderBy(F.col(by).desc() if descending else F.col(by)).rowsBetween(W.unboundedPreceding, -1)

    totals = (
        parts.groupBy(_RANGE).agg(*[F.sum(c).alias(c) for c in sums])
        .withColumn(_GROUP, F.floor(F.col(_RANGE) / max(1, math.isqrt(ranges))))
    )
    # About the root of the number of ranges: these windows need no partition key.
    groups = totals.groupBy(_GROUP).agg(*[F.sum(c).alias(c) for c in sums]).select(
        _GROUP,
        *[F.coalesce(F.sum(c).over(earlier(by=_GROUP)), F.lit(0)).alias(f"__groups_{c}") for c in sums],
        *[F.sum(c).over(W.partitionBy(F.lit(0))).alias(f"{c}_total") for c in sums],
    )
    within = totals.select(
        _RANGE, _GROUP, *[F.coalesce(F.sum(c).over(earlier(_GROUP, by=_RANGE)), F.lit(0)).alias(f"__within_{c}") for c in sums]
    )
    return within.join(F.broadcast(groups), _GROUP).select(
        _RANGE, *[(F.col(f"__within_{c}") + F.col(f"__groups_{c}")).alias(f"__before_{c}") for c in sums],
        *[f"{c}_total" for c in sums],
    )
