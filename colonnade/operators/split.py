"""Deterministic splits and folds by hash thresholds.

A row's place is decided by a hash of its key and the seed, never by its
position, so the parts are the same under any partitioning and after any
re-run. Stratified parts compare the hash with thresholds of the row's class,
which are order statistics: in a class of any size the shares are exact to the
row. No class is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colonnade.functions.columns import HASH_BITS, col, kinds, nan_to_null, row_hash, value_key
from colonnade.operators.lookup import lookup

# Fixed values of the training setup.
TEST_SHARE = 0.2
SEED = 42
FOLDS = 5
FOLD_RANGE = (2, 10)

# How far from its expected place a threshold is looked for at first.
STANDARD_ERRORS = 8.0
# Up to this many classes their thresholds are held on the driver.
INLINE_CLASSES = 10_000

_GRAIN = 1_000_000
_HASH_RANGE = 2**HASH_BITS


def _below(hashed: Column, share: float) -> Column:
    return F.pmod(hashed, F.lit(_GRAIN)) < F.lit(round(share * _GRAIN))


def with_test_flag(
    df: DataFrame,
    key_cols: Sequence[str] | None = None,
    share: float = TEST_SHARE,
    seed: int = SEED,
    stratify: str | None = None,
    name: str = "is_test",
) -> DataFrame:
    """Adds a boolean column that marks the test rows.

    With ``stratify`` every class gives its own share. If a class has a single
    row, no class is stratified.
    """
    hashed = row_hash(df, key_cols, seed)
    if stratify is not None:
        classes = _Classes(df, hashed, stratify, [share])
        if classes.smallest >= 2:
            flag = F.coalesce(hashed <= F.col("__cuts")[0], F.lit(False))
            return classes.beside(df).select(*[col(c) for c in df.columns], flag.alias(name))
    return df.withColumn(name, _below(hashed, share))


def split(
    df: DataFrame,
    key_cols: Sequence[str] | None = None,
    share: float = TEST_SHARE,
    seed: int = SEED,
    stratify: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(train, test)``."""
    flagged = with_test_flag(df, key_cols, share, seed, stratify, "__test")
    return (
        flagged.where(~F.col("__test")).drop("__test"),
        flagged.where(F.col("__test")).drop("__test"),
    )


def with_folds(
    df: DataFrame,
    folds: int = FOLDS,
    key_cols: Sequence[str] | None = None,
    seed: int = SEED,
    stratify: str | None = None,
    name: str = "fold",
) -> DataFrame:
    """Adds an integer column ``0 .. folds-1``."""
    if not FOLD_RANGE[0] <= folds <= FOLD_RANGE[1]:
        raise ValueError(f"folds must be between {FOLD_RANGE[0]} and {FOLD_RANGE[1]}, not {folds}")
    hashed = row_hash(df, key_cols, seed)
    if stratify is None:
        return df.withColumn(name, F.pmod(hashed, F.lit(folds)).cast("int"))
    classes = _Classes(df, hashed, stratify, [i / folds for i in range(1, folds)])
    passed = [F.when(hashed > F.col("__cuts")[i], 1).otherwise(0) for i in range(folds - 1)]
    return classes.beside(df).select(
        *[col(c) for c in df.columns], sum(passed[1:], passed[0]).cast("int").alias(name)
    )


class _Classes:
    """Hash thresholds per class of a label: the hash of the row at each share's place in the class, in order of hashes."""

    def __init__(self, df: DataFrame, hashed: Column, label: str, shares: list[float]):
        self.key = value_key(label, kinds(df)[label])
        hashes = nan_to_null(df.select(hashed.alias("h"), col(label))).select(
            "h", self.key.alias("key")).where(F.col("key").isNotNull())
        sizes = hashes.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        self.count, self.rows, least = sizes.agg(F.count(F.lit(1)), F.sum("n"), F.min("n")).first()
        self.rows, self.smallest = self.rows or 0, least or 0
        wide = STANDARD_ERRORS
        while True:
            table = self._thresholds(hashes, sizes, shares, wide)
            if self.count > INLINE_CLASSES:
                missed = not table.where(F.exists("cuts", lambda c: c.isNull())).isEmpty()
            else:
                seen = table.collect()
                missed = any(c is None for r in seen for c in r["cuts"])
                table = df.sparkSession.createDataFrame(seen, "key string, cuts array<bigint>, n bigint")
            if not missed:
                break
            wide *= 16
        self.table = table.select(
            "key", F.col("cuts").alias("value"), (F.col("n") / F.lit(float(self.rows or 1))).alias("share")
        )

    def _thresholds(self, hashes: DataFrame, sizes: DataFrame, shares: list[float], wide: float) -> DataFrame:
        """``(key, cuts, n)``; a cut is NULL if it lies beyond ``wide`` standard errors of where it is expected.

        Hashes are uniform, so the row at a share's place lies near that share of their range: rows below the
        neighbourhood are counted, and only those within it, about the root of the class, are put in order.
        """
        n, size = F.col("n"), float(_HASH_RANGE)
        places = []
        for i, s in enumerate(shares):
            spread = F.sqrt(F.lit(s * (1 - s)) / n) * wide + F.lit(wide) / n
            places.append(F.struct(
                F.lit(i).alias("i"), F.floor(n * s + 0.5).cast("bigint").alias("k"),
                F.greatest(F.lit(0.0), (F.lit(s) - spread) * size).cast("bigint").alias("low"),
                F.least(F.lit(size), (F.lit(s) + spread) * size).cast("bigint").alias("high"),
            ))
        wanted = sizes.withColumn("places", F.array(*places))
        table = wanted.select("key", F.col("places").alias("value"), (n / F.lit(float(self.rows or 1))).alias("share"))
        placed = lookup(hashes, F.col("key"), table, self.count, "places")
        below = placed.groupBy("key").agg(F.array(*[
            F.count_if(F.col("h") < F.col("places")[i]["low"]) for i in range(len(shares))
        ]).alias("below"))
        near = placed.select("key", "h", F.explode(F.filter("places", lambda p: F.col("h").between(p["low"], p["high"]))).alias("p"))
        order = Window.partitionBy("key", "i").orderBy("h")
        ranked = near.select("key", "h", "p.i", "p.k").withColumn("rank", F.row_number().over(order))
        found = ranked.join(below, "key").where(F.col("rank") == F.col("k") - F.get("below", F.col("i")))
        cuts = found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("i", "h"))).alias("found"))
        cut = F.transform("places", lambda p: F.when(p["k"] == 0, F.lit(-1).cast("bigint")).otherwise(F.try_element_at("found", p["i"])))
        return wanted.join(cuts, "key", "left").select("key", cut.alias("cuts"), "n")

    def beside(self, df: DataFrame) -> DataFrame:
        return lookup(df, self.key, self.table, self.count, "__cuts")


def part_shares(df: DataFrame, part: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., part, n)``: how many rows went where."""
    return df.groupBy(*by, part).agg(F.count(F.lit(1)).alias("n"))
