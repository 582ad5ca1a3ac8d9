"""Column kinds, quoting, NaN cleaning and row identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, FLOAT, BOOLEAN, DATETIME, STRING, OTHER = (
    "integer", "float", "boolean", "datetime", "string", "other",
)
NUMERIC_KINDS = (INTEGER, FLOAT)

_KIND_OF = [
    (T.BooleanType, BOOLEAN),
    (T.IntegralType, INTEGER),
    ((T.FractionalType, T.DecimalType), FLOAT),
    ((T.DateType, T.TimestampType, T.TimestampNTZType), DATETIME),
    (T.StringType, STRING),
]


def kind_of(data_type: T.DataType) -> str:
    for types, kind in _KIND_OF:
        if isinstance(data_type, types):
            return kind
    return OTHER


def kinds(df: DataFrame) -> dict[str, str]:
    return {field.name: kind_of(field.dataType) for field in df.schema.fields}


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere in this library, so it becomes NULL once, here."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floats else col(c) for c in df.columns
    ])


def as_text(name: str, kind: str) -> Column:
    """Text form of a value; adding 0.0 makes -0.0 and 0.0 one value."""
    if kind == FLOAT:
        return (col(name).cast("double") + F.lit(0.0)).cast("string")
    return col(name).cast("string")


def value_key(name: str, kind: str) -> Column:
    """A short key that is equal exactly when the values are equal.

    Long texts are replaced by their SHA-256, so that counting distinct
    documents shuffles a digest per row and not the document.
    """
    text = as_text(name, kind)
    if kind != STRING:
        return text
    return F.when(F.length(text) > 48, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(
        F.concat(F.lit("="), text)
    )


def row_keys(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """Grouping expressions that are equal exactly for equal rows.

    Fixed-width columns stand for themselves. All strings and nested values of
    a row go into one SHA-256 over a length-prefixed text, where NULL has a
    mark of its own.
    """
    columns = list(columns or df.columns)
    kind = kinds(df)
    plain, texts = [], []
    for c in columns:
        if kind[c] == FLOAT:
            plain.append((col(c).cast("double") + F.lit(0.0)).alias(c))
        elif kind[c] in (STRING, OTHER):
            text = col(c) if kind[c] == STRING else F.to_json(F.struct(col(c)))
            texts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
        else:
            plain.append(col(c))
    if texts:
        plain.append(F.sha2(F.concat(*texts), 256).alias("__texts"))
    return plain


TASK_GROUPS = 256


def by_task_group(df: DataFrame):
    """Groups rows by the number of their task, for merging large buffers in two steps."""
    return df.withColumn("__group", F.spark_partition_id() % TASK_GROUPS).groupBy("__group")


# Hexadecimal digits of the digest that make a row's hash: 52 bits, which a double holds exactly.
HASH_DIGITS = 13
HASH_BITS = 4 * HASH_DIGITS


def row_hash(df: DataFrame, key_cols: Sequence[str] | None, seed: int) -> Column:
    """A 52-bit hash of the key, or of the whole row where there is no key.

    It is the beginning of the MD5 of the seed and the values as text, joined by ``|``, with ``-`` for a missing one. So it
    depends on nothing but the values and the seed, a split made from it stays the same under any partitioning and any
    re-run, and other engines can compute it.
    """
    kind = kinds(df)
    named = [F.coalesce(as_text(c, kind[c]), F.lit("-")) for c in (key_cols or df.columns)]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *named))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("bigint")
