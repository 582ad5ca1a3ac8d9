"""Reading and writing tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions.columns import col, nan_to_null
from colonnade.functions.names import safe_name_of
from colonnade.sources.records import MARK, MARKED, quotes_in, records_by_line, unmarked

BAD_LINE = "_bad_line"
# Encodings tried in this order.
ENCODINGS = ("UTF-8", "ISO-8859-1", "windows-1252")
# What windows-1252 has where Latin-1 has control characters. Spark reads Latin-1 only, so these are replaced afterwards.
CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
SIGNS = CONTROLS.encode("latin-1").decode("cp1252")


class TableError(ValueError):
    """A table that cannot be read or has no rows."""


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The table as stored; operators take NaN for missing themselves, so filters on raw columns reach the files."""
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str | None = None) -> DataFrame:
    """A CSV table with a header, in the first encoding that decodes it.

    Cells may be quoted and then hold commas, line breaks and doubled quotes. One scan over the lines tells whether UTF-8
    fits, and whether a line ends inside quotes: only then are the records put together from the lines first, by as many
    tasks as there are splits, and written one to a line. Rows that do not fit the schema are an error here, not later, as
    is a table without rows. ``schema`` saves the pass that infers types.
    """
    names = None
    try:
        seen = _seen(spark, path)
        encoding = encoding or seen["encoding"]
        windows = encoding == ENCODINGS[2]
        options = {"header": True, "encoding": ENCODINGS[1] if windows else encoding, "quote": '"', "escape": '"', "enforceSchema": False}
        if seen["open_lines"]:
            header, path = records_by_line(spark, path, options["encoding"])
            options["encoding"] = ENCODINGS[0]
            names = [_unmarked_name(c) for c in spark.read.options(**options).csv(header).columns]
            options["header"] = False
        reader = spark.read.options(**options)
        if schema is None:
            schema = reader.option("inferSchema", True).csv(path).schema
            if names:
                schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema.fields)])
        shape = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        if names and [n.lower() for n in names] != [n.lower() for n in shape.fieldNames()]:
            raise TableError(f"the header of the file is {', '.join(names)}; the schema has {', '.join(shape.fieldNames())}")
        wide = T.StructType([*(T.StructField(f.name, f.dataType) for f in shape.fields), T.StructField(BAD_LINE, T.StringType())])
        checked = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE).schema(wide).csv(path)
        # The first row, and the first that does not fit, in one pass.
        found = checked.agg(F.count(F.lit(1)).alias("n"), F.min(BAD_LINE).alias("bad"), F.count(F.col(shape.fieldNames()[0])).alias("first")).first()
    except (PySparkException, ValueError) as error:
        if isinstance(error, TableError):
            raise
        raise TableError(f"{path} cannot be read as CSV: {error}") from error
    if not found["n"]:
        raise TableError(f"{path} has no rows")
    if found["bad"] is not None:
        raise TableError(f"{path} has a row that does not fit: {found['bad'][:200]}")
    df = nan_to_null(checked.drop(BAD_LINE))
    if names:
        df = df.select(*[
            (unmarked(col(f.name)) if isinstance(f.dataType, T.StringType) else col(f.name)).alias(f.name) for f in df.schema.fields
        ])
    if windows:
        df = df.select(*[
            (F.translate(col(f.name), CONTROLS, SIGNS) if isinstance(f.dataType, T.StringType) else col(f.name)).alias(f.name.translate(str.maketrans(CONTROLS, SIGNS)))
            for f in df.schema.fields
        ])
    return df


def _unmarked_name(name: str) -> str:
    """A column's name with its line breaks again."""
    for sign, marked in MARKED:
        name = name.replace(marked, sign)
    return name.replace(MARK + "a", MARK)


def _seen(spark: SparkSession, path: str) -> dict:
    """Encoding and whether a quoted cell runs over a line's end, from one scan of the lines."""
    line = F.col("value")
    # Bytes that only windows-1252 gives a letter or sign to; in Latin-1 they would be control characters.
    high = F.hex(line.cast("binary")).rlike("^(..)*[89]")
    seen = spark.read.text(path).agg(
        F.bool_and(F.is_valid_utf8(line)).alias("utf8"), F.bool_or(high).alias("high"), F.bool_or(quotes_in(line) % 2 == 1).alias("open_lines")
    ).first()
    utf8, latin1, windows = ENCODINGS
    return {"encoding": utf8 if seen["utf8"] in (True, None) else windows if seen["high"] else latin1, "open_lines": bool(seen["open_lines"])}


def malformed_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``(line)`` of every line that does not fit the schema; the header lines are left out."""
    lines = spark.read.text(path)
    header = lines.limit(1).collect()
    wide = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    parsed = F.from_csv(F.col("value"), F.lit(wide.toDDL()), options)
    return lines.where(F.col("value") != F.lit(header[0]["value"] if header else "")).where(
        parsed[BAD_LINE].isNotNull()).select(F.col("value").alias("line"))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """A folder of CSV parts, each with a header; quotes in a cell are doubled, its white space stays."""
    df.write.mode(mode).options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def land(df: DataFrame, folder: str, name: str, mode: str = "error") -> str:
    """Stores a dataset as parquet under its cleaned name; returns the path."""
    safe = safe_name_of(name)
    if not safe.strip("_-"):
        raise TableError(f"{name!r} is not a usable dataset name")
    path = f"{folder.rstrip('/')}/{safe}"
    df.write.mode(mode).parquet(path)
    return path
