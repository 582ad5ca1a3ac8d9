"""Small helpers of the text operators: Arrow columns, written tables, words and lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from colonnade.session import scratch_path

#: White space of the word and line rules: the characters that ``bytes.split()`` splits at.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, so that it is computed once.

    The copy outlives a lost executor and ends the lineage.
    """
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, rows: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str, per_batch: int = 4096) -> DataFrame:
    """``rows`` over the tuples of each partition of ``df``, both sides as Arrow batches.

    ``rows`` gets an iterator over all tuples of a partition, so it can carry state along them.
    """
    names = df.columns
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            # A slice at a time: Python objects of a whole batch of long texts would not fit.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield from zip(*(part.column(name).to_pylist() for name in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows(tuples(batches)):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if len(held) >= per_batch or size > 8_000_000:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, target)


def mapped(function: Callable, kind: str):
    """A column function that computes ``function`` for each row in Python; all other columns stay where they are."""

    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(columns[0]), 256):
            out += map(function, *(c.slice(at, 256).to_pylist() for c in columns))
        return pa.array(out, target)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    target = to_arrow_type(DataType.fromDDL(kind))
    return F.arrow_udf(run, kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def row_hash(text: str):
    """Tells rows of one id apart; equal rows share it."""
    return F.xxhash64(F.col(text))
