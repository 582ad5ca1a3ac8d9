"""Records of quoted text files whose cells hold line breaks, found by many tasks.

Whether a line break ends a record depends on the number of quotes before it in
the file. One scan counts the quotes of every split, a prefix over the splits
tells which of them begin inside quotes, and a second scan puts the lines of
each split together. What crosses the border of a split is joined by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.session import scratch_path

QUOTE = '"'
# What a piece is: the end of a record begun in an earlier split, all of a split inside one record, the beginning of a
# record that the split does not end, a whole record, the first record of a file.
END, INSIDE, BEGINNING, WHOLE, HEADER = range(5)
_PIECES = "file string, block bigint, kind int, bytes binary"
# Line breaks inside a record are written as this character and a letter, and so is the character itself.
MARK = "\u0001"
MARKED = (("\n", MARK + "n"), ("\r", MARK + "r"))


def quotes_in(line):
    return F.length(line) - F.length(F.replace(line, F.lit(QUOTE), F.lit("")))


def records_by_line(spark: SparkSession, path: str, encoding: str) -> tuple[str, str]:
    """Writes the records to scratch folders, one to a line, in UTF-8; returns the folders of the header and of the records.

    Line breaks in cells are marked; ``unmarked`` undoes that. Files have to have
    the same header.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # A row for every split, of some 128 MB.
    splits = lines.groupBy("file", "block").agg((F.sum(quotes_in(F.col("value"))) % 2).alias("odd")).select(
        "file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("inside"))
    unknown = F.raise_error(F.lit("the file was split anew between two scans; read it again")).cast("int")
    placed = lines.join(F.broadcast(splits), ["file", "block"], "left").select(
        "file", "block", F.coalesce("inside", unknown).alias("inside"), F.col("value").cast("binary").alias("value"))
    stored = scratch_path(spark, "pieces")
    placed.mapInArrow(_pieces, _PIECES).write.parquet(stored)
    found = spark.read.schema(_PIECES).parquet(stored).withColumn("text", F.decode("bytes", encoding)).drop("bytes")
    crossing = found.where(F.col("kind") < WHOLE)
    # Two pieces a split at most. A record begins where its beginning is.
    upto = W.partitionBy("file").orderBy("block", "kind")
    crossing = crossing.withColumn("record", F.count_if(F.col("kind") == BEGINNING).over(upto)).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "kind", "text"))).alias("parts"))
    joined = crossing.select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    headers = [r["text"] for r in found.where(F.col("kind") == HEADER).select("text").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"the files of {path} have different headers")
    header, body = scratch_path(spark, "header"), scratch_path(spark, "records")
    _written(spark.createDataFrame([(h,) for h in headers], "text string"), header)
    _written(found.where(F.col("kind") == WHOLE).select("text").unionAll(joined), body)
    return header, body


def unmarked(text):
    """A cell with its line breaks again."""
    for sign, marked in MARKED:
        text = F.replace(text, F.lit(marked), F.lit(sign))
    return F.replace(text, F.lit(MARK + "a"), F.lit(MARK))


def _written(records: DataFrame, path: str) -> None:
    text = F.replace(F.regexp_replace("text", r"\r\z", ""), F.lit(MARK), F.lit(MARK + "a"))
    for sign, marked in MARKED:
        text = F.replace(text, F.lit(sign), F.lit(marked))
    records.select(text.alias("value")).write.text(path)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a split, which come in their order, as records and as pieces of records at its borders."""
    split, pending, is_open, begun_before, first = None, [], False, False, False
    out: list[tuple] = []

    def rest() -> None:
        if pending:
            out.append((*split, INSIDE if begun_before else BEGINNING, b"\n".join(pending)))

    for batch in batches:
        for file, block, inside, line in zip(*(column.to_pylist() for column in batch.columns)):
            if (file, block) != split:
                rest()
                split, pending, is_open, begun_before, first = (file, block), [], inside == 1, inside == 1, block == 0
            pending.append(line)
            is_open ^= line.count(QUOTE.encode()) % 2 == 1
            if not is_open:
                record = b"\n".join(pending)
                kind = END if begun_before else HEADER if first and record.strip() else WHOLE
                first = first and kind != HEADER
                out.append((file, block, kind, record))
                pending, begun_before = [], False
        if out:
            yield _batch(out)
            out.clear()
    rest()
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int32(), pa.binary())
    names = ("file", "block", "kind", "bytes")
    return pa.RecordBatch.from_arrays([pa.array(values, t) for values, t in zip(zip(*rows), types)], names=names)
