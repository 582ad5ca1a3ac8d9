"""Line dedup: keys sorted by range, first occurrences streamed, a keep bitmap for each document.

Every line of at least ``min_chars`` code points gives a row (hash of its key, document, position). The rows are
partitioned by range over all three columns and sorted, so a line that a third of all documents hold is spread over many
tasks. A task streams its rows: the first document of a key keeps its lines, the others lose theirs. Where a key runs
across the border of two tasks, the first document that each of them saw is settled afterwards among one document per
task. What returns to the documents is a compressed bitmap, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from colonnade.llm.frames import map_rows, mapped, row_hash, staged, utf8

BLANK = b" \t\n\v\f\r"
MIN_CHARS = 10
#: A key that no line has; it marks the row with a document's number of lines.
HEAD = b""


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """What makes two lines equal: white space at both ends and the case of A-Z do not count; None if too short."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return key


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``id``, ``row`` (hash of the text), ``n_lines``, ``n_dropped``, ``keep``: a compressed bitmap, null if all lines stay.

    A null or empty text is one empty line. A null id counts as smaller than all others. Rows of one id are one document:
    their common lines are no repeats, and equal rows share a bitmap. An empty table gives none. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), row_hash(text_col).alias("row"), F.col(text_col).alias("text"))

    def keys(rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc, row, text in rows:
            lines = utf8(text).split(b"\n")
            yield HEAD, doc, row, len(lines)
            for position, line in enumerate(lines):
                key = line_key(line, min_chars)
                if key is not None:
                    yield hashlib.blake2b(key, digest_size=16).digest(), doc, row, position

    id_type = source.schema["id"].dataType.simpleString()
    shape = f"key binary, id {id_type}, row bigint, at int"
    found = staged(map_rows(source, keys, shape, 65536), "line-keys")
    order = ["key", "id", "row", "at"]
    ranged = found.where(F.length("key") > 0).repartitionByRange(*order).sortWithinPartitions(*order)
    judged = staged(map_rows(ranged, _first_occurrences, f"{shape}, open boolean", 65536), "line-drops")

    open_runs = judged.where("open")
    first = open_runs.groupBy("key").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("first"))
    late = (
        open_runs.join(F.broadcast(first), "key")
        .where(F.struct(F.col("id").isNotNull().alias("known"), "id") > F.col("first"))
        .select("id", "row", "at")
    )
    dropped = judged.where(~F.col("open")).select("id", "row", "at").unionByName(late)
    heads = found.where(F.length("key") == 0).select("id", "row", F.col("at").alias("n_lines"), F.lit(None).cast("int").alias("at"))
    by_row = (
        heads.unionByName(dropped.withColumn("n_lines", F.lit(None).cast("int")))
        .groupBy("id", "row").agg(F.max("n_lines").alias("n_lines"), F.collect_set("at").alias("gone"))
    )

    def pack(rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc, row, n_lines, gone in rows:
            keep = np.ones(n_lines, bool)
            keep[gone] = False
            yield doc, row, n_lines, len(gone), zlib.compress(np.packbits(keep).tobytes()) if gone else None

    return map_rows(by_row, pack, f"id {id_type}, row bigint, n_lines bigint, n_dropped bigint, keep binary")


def _first_occurrences(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The rows that go; as ``open`` those of the first document of a task's first and last key, which may run on elsewhere."""
    key = first = None
    n_keys, pending = 0, []
    for row in rows:
        if row[0] != key:
            if n_keys == 1:
                yield from pending
            key, first = row[0], row[1]
            n_keys += 1
            pending = []
        if row[1] != first:
            yield *row, False
        else:
            pending.append((*row, True))
    yield from pending


def apply_bitmap(text: str | None, keep: bytes | None) -> str:
    """The kept lines of ``text``, joined by line breaks."""
    if keep is None:
        return text or ""
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).tolist()
    return "\n".join(line for line, stays in zip(lines, bits) if stays)


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs`` as ``source`` (a struct of all their columns) with ``n_lines``, ``n_dropped`` and ``keep``."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars)
    whole = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("source"), F.col(id_col).alias("own_id"), row_hash(text_col).alias("own_row")
    )
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_row") == F.col("row"))
    return whole.join(maps.hint("merge"), same, "left").select("source", "n_lines", "n_dropped", "keep")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the dropped lines gone from its text; all other columns as they were. A null text becomes empty."""
    kept = with_bitmaps(docs, id_col, text_col, min_chars)
    # Texts that keep all their lines stay out of Python.
    rest = mapped(apply_bitmap, "string")(F.when(F.col("keep").isNotNull(), F.col(f"source.`{text_col}`")), "keep")
    whole = F.coalesce(F.col(f"source.`{text_col}`"), F.lit(""))
    out = kept.select("source", F.when(F.col("keep").isNull(), whole).otherwise(rest).alias("text"))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"source.`{c}`").alias(c) for c in docs.columns))
