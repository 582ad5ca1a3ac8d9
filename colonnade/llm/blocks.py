"""Packed blocks of documents, and a count of 64-bit keys over all blocks.

Several operators have to know which pieces of a text occur in other texts as well. Shuffling a row for each piece would
move many times the input, so documents are packed into blocks, and a block sends one sorted, packed array of distinct keys
to each key bucket. A bucket adds up the counts and answers each block with one byte per key. So a piece that a third of all
documents hold costs one entry per block, and the texts themselves need not be shuffled to be counted.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from colonnade.llm.frames import map_rows, staged, utf8

#: Bytes of text in a block, unless one document is longer.
BLOCK_BYTES = 2_000_000
#: Bytes of text for each key bucket.
BUCKET_BYTES = 8_000_000
LEAST_BUCKETS = 32
#: Bits of a key that are compared within a bucket. Keys that agree by chance are only taken for one another in counts,
#: which decide what is looked at, never what is found.
LOW_BITS = 28
NO_ID = np.iinfo(np.int64).min

MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that spreads close values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written rows (block, n_bytes, data) that hold the ids and texts of all rows; a null text is empty.

    A block's number names the partition it was made in and its place there. It means something only in the written table.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def rows(found: Iterable[tuple]) -> Iterator[tuple]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        ids, texts, size, n = [], [], 0, 0
        for doc, text in found:
            ids.append(NO_ID if doc is None else doc)
            texts.append(utf8(text))
            size += len(texts[-1])
            if size >= BLOCK_BYTES or len(ids) >= 65536:
                yield base + n, size, _pack(ids, texts)
                ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield base + n, size, _pack(ids, texts)

    return staged(map_rows(source, rows, "block bigint, n_bytes bigint, data binary", 4), "text-blocks")


def _pack(ids: list[int], texts: list[bytes]) -> bytes:
    head = struct.pack("<q", len(ids)) + np.array(ids, "<i8").tobytes() + np.array([len(t) for t in texts], "<i8").tobytes()
    return packed(head + b"".join(texts))


def unpack_block(data: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Ids, where each text begins (and the last ends), and all texts one after another."""
    raw = unpacked(data)
    n = struct.unpack_from("<q", raw)[0]
    ids = np.frombuffer(raw, "<i8", n, 8)
    sizes = np.frombuffer(raw, "<i8", n, 8 + 8 * n)
    return ids, np.concatenate([[0], np.cumsum(sizes)]), raw[8 + 16 * n:]


def bucket_count(blocks: DataFrame) -> int:
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(LEAST_BUCKETS, math.ceil(total / BUCKET_BYTES))


def bucketed(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys as bucket and low bits in one integer, so that sorting brings a bucket's keys together."""
    x = mixed(keys)
    return ((x >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (x & np.uint64((1 << LOW_BITS) - 1))


def by_bucket(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted bucketed keys."""
    if len(keys):
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield int(bucket[a]), a, b


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed) for sorted distinct bucketed keys: steps between keys by byte planes, and counts."""
    for bucket, a, b in by_bucket(keys):
        low = (keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        steps = np.diff(low, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
        many = counts[a:b].astype("<u4").view(np.uint8).reshape(-1, 4)
        yield bucket, packed(struct.pack("<i", b - a) + np.concatenate([steps.T, many.T]).tobytes())


def _unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = unpacked(data)
    n = struct.unpack_from("<i", raw)[0]
    planes = np.frombuffer(raw, np.uint8, 8 * n, 4).reshape(8, n)
    both = [np.ascontiguousarray(p.T).view("<u4").ravel() for p in (planes[:4], planes[4:])]
    return np.cumsum(both[0], dtype=np.int64), both[1].astype(np.int64)


def count_code(totals: np.ndarray) -> np.ndarray:
    """0 for 1, else a quarter of an octave's step from 1 on: larger counts never have a smaller code."""
    return np.where(totals <= 1, 0, 1 + np.minimum(250, 4 * np.log2(np.maximum(totals, 1)))).astype(np.uint8)


def answer_counts(sent: DataFrame) -> DataFrame:
    """From (bucket, block, counts): (block, answers), one entry for each bucket with a key that has a code above 0."""

    def total(table):
        import pyarrow as pa

        blocks, parts = table.column("block").to_pylist(), [_unpack_counts(x) for x in table.column("counts").to_pylist()]
        bucket = table.column("bucket")[0].as_py()
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        first = np.concatenate([[True], np.diff(keys[order]) != 0])
        sums = np.add.reduceat(counts[order], np.flatnonzero(first))
        codes = np.empty(len(keys), np.uint8)
        codes[order] = count_code(sums)[np.cumsum(first) - 1]
        out, at = [], 0
        for block, (low, _) in zip(blocks, parts):
            mine = codes[at:at + len(low)]
            at += len(low)
            if mine.any():
                out.append((block, bucket, packed(mine.tobytes())))
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({"block": pa.array(columns[0], pa.int64()), "bucket": pa.array(columns[1], pa.int32()), "codes": pa.array(columns[2], pa.binary())})

    answers = sent.groupBy("bucket").applyInArrow(total, "block bigint, bucket int, codes binary")
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "codes")).alias("answers"))


def spread_codes(keys: np.ndarray, answers: list | None) -> np.ndarray:
    """The code of each of a block's sorted distinct keys."""
    codes = np.zeros(len(keys), np.uint8)
    known = {r["bucket"]: r["codes"] for r in answers or ()}
    for bucket, a, b in by_bucket(keys):
        if bucket in known:
            codes[a:b] = np.frombuffer(unpacked(known[bucket]), np.uint8)
    return codes


def census(blocks: DataFrame, keys_of: Callable[[bytes], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(block, answers) from the sorted distinct bucketed keys of each block and their counts there."""

    def rows(found: Iterable[tuple]) -> Iterator[tuple]:
        for block, data in found:
            for bucket, counts in pack_counts(*keys_of(data)):
                yield bucket, block, counts

    sent = map_rows(blocks.select("block", "data"), rows, "bucket int, block bigint, counts binary")
    return answer_counts(sent)
