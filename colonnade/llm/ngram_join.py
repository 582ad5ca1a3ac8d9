"""N-gram Jaccard join by a prefix tree.

A document's set has its distinct shingles of five words, in one order for all documents: rare ones first. Two sets that are
alike enough share a shingle among the first of both, so a set whose first ones occur nowhere else has no partner. Equal sets
are one. The others fall into families that share first shingles. A family's sets are stored in a prefix tree whose edges
hold runs of shingles; each set walks down the tree and adds up its overlap once for all sets below, turning back where even
all that remains could not reach the threshold. A family too large for a task is cut into parts, and each pair of parts is
a task, so nothing is left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from colonnade.llm.blocks import NO_ID, bucket_count, bucketed, census, mixed, pack_documents, spread_codes, unpack_block
from colonnade.llm.components import components
from colonnade.llm.frames import map_rows, staged

WORDS = 5
#: Similarity in hundredths.
LEAST = 75
#: Sets of a family that a task handles at once, and shingles of them all; larger families are joined part by part.
PART, PART_SHINGLES = 1024, 600_000
#: Words whose hash a worker remembers, while it works on one block.
KNOWN_WORDS = 100_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORD_HASH = _WordHash()


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles: the whole sequence if it is shorter, none without words."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_WORD_HASH.__getitem__, found), np.uint64, len(found))
    n = max(1, len(found) - words + 1)
    total = np.full(n, min(len(found), words), np.uint64)
    for k in range(min(words, len(found))):
        total = (total * _PRIME) ^ mixed(hashes[k:k + n] + np.uint64(k))
    return np.unique(mixed(total))


def first_needed(n: int, least: int = LEAST) -> int:
    """How many first shingles of a set of ``n`` to look at: a similar set has at least one of them."""
    return n - -(-least * n // 100) + 1


def alike(common: int, a: int, b: int, least: int = LEAST) -> bool:
    return 100 * common >= least * (a + b - common)


def overlap_needed(a: int, b: int, least: int = LEAST) -> int:
    """The least number of common shingles of sets of these sizes that are alike."""
    return -(-least * (a + b) // (100 + least))


# --- sets of documents

def _block_sets(data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    ids, bounds, text = unpack_block(data)
    empty = np.zeros(0, np.uint64)
    _WORD_HASH.clear()
    return ids, [shingles(text[a:b]) if doc != NO_ID else empty for doc, a, b in zip(ids.tolist(), bounds[:-1].tolist(), bounds[1:].tolist())]


def _block_keys(data: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    _, sets = _block_sets(data)
    return np.unique(bucketed(np.concatenate(sets), buckets), return_counts=True)


def _ordered_sets(data: bytes, answers: list | None, buckets: int, least: int) -> Iterator[tuple]:
    """(id, n, digest, unique, tokens, codes) of each document; the last two null if it has no partner or is no first copy here."""
    ids, sets = _block_sets(data)
    keys = [bucketed(s, buckets) for s in sets]
    distinct = np.unique(np.concatenate(keys))
    codes_of = spread_codes(distinct, answers)
    sent = set()
    for doc, found, key in zip(ids.tolist(), sets, keys):
        n = len(found)
        own = None if doc == NO_ID else doc
        digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if n else None
        codes = codes_of[np.searchsorted(distinct, key)]
        unique = int((codes == 0).sum())
        if not n or unique >= first_needed(n, least):
            yield own, n, digest, None, None, None
            continue
        if digest in sent:
            yield own, n, digest, unique, None, None
            continue
        sent.add(digest)
        order = np.lexsort((found, codes))[unique:]
        yield own, n, digest, unique, found[order].astype("<u8").tobytes(), codes[order].tobytes()


# --- prefix tree

class Tree:
    """A prefix tree over ordered token lists; an edge holds the run of tokens that the sets below share.

    ``order`` lists the sets by their tokens, so that each node's sets are a range of it.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sets, self.sizes = sets, sizes
        # Large numbers first in bytes: they sort as the lists of numbers do.
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        ordered = [sets[i] for i in self.order]
        self.shared = [0] + [_common(a, b) for a, b in zip(ordered, ordered[1:])] + [0]
        #: Nodes as (from depth, to depth, first set, end of sets, fewest shingles, longest rest, children).
        self.roots = self._build(0, len(ordered), 0) if ordered else []

    def _build(self, a: int, b: int, depth: int) -> list[tuple]:
        nodes: list[tuple] = []
        stack = [(a, b, depth, nodes)]
        while stack:
            a, b, depth, into = stack.pop()
            at = a
            while at < b:
                end = at + 1
                while end < b and self.shared[end] > depth:
                    end += 1
                lists = [self.sets[i] for i in self.order[at:end]]
                to = min(self.shared[at + 1:end], default=len(lists[0]))
                children: list[tuple] = []
                fewest = min(self.sizes[i] for i in self.order[at:end])
                rest = max(map(len, lists)) - to
                into.append((depth, to, at, end, fewest, rest, children))
                if end - at > 1:
                    # Sets that end here come first; the rest go on below.
                    done = at
                    while done < end and len(self.sets[self.order[done]]) == to:
                        done += 1
                    if done < end:
                        stack.append((done, end, to, children))
                at = end
        return nodes


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def tree_links(tokens: list[np.ndarray], codes: list[np.ndarray], sizes: list[int], stored: list[int], probes: list[int], least: int = LEAST) -> list[tuple[int, int]]:
    """Links that connect whatever of ``probes`` is alike to something of ``stored``; not those between connected sets.

    Sets are given by their shared tokens in order, with the codes that the order follows, and their full sizes.
    """
    everything = np.concatenate(tokens)
    distinct, first = np.unique(everything, return_index=True)
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((distinct, np.concatenate(codes)[first]))] = np.arange(len(distinct))
    local = [rank[np.searchsorted(distinct, t)] for t in tokens]
    tree = Tree([local[i] for i in stored], [sizes[i] for i in stored])
    union, links = Union(len(tokens)), []
    mine = np.zeros(len(distinct), bool)
    for x in probes:
        mine[local[x]] = True
        have, size = local[x].tolist(), sizes[x]
        stack = [(node, 0) for node in tree.roots]
        while stack:
            (depth, to, a, b, fewest, rest, children), common = stack.pop()
            some = tree.sets[tree.order[a]]
            needed = overlap_needed(size, fewest, least)
            # Before the edge: all of the rest may match, but not more than x has from here on.
            left = len(have) - bisect_left(have, int(some[depth])) if to > depth else len(have)
            if common + min(left, to - depth + rest) < needed:
                continue
            if b - a == 1 and union.find(stored[tree.order[a]]) == union.find(x):
                continue
            common += int(np.count_nonzero(mine[some[depth:to]]))
            if common + rest < needed:
                continue
            for k in range(a, b if not children else children[0][2]):
                y = stored[tree.order[k]]
                if y != x and union.find(y) != union.find(x) and alike(common, size, sizes[y], least):
                    union.join(x, y)
                    links.append((x, y))
            stack.extend((child, common) for child in children)
        mine[local[x]] = False
    return links


def _family_links(table, least: int):
    """Links within one task: part against part of a family, or a part with itself."""
    import pyarrow as pa

    rows = {}
    for digest, n, tokens, codes, part in zip(*(table.column(c).to_pylist() for c in ("digest", "n", "tokens", "codes", "part"))):
        rows[digest] = (n, np.frombuffer(tokens, "<u8").astype(np.uint64), np.frombuffer(codes, np.uint8), part)
    names = sorted(rows)
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    stored = [i for i, d in enumerate(names) if rows[d][3] == low]
    probes = [i for i, d in enumerate(names) if rows[d][3] == high]
    found = tree_links([rows[d][1] for d in names], [rows[d][2] for d in names], [rows[d][0] for d in names], stored, probes, least)
    return pa.table({"a": pa.array([names[i] for i, _ in found], pa.binary()), "b": pa.array([names[j] for _, j in found], pa.binary())})


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``id``, ``n_shingles`` and ``component``: the smallest id that links reach from the row's, itself included.

    A-Z are lower-cased, words are split at white space. Fewer than five words are one shingle; without words the set is empty
    and the row is linked with nothing, nor is a row without an id, whose component is null. Rows with equal sets are linked.
    Repeated rows give repeated results, an empty table none; other columns are not read.
    """
    blocks = pack_documents(docs, id_col, text_col)
    buckets = bucket_count(blocks)
    answers = census(blocks, lambda data: _block_keys(data, buckets))

    def order(rows: Iterable[tuple]) -> Iterator[tuple]:
        for data, found in rows:
            yield from _ordered_sets(data, found, buckets, least)

    whole = blocks.join(answers.hint("merge"), "block", "left").select("data", "answers")
    shape = "id bigint, n bigint, digest binary, own int, tokens binary, codes binary"
    ordered = staged(map_rows(whole, order, shape), "shingle-sets")
    # Equal sets once, under the hash of the set.
    sets = staged(
        ordered.where(F.col("own").isNotNull()).groupBy("digest").agg(
            F.max("n").alias("n"), F.max("own").alias("own"), F.max(F.struct("tokens", "codes")).alias("set")
        ).select("digest", "n", "own", "set.tokens", "set.codes"),
        "distinct-sets",
    )
    links = staged(_links(sets, least), "similar-sets")
    grouped = components(links)
    firsts = ordered.where(F.col("own").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"))
    labelled = firsts.join(grouped, F.col("digest") == F.col("node"), "left").select("digest", "first", F.coalesce("label", "digest").alias("label"))
    labelled = staged(labelled, "set-labels")
    least_id = labelled.groupBy("label").agg(F.min("first").alias("component"))
    by_set = labelled.join(least_id, "label").select(F.col("digest").alias("set_digest"), "component")
    joined = ordered.select("id", "n", F.when(F.col("own").isNotNull(), F.col("digest")).alias("digest"))
    # Rows without a partner keep away from the join: they have no key to meet on.
    met = joined.where("digest is not null").join(by_set, F.col("digest") == F.col("set_digest"))
    alone = joined.where("digest is null")
    return met.select("id", F.col("n").alias("n_shingles"), "component").unionByName(
        alone.select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component"))
    )


def _links(sets: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of digests of similar sets: enough of them to connect all that are linked."""

    def postings(rows: Iterable[tuple]) -> Iterator[tuple]:
        for digest, n, own, tokens in rows:
            key = int.from_bytes(digest[:8], "little", signed=True)
            for token in np.frombuffer(tokens, "<i8", first_needed(n, least) - own).tolist():
                yield token, key

    # Keys shorten the digests; sets that share one only land in one family.
    listed = staged(map_rows(sets.select("digest", "n", "own", "tokens"), postings, "token bigint, key bigint", 65536), "first-shingles")
    lists = listed.groupBy("token").agg(F.min("key").alias("head"), F.max("key").alias("other")).where(F.col("head") != F.col("other")).drop("other")
    met = listed.join(lists, "token").where(F.col("key") != F.col("head")).select("key", "head").distinct()
    families = components(met, "key", "head")
    lengths = map_rows(sets.select("digest", "n"), lambda rows: ((int.from_bytes(d[:8], "little", signed=True), n) for d, n in rows), "key bigint, n bigint")
    load = F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("n") / PART_SHINGLES))
    sizes = families.join(lengths, F.col("node") == F.col("key")).groupBy("label").agg(load.cast("int").alias("parts"))
    families = families.join(sizes, "label")
    keyed = map_rows(
        sets, lambda rows: ((int.from_bytes(d[:8], "little", signed=True), d, n, t, c) for d, n, _, t, c in rows),
        "key bigint, digest binary, n bigint, tokens binary, codes binary",
    )
    placed = keyed.join(families, F.col("key") == F.col("node")).withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    # Each part meets itself and every other part of its family, in a task for each pair.
    pairs = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "label", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "digest", "n", "tokens", "codes"
    )
    return pairs.groupBy("label", "low", "high").applyInArrow(lambda table: _family_links(table, least), "a binary, b binary")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` but for those that are linked to a smaller id, with their columns as they were.

    Of repeated rows of the id that stays, all stay; so do rows without words or id.
    """
    groups = similar_groups(docs, id_col, text_col, least)
    gone = groups.where(F.col("id") != F.col("component")).select(F.col("id").alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
