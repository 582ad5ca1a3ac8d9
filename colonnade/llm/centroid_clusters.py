"""Clusters around centroids, with distance bounds that outlive many rounds.

A vector keeps the distances to all centroids that it had when it was last compared with them, and the round of that. All
centroids of all rounds are kept as well. A stored distance to a centroid can have shrunk (or, to the own one, grown) by no
more than the length of that centroid's whole way since then, as the crow flies, and not by the sum of its ways per round.
Only vectors whose bounds, loosened so, do not decide are compared with all centroids again, exactly. A bound decides only
where it proves a strictly larger distance, so ties are always compared.

Components are integers and all sums and distances exact. Vectors lie in packed blocks, which each round reads and writes with
their bounds; the sums of a round leave a task as one row and are added up by an aggregate. So nothing depends on how vectors
are spread, and many copies of one vector cost no more than others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from colonnade.llm.blocks import packed, unpacked
from colonnade.llm.frames import map_rows, staged

#: Vectors in a block.
BLOCK = 4096
#: Components up to this size: products of 64 and more of them are exact in doubles. Others are Python integers.
EXACT = 1 << 20
LIMB = 10**18
MOST = 2**63 - 1
#: Stored distances are first made smaller by LESS, then cut to half precision, and lie below the true ones by less than the
#: share CUT; computed ones are good to a far smaller one.
LESS, CUT, SLACK = 2.0**-10, 2.0**-8, 1e-9


def kept_vectors(vectors: DataFrame, dims: int, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``x`` (whole numbers as doubles) of the vectors with ``dims`` components, none of them null or not finite."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    found = vectors.select(F.col(id_col).alias("id"), x.alias("x")).where((F.size("x") == dims) & ~odd)
    # floor() of a column would be a long, which large components leave.
    return found.select("id", F.transform("x", lambda v: v * F.lit(float(scale))).alias("x"))


def whole(x: np.ndarray) -> np.ndarray:
    """Rounded down, as 64-bit integers if all are small, else as Python integers."""
    x = np.floor(x)
    if not x.size or np.abs(x).max() <= EXACT:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All squared distances, exactly."""
    if x.dtype == object or centroids.dtype == object:
        x, centroids = x.astype(object), centroids.astype(object)
        return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    a, b = x.astype(np.float64), centroids.astype(np.float64)
    return (((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T)) + (b * b).sum(axis=1)[None, :]).astype(np.int64)


def to_own(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - centroids[cluster]) ** 2).sum(axis=1)


def roots(squares: np.ndarray) -> np.ndarray:
    """Square roots as doubles; infinity beyond those, which decides nothing."""
    if squares.dtype == object and squares.size and max(squares.ravel()) >= 10**300:
        found = [math.sqrt(v) if v < 10**300 else float(r) if (r := math.isqrt(v)) < 10**300 else math.inf for v in squares.ravel()]
        return np.array(found).reshape(squares.shape)
    return np.sqrt(squares.astype(np.float64))


def ways(history: list[np.ndarray]) -> np.ndarray:
    """How far each centroid lies now from where it was in each round, a little more at least: [round, centroid]."""
    now = history[-1]
    return np.stack([roots(((now - old) ** 2).sum(axis=1)) for old in history]) * (1 + SLACK)


class Bounds:
    """Cluster, round of the last comparison, and the distances found then, of a block's vectors."""

    def __init__(self, cluster: np.ndarray, seen: np.ndarray, low: np.ndarray):
        self.cluster, self.seen, self.low = cluster, seen, low

    @classmethod
    def none(cls, n: int, k: int) -> Bounds:
        """Bounds that decide nothing."""
        return cls(np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros((n, k), np.float16))

    def pack(self) -> bytes:
        return packed(self.cluster.tobytes() + self.seen.tobytes() + np.ascontiguousarray(self.low).tobytes())

    @classmethod
    def unpack(cls, data: bytes, n: int, k: int) -> Bounds:
        raw = unpacked(data)
        cluster, seen = (np.frombuffer(raw, np.int32, n, 4 * n * i).copy() for i in range(2))
        return cls(cluster, seen, np.frombuffer(raw, np.float16, n * k, 8 * n).reshape(n, k).copy())


def reassign(x: np.ndarray, bounds: Bounds, history: list[np.ndarray]) -> int:
    """Moves each vector to its nearest present centroid, of equally near ones the first; returns how many had to be compared."""
    now, rows = history[-1], np.arange(len(x))
    if len(history) == 1:
        again = rows
    else:
        way = ways(history)[bounds.seen]
        low = bounds.low.astype(np.float64) * (1 - SLACK) - way
        # The own centroid's stored distance was cut by at most CUT of it.
        own = bounds.low[rows, bounds.cluster].astype(np.float64)
        high = np.where(own < 60_000, own / (1 - CUT) + 2.0**-13 + way[rows, bounds.cluster], np.inf)
        low[rows, bounds.cluster] = np.inf
        nearest_other = low.min(axis=1)
        doubtful = np.flatnonzero(nearest_other <= high)
        # The exact distance to the own centroid often decides.
        exact = roots(to_own(x[doubtful], now, bounds.cluster[doubtful])) * (1 + SLACK)
        again = doubtful[nearest_other[doubtful] <= exact]
    if len(again):
        distances = squared(x[again], now)
        bounds.cluster[again] = np.argmin(distances, axis=1)
        bounds.seen[again] = len(history) - 1
        cut = roots(distances) * (1 - LESS)
        bounds.low[again] = np.nextafter(np.minimum(cut, 65_000).astype(np.float16), np.float16(0))
    return len(again)


def limbs(values: np.ndarray) -> list[int]:
    """Whole numbers of any size as 64-bit parts: all lowest ones, then all second ones, and so on."""
    if values.dtype != object:
        return values.ravel().tolist()
    left, out = [int(v) for v in values.ravel()], []
    while True:
        if all(-LIMB < v < LIMB for v in left):
            return out + left
        out += [v % LIMB for v in left]
        left = [v // LIMB for v in left]


def pack_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """Written rows (n, ids, data, state, sums): a block's vectors, with bounds that decide nothing; ``sums`` is null."""

    def rows(found: Iterable[tuple]) -> Iterator[tuple]:
        ids, held = [], []

        def block() -> tuple:
            x = np.floor(np.array(held, dtype=np.float64))
            small = np.abs(x).max() < 32_768
            kind = b"s" if small else b"d"
            data = kind + packed(x.astype(np.int16).view(np.uint8).reshape(len(x), -1).T.tobytes() if small else x.tobytes())
            return len(ids), ids, data, Bounds.none(len(ids), k).pack(), None

        for vec, x in found:
            ids.append(vec)
            held.append(x)
            if len(ids) >= BLOCK:
                yield block()
                ids, held = [], []
        if ids:
            yield block()

    source = vectors.select(F.col("id").cast("long").alias("id"), "x")
    return staged(map_rows(source, rows, PACKED, 4), "vector-blocks")


PACKED = "n int, ids array<bigint>, data binary, state binary, sums array<bigint>"


def unpack_vectors(data: bytes, n: int) -> np.ndarray:
    raw = unpacked(data[1:])
    if data[:1] == b"s":
        return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).view(np.int16).astype(np.int64)
    return whole(np.frombuffer(raw, np.float64).reshape(n, -1))


def assigned(blocks: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """The blocks with new bounds, and from each task a row of ``sums``: by cluster the number of vectors and their sum."""
    k, dims = history[-1].shape

    def rows(found: Iterable[tuple]) -> Iterator[tuple]:
        total = np.zeros((k, dims + 1), np.int64)
        for n, ids, data, state in found:
            x, bounds = unpack_vectors(data, n), Bounds.unpack(state, n, k)
            reassign(x, bounds, history)
            if x.dtype == object:
                total = total.astype(object)
            for c in np.unique(bounds.cluster):
                mine = bounds.cluster == c
                total[c, 0] += int(mine.sum())
                total[c, 1:] += x[mine].sum(axis=0)
            yield n, ids, data, bounds.pack(), None
        if total.any():
            yield 0, None, None, None, limbs(total)

    return staged(map_rows(blocks.where("n > 0").select("n", "ids", "data", "state"), rows, PACKED, 4), "vector-bounds")


def moved(blocks: DataFrame, last: np.ndarray) -> np.ndarray:
    """The next centroids: the sums of their vectors divided by their number, rounded down; those without vectors stay.

    What reaches the driver is a row for each component of each centroid.
    """
    k, dims = last.shape
    cells = blocks.where("n = 0").select(F.posexplode("sums").alias("cell", "part")).where("part != 0")
    sums = {r["cell"]: int(r["total"]) for r in cells.groupBy("cell").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()}
    width, out = k * (dims + 1), last.astype(object)
    total = [0] * width
    for cell, part in sums.items():
        total[cell % width] += part * LIMB ** (cell // width)
    for c in range(k):
        n, *components = total[c * (dims + 1):(c + 1) * (dims + 1)]
        if n:
            out[c] = [v // n for v in components]
    return out.astype(np.int64) if all(abs(v) <= EXACT for v in out.ravel()) else out


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors, or as many as there are, whose ids have the smallest SHA-256 behind ``salt``; of one id the smallest vectors."""
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = vectors.select(order.alias("order"), "x").orderBy("order", "x").limit(k).collect()
    return whole(np.array([r["x"] for r in found], dtype=np.float64)) if found else np.zeros((0, 0), np.int64)


def cluster(
    vectors: DataFrame, k: int, rounds: int, scale: float = 256.0, dims: int = 64, salt: str = "2:",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> tuple[DataFrame, list[np.ndarray]]:
    """``id``, ``cluster``, ``distance`` of each kept vector after ``rounds`` moves of the centroids, and all centroids by round.

    ``distance`` is squared, and the largest long where it is larger. Vectors of another length, or with null or not finite
    components, are left out; null ids stay. Repeated rows count each. With fewer vectors than ``k`` there are as many
    centroids; without any the result is empty.
    """
    kept = kept_vectors(vectors, dims, scale, id_col, vector_col)
    history = [first_centroids(kept, k, salt)]
    if not len(history[0]):
        nothing = kept.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return nothing, history
    blocks = pack_vectors(kept, len(history[0]))
    for _ in range(rounds):
        blocks = assigned(blocks, history)
        history.append(moved(blocks, history[-1]))
    many = len(history[0])

    def rows(found: Iterable[tuple]) -> Iterator[tuple]:
        for n, ids, data, state in found:
            x, bounds = unpack_vectors(data, n), Bounds.unpack(state, n, many)
            reassign(x, bounds, history)
            now = history[-1] if x.dtype != object else history[-1].astype(object)
            for vec, c, d in zip(ids, bounds.cluster.tolist(), to_own(x, now, bounds.cluster)):
                yield vec, c, min(int(d), MOST)

    found = map_rows(blocks.where("n > 0").select("n", "ids", "data", "state"), rows, "id bigint, cluster int, distance bigint")
    return staged(found, "clusters"), history


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def with_inertia(found: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """``cluster``'s rows with ``cluster_inertia``, ``inertia`` (sums of distances, at most the largest long) and ``centroid_sha256``."""
    capped = lambda total: F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long")
    by_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()
    sums = {r["cluster"]: int(r["sum"]) for r in by_cluster}
    # A row for each centroid.
    rows = [(c, min(s, MOST), min(sum(sums.values()), MOST), centroid_digest(history[-1][c])) for c, s in sorted(sums.items())]
    known = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int, rounds: int, dims: int) -> str:
    """The same rows in DuckDB: every distance in every round, for components whose squares a long holds."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
    pairs{r} AS (SELECT rid, c, d FROM (SELECT rid, c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS d FROM cells v JOIN centroid{r} m USING (i) GROUP BY rid, c)),
    own{r} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM pairs{r} GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""
    moved{r} AS (SELECT c, i, CAST(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS BIGINT) AS x FROM (
        SELECT c, i, sum(x) AS s, count(*) AS n FROM own{r} JOIN cells USING (rid) GROUP BY c, i)),
    centroid{r + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce(m.x, o.x) AS x FROM centroid{r} o LEFT JOIN moved{r} m USING (c, i))""")
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    cells AS MATERIALIZED (SELECT rid, unnest(range(1, {dims + 1})) AS i, unnest(x) AS x FROM kept),
    first AS (SELECT rid, row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c FROM kept QUALIFY c < {k}),
    centroid0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN cells USING (rid)),{",".join(steps)},
    digest AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM centroid{rounds} GROUP BY c)
    SELECT vec_id, CAST(c AS INTEGER) AS "cluster", d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
    FROM own{rounds} JOIN kept USING (rid) JOIN digest USING (c)"""
