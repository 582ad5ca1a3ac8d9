"""Exact quantiles without holding a column in one task.

Spark's ``percentile`` keeps every distinct value of a column in one
aggregation buffer. That is the quickest way for little data and impossible for
a lot, so beyond a checked number of cells the wanted ranks are found by
narrowing: a bounded sketch proposes a value for each rank and a narrow
interval around it. The next scan counts exactly what lies below those cuts,
and sketches the proposed interval at the same time, so a round is one scan
with buffers of constant size. An interval that the counts do not confirm is
not used. The sketches only propose where to cut; the counts are exact, and so
is the result. A sketch of no more values than it holds is exact as well, so
three scans do for some 800,000 rows, and each further one for 200 times as
many (``1 / (2 * SKETCH_SLACK)``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import by_task_group, col
from colonnade.session import scratch_path

# ``percentile`` is used while rows x columns stay below this.
DIRECT_CELLS = 200_000
# Size of a sketch, and a margin well above its rank error.
SKETCH_SIZE, SKETCH_SLACK = 8_000, 0.0025


def linear_percentile(x: Column, probabilities: Sequence[float]) -> Column:
    return F.percentile(x, F.array(*[F.lit(float(p)) for p in probabilities]))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    rows: int | None = None,
    direct_cells: int = DIRECT_CELLS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, NULLs left out."""
    columns = list(columns)
    if not columns:
        return {}
    rows = df.count() if rows is None else rows
    if rows * len(columns) <= direct_cells:
        found = df.agg(*[
            linear_percentile(col(c).cast("double"), probabilities).alias(f"q{i}")
            for i, c in enumerate(columns)
        ]).first()
        return {c: list(found[i]) if found[i] is not None else [None] * len(probabilities)
                for i, c in enumerate(columns)}
    return _by_narrowing(df, columns, probabilities)


@dataclass
class _Rank:
    """One order statistic being searched: the ``rank``-th smallest value, from 0.

    It is known to lie strictly between ``low`` and ``high`` (``None`` is
    unbounded); ``below`` values are at or under ``low`` and ``inside`` lie in
    between. ``cuts`` are the values to be counted in the next scan: the bounds
    of the interval that is sketched in it, or twice what the rank has to be.
    """

    column: str
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None
    cuts: tuple[float, ...] = ()

    @property
    def known(self) -> tuple:
        return self.column, self.low, self.high

    @property
    def proposed(self) -> tuple:
        return (self.column, *self.cuts) if self.cuts else self.known

    @property
    def place(self) -> float:
        return (self.rank - self.below + 0.5) / self.inside

    def learn(self, counts: Mapping[float, tuple[int, int]]) -> None:
        """What the numbers of values below each cut, and at or below it, say about this rank.

        The cuts are values from inside the interval, so every round makes it smaller even where the sketch errs.
        """
        for cut in self.cuts:
            less, upto = counts[cut]
            if less <= self.rank < upto:
                self.value = cut
                return
        for cut in self.cuts:
            less, upto = counts[cut]
            if self.rank < less:
                if self.high is None or cut < self.high:
                    self.high, self.inside = cut, less - self.below
            elif self.low is None or cut > self.low:
                self.inside -= upto - self.below
                self.low, self.below = cut, upto


def _between(x: Column, low: float | None, high: float | None) -> Column:
    inside = x.isNotNull()
    if low is not None:
        inside = inside & (x > low)
    if high is not None:
        inside = inside & (x < high)
    return inside


def _by_narrowing(df: DataFrame, columns: list[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    numbers = df.select(*[col(c).cast("double").alias(c) for c in columns])
    # The first scan sketches whole columns and counts their values, from which the ranks follow.
    whole = [(c, None, None) for c in columns]
    stored = _scanned(numbers, whole, [], columns)
    present = dict(zip(columns, stored.select(*[f"present{i}" for i in range(len(columns))]).first()))
    ranks = {
        (c, r): _Rank(c, r, present[c])
        for c in columns for p in probabilities for r in _neighbours(present[c], p)
    }
    open_ranks = list(ranks.values())
    _propose(stored, whole, open_ranks)
    while open_ranks:
        open_ranks = _narrow(numbers, open_ranks)

    def quantile(c: str, p: float) -> float | None:
        near = _neighbours(present[c], p)
        if not near:
            return None
        low, high = ranks[c, near[0]].value, ranks[c, near[-1]].value
        share = p * (present[c] - 1) - near[0]
        return low if share == 0 or low == high else (1 - share) * low + share * high

    return {c: [quantile(c, p) for p in probabilities] for c in columns}


def _neighbours(n: int, p: float) -> list[int]:
    """The ranks between which the quantile is interpolated."""
    if n == 0:
        return []
    position = p * (n - 1)
    below = int(position)
    return [below] if position == below else [below, min(below + 1, n - 1)]


def _scanned(numbers: DataFrame, intervals: list[tuple], cuts: list[tuple], counted: Sequence[str] = ()) -> DataFrame:
    """One row: a sketch of every interval, the counts around every cut, and the counts of whole columns.

    The buffers of all tasks are merged in groups first, then once more: one
    task merging them all would be the bottleneck of a large table. The row
    they end in is written, as it is asked for counts first and then for the
    values at places that follow from these.
    """
    gathered, merged = [], []
    for i, (c, low, high) in enumerate(intervals):
        gathered.append(F.kll_sketch_agg_double(F.when(_between(col(c), low, high), col(c)), SKETCH_SIZE).alias(f"sketch{i}"))
        merged.append(F.kll_merge_agg_double(f"sketch{i}").alias(f"sketch{i}"))
    counts = [(f"present{i}", F.count(col(c))) for i, c in enumerate(counted)]
    for i, (c, cut) in enumerate(cuts):
        counts += [(f"less{i}", F.count_if(col(c) < cut)), (f"upto{i}", F.count_if(col(c) <= cut))]
    gathered += [count.alias(name) for name, count in counts]
    merged += [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name, _ in counts]
    spark, path = numbers.sparkSession, scratch_path(numbers.sparkSession, "sketches")
    row = by_task_group(numbers).agg(*gathered).agg(*merged)
    row.write.parquet(path)
    return spark.read.schema(row.schema).parquet(path)


def _propose(stored: DataFrame, intervals: list[tuple], ranks: list[_Rank]) -> None:
    """New cuts from the sketches.

    A rank that does not lie where it was proposed has no sketch; its known
    interval, which the counts have cut, is sketched in the next round.
    """
    number = {interval: i for i, interval in enumerate(intervals)}
    for r in ranks:
        r.cuts = ()
    groups = _neighbouring([r for r in ranks if r.known in number])
    if not groups:
        return
    found = stored.select(*[
        F.kll_sketch_get_quantile_double(f"sketch{number[g[0].known]}", F.array(*[F.lit(p) for p in _places(g)])).alias(f"g{i}")
        for i, g in enumerate(groups)
    ]).first()
    for group, values in zip(groups, found):
        for r in group:
            r.cuts = tuple(values)


def _neighbouring(ranks: list[_Rank]) -> list[list[_Rank]]:
    """Ranks that are cut out of one known interval together; each by itself where the sketch is exact."""
    groups: list[list[_Rank]] = []
    for r in sorted(ranks, key=lambda r: (str(r.known), r.place)):
        last = groups[-1][-1] if groups else None
        if last and last.known == r.known and r.place - last.place <= SKETCH_SLACK and r.inside > SKETCH_SIZE // 2:
            groups[-1].append(r)
        else:
            groups.append([r])
    return groups


def _places(group: list[_Rank]) -> list[float]:
    """Where to cut: a little before and after the ranks, or at the rank."""
    low, high = group[0].place, group[-1].place
    if group[0].inside <= SKETCH_SIZE // 2:
        return [low, high]
    return [max(0.0, low - SKETCH_SLACK), min(1.0, high + SKETCH_SLACK)]


def _narrow(numbers: DataFrame, ranks: list[_Rank]) -> list[_Rank]:
    """One round: counts around the cuts and sketches between them, from one scan; returns the ranks still open."""
    # Nothing lies between two equal cuts.
    intervals = [i for i in dict.fromkeys(r.proposed for r in ranks) if i[1] is None or i[1] != i[2]]
    cuts = sorted({(r.column, cut) for r in ranks for cut in r.cuts})
    stored = _scanned(numbers, intervals, cuts)
    counts = stored.select(*[f"{side}{i}" for i in range(len(cuts)) for side in ("less", "upto")]).first() if cuts else ()
    around: dict[str, dict[float, tuple[int, int]]] = {}
    for i, (c, cut) in enumerate(cuts):
        around.setdefault(c, {})[cut] = counts[2 * i], counts[2 * i + 1]
    for r in ranks:
        r.learn(around.get(r.column, {}))
    still = [r for r in ranks if r.value is None]
    _propose(stored, intervals, still)
    return still
