"""Mixing sources to target weights: a subset-sum fit over exact token lengths.

Documents are counted by source and length. A source's budget is met in whole copies of all its documents, then in a share
of each length's count, and what remains is filled exactly by a bounded-knapsack table over the lengths left. So it is known
how many documents of each length are taken; which ones follows from a seeded hash of the id.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from colonnade.llm.frames import WORD, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Words of a budget that are first left to the exact fill; more and more of them, up to all, where fewer do not meet the budget.
FILL_WORDS, FILL_GROWTH = 1 << 12, 16
#: Documents of one length are told apart by this many ranges of their hash first, and ranked within one range only.
RANGES = 1 << 12


def set_targets(sources: pd.DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> pd.DataFrame:
    """``target`` for each row (source, words) by its place in code-point order, null last.

    Each gets its weight's part of ``share`` times all words; what exceeds ``most`` times a source's words goes to the others by
    weight until none is above.
    """
    rows = sources.copy()
    rank = rows["source"].map(lambda s: (1, b"") if s is None or s != s else (0, s.encode("utf-8", "surrogatepass")))
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: rank.iloc[i])].reset_index(drop=True)
    weight = [weights[i % len(weights)] for i in range(len(rows))]
    words = [float(w) for w in rows["words"]]
    target = [0.0] * len(rows)
    free, left = list(range(len(rows))), share * sum(words)
    while free:
        unit = left / sum(weight[i] for i in free)
        above = [i for i in free if unit * weight[i] > most * words[i]]
        if not above:
            for i in free:
                target[i] = unit * weight[i]
            break
        for i in above:
            target[i] = most * words[i]
            left -= target[i]
        free = [i for i in free if i not in set(above)]
    rows["target"] = target
    return rows


def fit_counts(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their words sum to ``budget``, or as near below it as can be.

    ``counts`` has the number of documents of each length.
    """
    counts = {size: n for size, n in counts.items() if size > 0 and n > 0}
    total = sum(size * n for size, n in counts.items())
    if budget >= total:
        return counts
    if budget <= 0:
        return {}
    # Sums are multiples of what all lengths are multiples of.
    unit = math.gcd(*counts)
    counts, budget, total = {size // unit: n for size, n in counts.items()}, budget // unit, total // unit
    best: dict[int, int] = {}
    fill = FILL_WORDS
    while True:
        taken = _fill(counts, budget, total, fill)
        if _words(taken) > _words(best):
            best = taken
        # With all words left to the fill there is no better sum.
        if _words(best) == budget or fill >= budget:
            return {size * unit: n for size, n in best.items()}
        fill *= FILL_GROWTH


def _words(taken: dict[int, int]) -> int:
    return sum(size * n for size, n in taken.items())


def _fill(counts: dict[int, int], budget: int, total: int, fill: int) -> dict[int, int]:
    """A share of every length's count, and about ``fill`` words by the knapsack table."""
    # The same share of every length, the rounding carried on from long to short, short of what is left to the fill.
    first = max(0, budget - max(fill, min(counts))) if fill < budget else 0
    taken, due = {}, 0.0
    for size in sorted(counts, reverse=True):
        due += counts[size] * size * first / total
        taken[size] = min(counts[size], int(due // size))
        due -= taken[size] * size
    rest = budget - _words(taken)
    for size in sorted(counts, reverse=True):
        # A carry that no shorter length could take up.
        more = min(counts[size] - taken[size], max(0, rest - fill) // size)
        taken[size] += more
        rest -= more * size
    # Sums that can be reached, as the bits of one integer, after each part of each length's count.
    reach, steps, mask = 1, [], (1 << (rest + 1)) - 1
    for size in sorted(counts):
        left, part = min(counts[size] - taken[size], rest // size), 1
        while left and not reach >> rest & 1:
            part = min(part, left)
            steps.append((size, part))
            reach |= (reach << (size * part)) & mask
            left -= part
            part *= 2
    at = reach.bit_length() - 1
    # The way back needs the sums before each step: some are kept, those between them made again.
    stride = max(1, math.isqrt(len(steps)))
    kept, reach = [], 1
    for i, (size, part) in enumerate(steps):
        if i % stride == 0:
            kept.append(reach)
        reach |= (reach << (size * part)) & mask
    for block in range(len(kept) - 1, -1, -1):
        some = steps[block * stride:(block + 1) * stride]
        before = [kept[block]]
        for size, part in some[:-1]:
            before.append(before[-1] | (before[-1] << (size * part)) & mask)
        for (size, part), known in zip(reversed(some), reversed(before)):
            if not known >> at & 1:
                taken[size] += part
                at -= size * part
    return {size: n for size, n in taken.items() if n}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """``id``, ``row`` (hash of the text), ``source``, ``size``, ``source_size``, ``target`` and ``times`` of every row.

    ``times`` is how often the mix takes the row: at most ``ceil(most)``. A null text has size 0 and is never taken, nor is any
    row without words; a null source is a source of its own. Equal rows are told apart by their place among themselves, so
    repeated rows do not all go or stay together. An empty table gives no rows.

    What grows with the number of sources (a row each) is handled in one task; counts by length are handled per source.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = staged(docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(source_col).alias("source"), size.alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.lit(seed)).alias("draw"),
    ), "mix-sizes")
    source_type = sized.schema["source"].dataType.simpleString()
    cell = F.pmod(F.shiftright("draw", 40), F.lit(RANGES)).cast("int")
    histogram = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"))

    def targets(table: pd.DataFrame) -> pd.DataFrame:
        return set_targets(table[["source", "words"]], weights, share, most)

    aims = totals.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(targets, f"source {source_type}, words long, target double")
    same = F.col("source").eqNullSafe(F.col("aim_source"))
    renamed = aims.select(F.col("source").alias("aim_source"), F.col("words").alias("source_size"), "target")

    def counts(table: pd.DataFrame) -> pd.DataFrame:
        budget = round(float(table["target"].iloc[0]))
        words = int(table["source_size"].iloc[0])
        whole = budget // words if words else 0
        sizes = {int(s): int(n) for s, n in zip(table["size"], table["n"])}
        part = fit_counts(sizes, budget - whole * words)
        table["whole"] = whole
        table["part"] = [part.get(int(s), 0) if s > 0 else 0 for s in table["size"]]
        return table[["source", "size", "n", "source_size", "target", "whole", "part"]]

    plan = staged(
        histogram.join(renamed, same).drop("aim_source").groupBy("source")
        .applyInPandas(counts, f"source {source_type}, size long, n long, source_size long, target double, whole long, part long"),
        "mix-plan",
    )
    # Which documents of a length: whole ranges of the hash while they fit, then the first ones within the next range.
    by_cell = sized.groupBy("source", "size", cell.alias("cell")).agg(F.count("*").alias("here"))
    earlier = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = by_cell.withColumn("earlier", F.coalesce(F.sum("here").over(earlier), F.lit(0)))
    p = plan.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "source_size", "target", "whole", "part")
    cells = cells.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).select(
        F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.col("cell").alias("c_cell"), "source_size", "target", "whole",
        (F.col("part") - F.col("earlier")).alias("left"), "here",
    )
    joined = sized.withColumn("cell", cell).join(
        cells, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")) & (F.col("cell") == F.col("c_cell"))
    ).drop("c_source", "c_size", "c_cell")
    split = (F.col("left") > 0) & (F.col("left") < F.col("here"))
    within = Window.partitionBy("source", "size", "cell").orderBy("draw", "id", "row")
    ranked = joined.where(split).withColumn("extra", (F.row_number().over(within) <= F.col("left")).cast("int"))
    even = joined.where(~split).withColumn("extra", (F.col("left") >= F.col("here")).cast("int"))
    return ranked.unionByName(even).select(
        "id", "row", "source", "size", "source_size", "target", (F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0)).alias("times")
    )


def _order(docs: DataFrame):
    """The row, or its text where it has a column without order, so that rows of one id, text and source are always taken alike."""
    plain = not any(kind in t for _, t in docs.dtypes for kind in ("map<", "variant"))
    return F.col("whole") if plain else F.to_json("whole")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with their columns as they were."""
    plan = mix(docs, id_col, text_col, source_col, **settings)
    key = ["id", "row", "source"]
    # Equal rows are numbered on both sides: which of them is meant does not matter, how many does.
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("times"))
    plan = plan.withColumn("nth", nth).where(F.col("times") > 0).select(*(F.col(k).alias(f"p_{k}") for k in (*key, "nth")), "times")
    whole = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("whole"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row"),
        F.col(source_col).alias("source"),
    ).withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(_order(docs))))
    same = F.col("id").eqNullSafe(F.col("p_id")) & (F.col("row") == F.col("p_row")) & F.col("source").eqNullSafe(F.col("p_source"))
    taken = whole.join(plan, same & (F.col("nth") == F.col("p_nth")))
    copies = taken.select("whole", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("again"))
    return copies.select(*(F.col(f"whole.`{c}`").alias(c) for c in docs.columns))
