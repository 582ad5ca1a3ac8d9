"""Quality rules: a decision list learned by sequential covering.

Statistics of every text are counted once per row. From labelled rows, rules are grown one after another: conditions
``statistic <= cut`` or ``statistic >= cut`` are added to a conjunction while they raise the gain on one part of the rows,
and taken off again from the end while that helps on the other part. A rule that holds up there joins the list and the rows
it covers are taken out. The list is an ordered Spark CASE expression; rows that no rule covers are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from colonnade.llm.frames import map_rows, mapped, utf8

SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: Labelled rows that the rules are learned from: those with the smallest hash of their id.
TRAIN_ROWS = 20_000
#: Share of the rows that rules are grown on; the others prune them.
GROW_SHARE = 2 / 3
#: A rule has to reject at least this share of bad rows among those it covers in the pruning part.
MIN_PRECISION = 0.9
MIN_COVERED = 5
MAX_RULES = 24
MAX_CONDITIONS = 4
#: Cuts tried for each statistic: quantiles of the rows at hand.
CUTS = 48

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_chars_all", "n_lines", "n_distinct", "n_upper", "n_marks", "n_bars", "n_digits", "n_ends")
STATS = (*BASE, *MORE)
UPPER, MARKS, DIGITS = re.compile(rb"[A-Z]"), re.compile(rb"[!?]"), re.compile(rb"[0-9]")

#: Ratios that conditions are stated in, as (name, numerator, denominator).
RATIOS = (
    ("word_length", "word_chars", "n_words"), ("symbol_share", "n_symbols", "n_words"), ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"), ("distinct_share", "n_distinct", "n_words"), ("upper_share", "n_upper", "word_chars"),
    ("mark_share", "n_marks", "n_words"), ("bar_share", "n_bars", "n_words"), ("digit_share", "n_digits", "word_chars"),
    ("end_share", "n_ends", "n_words"), ("line_words", "n_words", "n_lines"),
)
FEATURES = (*BASE, *(name for name, _, _ in RATIOS))


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of a text; null counts like an empty text, which has no words."""
    raw = utf8(text)
    words = raw.split()
    n = len(words)
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    repeats = 0
    for line in lines:
        if line.strip():
            repeats += line in seen
            seen.add(line)
    text = text or ""
    n_upper = len(UPPER.findall(raw)) if raw.isascii() else sum(map(str.isupper, text))
    ends = sum(w[-1:] in b".!?" for w in words)
    word_chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    return (
        n, word_chars, len(SYMBOLS.findall(raw)), repeats, repeated_words(words), len(text), len(lines), len(set(words)), n_upper,
        len(MARKS.findall(raw)), raw.count(b"|"), len(DIGITS.findall(raw)), ends,
    )


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    hit = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(n, bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and STATS of every row, repeated rows included."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def rows(found: Iterable[tuple]) -> Iterator[tuple]:
        for doc, text in found:
            yield doc, *text_stats(text)

    shape = f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{s} bigint" for s in STATS)
    return map_rows(source, rows, shape)


def feature_columns() -> dict[str, Column]:
    """FEATURES as expressions over STATS; a ratio with nothing below it is 0."""
    found = {s: F.col(s).cast("double") for s in BASE}
    for name, above, below in RATIOS:
        found[name] = F.coalesce(F.try_divide(F.col(above).cast("double"), F.col(below).cast("double")), F.lit(0.0))
    return found


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] >= self.cut if self.at_least else table[self.feature] <= self.cut

    def column(self, columns: dict[str, Column]) -> Column:
        return columns[self.feature] >= self.cut if self.at_least else columns[self.feature] <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for condition in rule:
        hit &= condition.holds(table)
    return hit


def _gain(bad: np.ndarray, good: np.ndarray, bad0: int, good0: int) -> np.ndarray:
    """How many bits narrowing to (bad, good) saves on the bad rows that stay covered."""
    share = np.maximum(bad, 1e-9) / np.maximum(bad + good, 1e-9)
    return bad * (np.log2(share) - np.log2(bad0 / (bad0 + good0)))


def _grow(table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    hit = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (hit & ~bad).any():
        bad0, good0 = int((hit & bad).sum()), int((hit & ~bad).sum())
        best, best_gain = None, 1e-6
        for feature, values in table.items():
            inside, is_bad = values[hit], bad[hit]
            cuts = np.unique(np.quantile(np.concatenate([inside, inside[is_bad]]), np.linspace(0, 1, CUTS)))
            order = np.argsort(inside, kind="stable")
            ranked = inside[order]
            sums = np.concatenate([[0], np.cumsum(is_bad[order])])
            for at_least in (True, False):
                at = np.searchsorted(ranked, cuts, "left" if at_least else "right")
                n_bad = sums[-1] - sums[at] if at_least else sums[at]
                n_good = (len(ranked) - at if at_least else at) - n_bad
                gains = _gain(n_bad, n_good, bad0, good0)
                i = int(np.argmax(gains))
                if gains[i] > best_gain:
                    best, best_gain = Condition(feature, at_least, float(cuts[i])), gains[i]
        if best is None:
            break
        rule += (best,)
        hit &= best.holds(table)
    return rule


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, int, int]:
    """The best beginning of ``rule`` on other rows, with the bad and good rows it covers there."""
    best = (-2.0, rule, 0, 0)
    for k in range(len(rule), 0, -1):
        hit = covered(rule[:k], table, len(bad))
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, rule[:k], p, n)
    return best[1:]


def learn_rules(table: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """Rules that reject, in the order they were found; none if no rows are bad or all are."""
    if not bad.any() or bad.all():
        return []
    grow = np.random.default_rng(seed).random(len(bad)) < GROW_SHARE
    rules, left = [], np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        a, b = left & grow, left & ~grow
        if not (bad & a).any():
            break
        rule = _grow({k: v[a] for k, v in table.items()}, bad[a])
        rule, p, n = _prune(rule, {k: v[b] for k, v in table.items()}, bad[b])
        if not rule or p < MIN_COVERED or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        left &= ~covered(rule, table, len(bad))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional: False at the first rule that covers the row, else True."""
    columns = feature_columns()
    out = None
    for rule in rules:
        hit = F.lit(True)
        for condition in rule:
            hit = hit & condition.column(columns)
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules learned from at most ``train_rows`` labelled rows, which alone come to the driver, as numbers.

    Rows that the base rules reject anyway teach nothing. An id with two labels counts as the lower one; null labels and
    ids are not used. Without labels there are no rules.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("key")).agg(F.min(label_col).alias("label"))
        .orderBy(F.xxhash64("key"), "key").limit(train_rows)
    )
    # At most train_rows ids and labels are broadcast.
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("body")).join(F.broadcast(known), "key")
    stats = with_stats(rows.select(F.struct("key", "label").alias("who"), "body"), "who", "body")
    # Copies of one labelled id would exceed the bound; the one with the smallest numbers stands for all.
    numbers = stats.where(~base_failed()).select("id.key", "id.label", F.struct(*(c.alias(f) for f, c in feature_columns().items())).alias("numbers"))
    one = numbers.groupBy("key", "label").agg(F.min("numbers").alias("numbers"))
    table = one.select("key", "label", "numbers.*").toPandas().sort_values("key")
    return learn_rules({f: table[f].to_numpy(float) for f in FEATURES}, table["label"].to_numpy() == 0)


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the base statistics, ``base_failed`` and ``kept`` of every row."""
    stats = with_stats(docs, id_col, text_col)
    return stats.select("id", *BASE, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they were."""
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("source"))
    counted = mapped(lambda text: dict(zip(STATS, text_stats(text))), "struct<" + ", ".join(f"{s}: bigint" for s in STATS) + ">")
    # Only the text goes to Python, and only numbers come back.
    stats = whole.select("source", counted(F.col(f"source.`{text_col}`")).alias("stats")).select("source", "stats.*")
    judged = stats.where(~base_failed() & verdict(rules))
    return judged.select(*(F.col(f"source.`{c}`").alias(c) for c in docs.columns))
