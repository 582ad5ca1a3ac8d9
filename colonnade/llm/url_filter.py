"""URL filters: lists of host and path rules, then association rules mined from labelled urls.

FP-growth finds combinations of url tokens that go with a label often enough and surely enough. A rule that a shorter one
makes needless is dropped. The rest are indexed by their rarest token, so a url looks only at rules that one of its own
tokens leads to.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from colonnade.llm.frames import map_rows, staged

#: Labelled rows that rules are mined from: those with the smallest hash of id and url.
TRAIN_ROWS = 50_000
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.7
MIN_LIFT = 1.5
#: Where so high a lift cannot be: the part of the way from the share of bad rows to 1, and standard errors above that share.
MIN_GAIN = 1 / 3
MIN_SURE = 3.0
MIN_ROWS = 10
MAX_ITEMS = 3
BLOCK, ALLOW = "block", "allow"


def _lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest of ``rules`` (verdict, host, path) that fits, as text, and its verdict; null where none fits.

    A rule fits its host and all subdomains where the path starts with the rule's. Of equal length the first one counts.
    """
    text = verdict = None
    for says, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, says = F.lit(rule_host + rule_path), F.lit(says)
        text = F.when(fits, name) if text is None else text.when(fits, name)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if text is None else (text, verdict)


def tokens_of(url: Column) -> Column:
    """Distinct tokens: words of the host and of the path, marked by where they stand, and names of parameters."""
    host = F.transform(F.split(host_of(url), r"[.\-:@]+"), lambda t: F.concat(F.lit("h:"), t))
    path = F.transform(F.split(_lower(path_of(url)), r"[^\p{L}\p{N}]+"), lambda t: F.concat(F.lit("p:"), t))
    query = F.transform(F.regexp_extract_all(_lower(F.coalesce(url, F.lit(""))), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda t: F.concat(F.lit("q:"), t))
    return F.array_distinct(F.filter(F.concat(host, path, query), lambda t: F.length(t) > 2))


@dataclass
class Rules:
    """Token sets that block, with their confidence, by rarest token."""

    sets: list[tuple[tuple[str, ...], float]]
    index: dict[str, list[int]] = field(default_factory=dict)

    def best(self, tokens: Iterable[str]) -> tuple[str | None, float | None]:
        """The surest rule within ``tokens``; of equally sure ones the first by name."""
        mine = set(tokens)
        hits = (self.sets[i] for t in mine for i in self.index.get(t, ()) if mine.issuperset(self.sets[i][0]))
        found = min(hits, key=lambda r: (-r[1], r[0]), default=None)
        return (None, None) if found is None else (" + ".join(found[0]), found[1])


def telling(n: int) -> Column:
    """Whether a rule mined from ``n`` rows says enough beyond the share of bad rows, however large that is.

    Above a certain share no rule has ``MIN_LIFT``; then its confidence, and the lower end of Wilson's interval, have to exceed
    the share.
    """
    sure, share = F.col("confidence"), F.col("confidence") / F.col("lift")
    rows, z = F.col("support") * n / F.col("confidence"), MIN_SURE
    low = (sure + z * z / (2 * rows) - z * F.sqrt(sure * (1 - sure) / rows + z * z / (4 * rows * rows))) / (1 + z * z / rows)
    return (F.col("lift") >= MIN_LIFT) | (sure >= share + MIN_GAIN * (1 - share)) & (low > share)


def merged_tokens(items: DataFrame) -> DataFrame:
    """``items`` with one token for each group of tokens that stand in the same rows, the first by name.

    Such tokens make the same rules, and k of them 2^k frequent sets: a long url that comes often enough would never end.
    """
    numbered = items.withColumn("row", F.monotonically_increasing_id())
    single = numbered.select("row", F.explode("items").alias("item"))
    # Two hashes of the row number, added up, tell sets of rows apart.
    rows = [F.sum(F.xxhash64(F.lit(salt), "row").cast("decimal(38,0)")) for salt in (1, 2)]
    alike = single.groupBy("item").agg(F.count("*").alias("n"), *[r.alias(f"h{i}") for i, r in enumerate(rows)])
    group = Window.partitionBy("n", "h0", "h1")
    first = alike.select("item", F.when(F.col("item").startswith("y:"), F.col("item")).otherwise(F.min(F.when(~F.col("item").startswith("y:"), F.col("item"))).over(group)).alias("first"))
    return single.join(first, "item").groupBy("row").agg(F.collect_set("first").alias("items")).select("items")


def fit(urls: DataFrame, url_col: str = "url", label_col: str = "label", train_rows: int = TRAIN_ROWS, id_col: str | None = None) -> Rules:
    """Rules from labelled urls; label 0 is what gets blocked. Null labels are not used; without labels there are no rules.

    Tokens that stand in the same rows count as one, under the first's name.

    With ``id_col`` rows of one url are drawn one by one; without it they come together.
    """
    key = F.lit(None).cast("string") if id_col is None else F.col(id_col)
    sample = (
        urls.where(F.col(label_col).isNotNull()).select(key.alias("id"), F.col(url_col).alias("url"), F.col(label_col).alias("label"))
        .orderBy(F.xxhash64("id", "url"), "id", "url", "label").limit(train_rows)
    )
    items = staged(sample.select(F.array_append(tokens_of(F.col("url")), F.when(F.col("label") == 0, "y:bad").otherwise("y:good")).alias("items")), "url-tokens")
    n = items.count()
    if not n:
        return Rules([])
    items = staged(merged_tokens(items), "url-items")
    model = FPGrowth(itemsCol="items", minSupport=max(MIN_SUPPORT, MIN_ROWS / n), minConfidence=MIN_CONFIDENCE).fit(items)
    found = model.associationRules.where(
        (F.element_at("consequent", 1) == "y:bad") & telling(n) & (F.size("antecedent") <= MAX_ITEMS)
    )
    # The mined model; its size follows from the least support, not from the number of urls.
    mined = {tuple(sorted(r["antecedent"])): r["confidence"] for r in found.collect()}
    kept = []
    for tokens, sure in sorted(mined.items(), key=lambda r: (len(r[0]), r[0])):
        if not any(set(t) < set(tokens) and s >= sure for t, s in kept):
            kept.append((tokens, sure))
    counts: dict[str, int] = defaultdict(int)
    wanted = sorted({t for tokens, _ in kept for t in tokens})
    if wanted:
        single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq").where(F.col("item").isin(wanted))
        counts.update({r["item"]: r["freq"] for r in single.collect()})
    index: dict[str, list[int]] = defaultdict(list)
    for i, (tokens, _) in enumerate(kept):
        index[min(tokens, key=lambda t: (counts[t], t))].append(i)
    return Rules(kept, dict(index))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], mined: Rules, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict``, ``mined_rule`` and ``confidence`` of every row; nothing is shuffled.

    The verdict is that of the longest listed rule; without one, a mined rule blocks, and the rest is allowed. A null url or
    one without ``://`` has an empty host and path and fits no listed rule. Repeated rows give repeated results, an empty
    table none; other columns are not read.
    """
    url = F.col("url")
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    parsed = source.select("id", host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))

    def rows(found: Iterable[tuple]) -> Iterator[tuple]:
        for page, host, path, tokens in found:
            yield page, host, path, *mined.best(tokens)

    shape = f"id {source.schema['id'].dataType.simpleString()}, host string, path string, mined_rule string, confidence double"
    matched = map_rows(parsed, rows, shape)
    rule, says = rule_of(rules, F.col("host"), F.col("path"))
    learned = F.when(F.col("mined_rule").isNotNull(), BLOCK).otherwise(ALLOW)
    return matched.select("id", "host", "path", rule.alias("rule"), F.coalesce(says, learned).alias("verdict"), "mined_rule", "confidence")
