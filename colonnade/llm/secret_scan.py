"""Secrets in texts, with DataFrame functions only.

Three base kinds are regular expressions. Beside them, runs of key characters are judged by the Shannon entropy of a window
that slides over them, among the characters of the run's class. Counts are kept as the window moves: one character leaves and
one enters. Sums of ``c * log2(c)`` are whole numbers at a fixed scale, so that they are exact however they were reached. The
span goes from the first window at or above the class's least entropy to the end of the last. Runs on the allow-list, and
runs that meet a base span, are left out.

A text is read where it lies; nothing is shuffled, so no source or copy can be hot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The base kinds in their order, their patterns, the group whose length counts and its least length. A longest
# run of one class is long enough or not, so its least length can stand in the pattern; an assignment that is too short still
# uses up its characters.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ENTROPY = "entropy"
KINDS = (*(name for name, *_ in BASE), ENTROPY)

#: Characters of a window; shorter runs are not judged.
WINDOW = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Classes of runs, the first that fits counts: pattern, characters, least entropy of a window in bits.
CLASSES = (
    (r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 3.85),
    (r"^[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
)
#: Runs that are no secrets however mixed they are: without a digit or without a letter, UUIDs, paths and names of words, placeholders.
ALLOWED = (
    r"^[^0-9]*$", r"^[^A-Za-z]*$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[+/_=-]*([A-Z]?[a-z]+|[A-Z]+|[0-9]+)([+/_=-]+([A-Z]?[a-z]+|[A-Z]+|[0-9]+))+[+/_=-]*$", r"(?i)example|placeholder|x{6}|0{8}|1234567",
)
#: Scale of the whole numbers that stand for c * log2(c).
SCALE = 1 << 32


def weight(count: int) -> int:
    """``c * log2(c)`` at SCALE."""
    return round(count * math.log2(count) * SCALE) if count > 1 else 0


def most_weight(least: float, window: int = WINDOW) -> int:
    """The largest sum of weights at which a window has at least ``least`` bits of entropy."""
    return math.floor((math.log2(window) - least) * window * SCALE)


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def located(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """``(start, end, found)`` of the leftmost matches, none of them overlapping, whose ``group`` has ``least`` characters or more.

    Positions are code points, ``end`` exclusive. They add up from the lengths of the matches and of what lies between.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), counted.alias("counted"))
    nothing = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def step(known: Column, part: Column) -> Column:
        start = known["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), part["hit"].alias("found"))
        counts = part["hit"].isNotNull() & (F.length(part["counted"]) >= least)
        spans = F.when(counts, F.concat(known["spans"], F.array(span))).otherwise(known["spans"])
        return F.struct(F.coalesce(end, known["at"]).alias("at"), spans.alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), nothing.alias("spans")), step, lambda known: known["spans"])


def windows(run: Column, characters: Column, most: Column, window: int = WINDOW) -> Column:
    """``(first, last)``: the places (from 0) of the first and last window whose weights sum up to ``most`` at most; nulls without one.

    ``characters`` holds those of the run; only they are counted.
    """
    weights = F.array(*(F.lit(weight(c)).cast("long") for c in range(window + 2)))
    codes = F.transform(F.split(run, ""), lambda c: F.instr(characters, c))

    def over(codes: Column) -> Column:
        held = F.slice(codes, 1, window)
        counts = F.transform(F.sequence(F.lit(1), F.length(characters)), lambda a: F.size(F.filter(held, lambda c: c == a)))
        total = F.aggregate(F.filter(F.transform(F.array_distinct(held), lambda a: F.size(F.filter(held, lambda c: c == a))), lambda c: c > 1),
                            F.lit(0).cast("long"), lambda s, c: s + F.get(weights, c))
        moves = F.arrays_zip(F.slice(codes, 1, F.size(codes) - window).alias("out"), F.slice(codes, window + 1, F.size(codes)).alias("new"))
        start = _once(total, lambda total: F.struct(
            F.lit(0).alias("at"), counts.alias("counts"), total.alias("total"),
            F.when(total <= most, 0).alias("first"), F.when(total <= most, 0).alias("last"),
        ))

        def step(known: Column, move: Column) -> Column:
            counts, leaves, enters = known["counts"], F.get(known["counts"], move["out"] - 1), F.get(known["counts"], move["new"] - 1)
            same = move["out"] == move["new"]
            total = known["total"] + F.when(same, F.lit(0).cast("long")).otherwise(
                F.get(weights, leaves - 1) - F.get(weights, leaves) + F.get(weights, enters + 1) - F.get(weights, enters))
            changed = F.when(same, counts).otherwise(F.transform(
                counts, lambda c, i: c + (i == move["new"] - 1).cast("int") - (i == move["out"] - 1).cast("int")))
            at = known["at"] + 1
            return _once(total, lambda total: F.struct(
                at.alias("at"), changed.alias("counts"), total.alias("total"),
                F.coalesce(known["first"], F.when(total <= most, at)).alias("first"), F.when(total <= most, at).otherwise(known["last"]).alias("last"),
            ))

        return F.aggregate(moves, start, step, lambda known: F.struct(known["first"].alias("first"), known["last"].alias("last")))

    return _once(codes, over)


def _by_class(run: Column, values: list) -> Column:
    found = None
    for (pattern, *_), value in zip(CLASSES, values):
        fits = F.regexp(run, F.lit(pattern))
        found = F.when(fits, F.lit(value)) if found is None else found.when(fits, F.lit(value))
    return found


def entropy_spans(text: Column, base: Column, allowed: tuple[str, ...] = ()) -> Column:
    """``(start, end)`` in the runs of ``text`` that meet no span of ``base`` and are not allowed. ``allowed`` lists further runs."""

    def judged(run: Column) -> Column:
        fine = F.lit(False)
        for pattern in ALLOWED:
            fine = fine | F.regexp(run["found"], F.lit(pattern))
        if allowed:
            fine = fine | run["found"].isin(*allowed)
        met = F.exists(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
        return ~met & ~fine

    def span(run: Column) -> Column:
        characters = _by_class(run["found"], [c for _, c, _ in CLASSES])
        most = _by_class(run["found"], [most_weight(least) for *_, least in CLASSES]).cast("long")
        return _once(F.struct(run.alias("run"), windows(run["found"], characters, most).alias("w")), lambda x: F.struct(
            (x["run"]["start"] + x["w"]["first"]).alias("start"), (x["run"]["start"] + x["w"]["last"] + WINDOW).alias("end")))

    return F.filter(F.transform(F.filter(located(text, RUN), judged), span), lambda s: s["start"].isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``text`` and ``spans`` (``start``, ``kind`` as a place in KINDS, ``end``) of every row, by start, then kind.

    A null text is empty; empty texts have no spans. Repeated rows stay.
    """
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def ranked(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))

    for name, pattern, group, least in BASE:
        found = found.withColumn(f"found_{name}", located(F.col("text"), pattern, group, least))
    base = found.select("id", "text", F.concat(*(ranked(F.col(f"found_{name}"), name) for name, *_ in BASE)).alias("base"))
    more = ranked(entropy_spans(F.col("text"), F.col("base"), allowed), ENTROPY)
    return base.select("id", "text", F.array_sort(F.concat("base", more)).alias("spans"))


def joined(spans: Column) -> Column:
    """"kind:start:end" of each span, separated by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, the number of spans of each base kind, ``base_sha256`` and ``spans`` as text."""
    found = scan(docs, id_col, text_col)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{name}") for i, (name, *_) in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``text`` with each secret replaced by its kind in brackets; of overlapping spans the first names the gap."""
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))

    def step(known: Column, s: Column) -> Column:
        between = F.substring(F.col("text"), known["at"] + 1, s["start"] - known["at"])
        out = F.when(s["start"] >= known["at"], F.concat(known["out"], between, F.get(names, s["kind"]))).otherwise(known["out"])
        return F.struct(F.greatest(known["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate("spans", start, step, lambda k: F.concat(k["out"], F.substring(F.col("text"), k["at"] + 1, F.length("text"))))
    return scan(docs, id_col, text_col).select("id", rest.alias("text"))


def sql() -> str:
    """The same columns in DuckDB; windows are counted anew each, by brute force."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    weights = "[" + ", ".join(str(weight(c)) for c in range(WINDOW + 2)) + "]"
    located = """list_filter(list_transform(range(1, len(hits) + 1), lambda i: {{'start': CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT),
        'found': hits[i], 'counted': length(groups[i])}}), lambda s: s.counted >= {least})"""
    pieces, names = [], []
    for i, (name, pattern, group, least) in enumerate((*BASE, ("run", RUN, 0, 0))):
        p = quoted(pattern)
        pieces.append(f"""{name} AS (SELECT rid, {located.format(least=least)} AS spans FROM (
            SELECT rid, regexp_split_to_array(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {group}) AS groups FROM docs))""")
        names.append(f"SELECT rid, {i} AS kind, unnest(spans) AS s FROM {name}")
    least = "CASE " + " ".join(f"WHEN regexp_matches(found, {quoted(p)}) THEN {most_weight(bits)}" for p, _, bits in CLASSES) + " END"
    allowed = " OR ".join(f"regexp_matches(found, {quoted(p)})" for p in ALLOWED)
    return f"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    {", ".join(pieces)},
    base AS MATERIALIZED (SELECT rid, kind, s.start AS start, s.start + length(s.found) AS "end" FROM ({" UNION ALL ".join(names[:-1])})),
    runs AS (SELECT row_number() OVER () AS run, rid, s.start AS start, s.found AS found FROM ({names[-1]})),
    judged AS (SELECT * FROM runs WHERE NOT ({allowed}) AND NOT EXISTS (
        SELECT 1 FROM base b WHERE b.rid = runs.rid AND b.start < runs.start + length(found) AND runs.start < b."end")),
    windows AS (SELECT *, unnest(range(0, length(found) - {WINDOW - 1})) AS place FROM judged),
    entropy AS (SELECT rid, {len(BASE)} AS kind, start + min(place) AS start, start + max(place) + {WINDOW} AS "end" FROM windows
        WHERE list_sum(list_transform(map_values(list_histogram(string_split(substring(found, CAST(place + 1 AS INTEGER), {WINDOW}), ''))), lambda c: CAST(({weights})[CAST(c AS BIGINT) + 1] AS BIGINT))) <= {least}
        GROUP BY run, rid, start),
    told AS (SELECT rid, kind, start, ({list(KINDS)})[kind + 1] || ':' || start || ':' || "end" AS span FROM (FROM base UNION ALL FROM entropy))
    SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{name}" for i, (name, *_) in enumerate(BASE))},
        sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}), '')) AS base_sha256,
        coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
    FROM docs LEFT JOIN told USING (rid) GROUP BY rid, doc_id"""
