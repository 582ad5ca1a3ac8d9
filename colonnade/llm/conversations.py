"""Repair of conversations whose turns are missing, repeated, empty, cut off or out of turn.

Each row becomes a letter for its role and its first fault, each conversation a word of such letters, its signature. The words
are read from their ends: sorted by their reversed form, those with a common end follow each other, so the automaton that
shares all common ends is walked depth first, with the present path alone in memory. Each node of it gets, once for all
conversations of a range of words, the least cost from there on and the next edit, for each state of the grammar; the best
audit of a conversation is read off its path.

Rows of one conversation are put in order by turn (nulls first), then role, then the SHA-256 of the text. Nulls in role or text
are one space. A conversation may hold a large share of all rows: its letters are made range by range, and its texts stream
through one task without being held, since a SHA-256 can only be computed in order. What has to fit a task is its signature
and audit, a byte a row.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from colonnade.llm.frames import WORD, map_rows, staged

# Costs of the edits and of keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 60

#: States of the grammar (s?(ua)+)?: nothing yet, after a system, a user, an assistant row. An ending is legal in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the row that a state expects; its role is inserted or given.
EXPECTED = (USER, USER, ASSISTANT, USER)
ROLES = ("user", "user", "assistant", "user")
INITIALS = "sua"
FOLLOWS = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}

#: Letters of a signature: 4 * initial (s, u, a, other) + fault, from "A" on.
FINE, CUT, REPEATED, BLANK = range(4)
FIRST = ord("A")
#: Rows of a conversation whose letters make one piece, and letters of a signature by which its range is found.
PIECE, PREFIX = 65_536, 64
ORDER = ("known", "turn", "role", "digest")


def conversation_key(name: str) -> Column:
    """A text for each conversation that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with faults planted by the CRC-32 of "conversation:turn" modulo 20.

    0 drops the row, 1 empties its text, 2 takes its sentence ends away, 3 repeats it, 4 makes its role user. Nulls count as
    one space, in that key as well; a turn stays null.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)]
    roll = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    told, said = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    rows = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), roll.alias("roll"),
        F.when(roll == 4, F.lit("user")).otherwise(told).alias("role"),
        F.when(roll == 1, F.lit("")).when(roll == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias("text"),
    )
    copies = F.explode(F.when(F.col("roll") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("roll != 0").select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def _turns(turns: DataFrame) -> DataFrame:
    """``conv`` (its key), ``conv_id``, what rows are ordered by, and ``text``."""
    return turns.select(
        conversation_key("conv_id").alias("conv"), "conv_id", F.col("turn").isNotNull().alias("known"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def signatures(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """``conv``, ``conv_id``, ``gaps``, ``pieces`` (the signature in order) of each conversation of ``turns`` or ``every``.

    Equal rows of a turn are counted first, and the earliest turn of equal rows found by an aggregate, so neither a text that
    fills a conversation nor a conversation that fills a table is brought together.
    """
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(~F.col("text").rlike(WORD), BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(CUT)
    rows = _turns(turns).select("conv", "conv_id", *ORDER, (4 * initial + fault).alias("kind"))
    counted = staged(rows.groupBy("conv", *ORDER).agg(F.first("conv_id").alias("conv_id"), F.first("kind").alias("kind"), F.count("*").alias("n")), "turns")
    place = F.struct("known", "turn")
    earliest = counted.groupBy("conv", "role", "digest").agg(F.min(place).alias("earliest"))
    marked = counted.join(earliest, ["conv", "role", "digest"]).select(
        "conv", *ORDER, "kind", "n", (F.col("earliest") == place).alias("is_first"),
    )
    ordered = marked.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    pieces = map_rows(ordered, _pieces, "conv string, known boolean, turn bigint, role string, digest binary, letters string")
    words = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "letters"))).alias("pieces"))
    span = F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1 - F.count_distinct("turn")
    known = counted.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.when(F.max("turn").isNotNull(), F.least(span, F.lit(2**63 - 1).cast("decimal(38,0)"))).otherwise(0).cast("long").alias("gaps"))
    found = known.join(words, "conv").select("conv", "conv_id", "gaps", F.col("pieces.letters").alias("pieces"))
    if every is None:
        return found
    listed = every.select(conversation_key("conv_id").alias("conv"), "conv_id").groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    empty = F.array().cast("array<string>")
    missing = listed.join(found.select("conv"), "conv", "left_anti").select("conv", "conv_id", F.lit(0).cast("long").alias("gaps"), empty.alias("pieces"))
    return found.unionByName(missing)


def _pieces(rows: Iterable[tuple]) -> Iterator[tuple]:
    """The letters of rows in order, at most ``PIECE`` rows of one conversation at a time, with the place of the first."""
    at, letters, size = None, [], 0
    for conv, known, turn, role, digest, kind, n, is_first in rows:
        if at is not None and (at[0] != conv or size >= PIECE):
            yield *at, "".join(letters)
            at, letters, size = None, [], 0
        at = at or (conv, known, turn, role, digest)
        again = chr(FIRST + (kind if kind % 4 == BLANK else kind // 4 * 4 + REPEATED))
        letters.append(chr(FIRST + kind) + again * (n - 1) if is_first else again * n)
        size += n
    if at is not None:
        yield *at, "".join(letters)


class Automaton:
    """The path from the end of a signature to its beginning, with the least cost and the next edit by state for each node.

    Words come in the order of their reversed form; only nodes that the last word did not share are computed.
    """

    def __init__(self) -> None:
        # A node for each length of the common end, four states each; the first has no rows left.
        self.word, self.costs, self.edits, self.computed = "", array("q"), bytearray(), 0
        self._add([0, NEVER, NEVER, 0], [0, 0, 0, 0])

    def _add(self, costs: list[int], edits: list[int]) -> None:
        """A node, after inserted rows are weighed: a state that is reached cheaper by an insertion, or as cheaply by an earlier letter."""
        own = list(costs)
        for _ in range(3):
            costs = [min(own[q], INSERT + costs[EXPECTED[q]]) for q in range(4)]
        for q in range(4):
            inserted = INSERT + costs[EXPECTED[q]]
            if inserted == costs[q] and (own[q] > inserted or edits[q] > ord("I")):
                edits[q] = ord("I")
        self.costs.extend(costs)
        self.edits.extend(edits)
        self.computed += 1

    def _step(self, letter: str) -> None:
        initial, fault = divmod(ord(letter) - FIRST, 4)
        after, costs, edits = self.costs[-4:], [], []
        for q in range(4):
            # In the order of their letters, so that the first of equal cost is kept.
            best, edit = DELETE + after[q], "D"
            if fault in (FINE, CUT):
                follow = FOLLOWS.get((q, initial))
                if follow is not None and (cost := TRUNCATED * (fault == CUT) + after[follow]) < best:
                    best, edit = cost, "K"
                if (cost := REROLE + TRUNCATED * (fault == CUT) + after[EXPECTED[q]]) < best:
                    best, edit = cost, "R"
            costs.append(min(best, NEVER))
            edits.append(ord(edit))
        self._add(costs, edits)

    def solve(self, reversed_word: str) -> tuple[int, str]:
        """Least cost and its audit; of audits of equal cost the smallest by ASCII."""
        shared = common_prefix(self.word, reversed_word)
        del self.costs[4 * (shared + 1):], self.edits[4 * (shared + 1):]
        for letter in reversed_word[shared:]:
            self._step(letter)
        self.word = reversed_word
        level, state, audit = len(reversed_word), START, bytearray()
        while edit := self.edits[4 * level + state]:
            audit.append(edit)
            if edit == 75:  # K
                state = FOLLOWS[state, (ord(reversed_word[level - 1]) - FIRST) // 4]
            elif edit != 68:  # I, R
                state = EXPECTED[state]
            level -= edit != 73
        return self.costs[4 * len(reversed_word)], audit.decode()


def common_prefix(a: str, b: str) -> int:
    """Characters that two texts share at the beginning, by halving."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


AUDITED = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def audited(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """``conv_id``, ``gaps``, counts by fault, ``illegal`` neighbours, ``cost`` and ``audit`` of each conversation, written once.

    Conversations of ``every`` without rows in ``turns`` have zeros and an empty audit. A signature that many conversations
    share is dealt to several ranges by conversation.
    """
    found = signatures(turns, every).select("conv", "conv_id", "gaps", F.reverse(F.array_join("pieces", "")).alias("word"))
    ranged = found.repartitionByRange(F.substring("word", 1, PREFIX), "conv").sortWithinPartitions("word")
    kind = dict(ranged.dtypes)["conv_id"]

    def rows(found: Iterable[tuple]) -> Iterator[tuple]:
        automaton, last = Automaton(), None
        for conv, conv_id, gaps, word in found:
            if last is None or last[0] != word:
                faults = [sum(word.count(chr(FIRST + 4 * i + f)) for i in range(4)) for f in (BLANK, REPEATED, CUT)]
                initials = [(ord(x) - FIRST) // 4 for x in reversed(word)]
                illegal = sum(pair not in LEGAL_PAIRS for pair in zip(initials, initials[1:]))
                last = word, (*faults, illegal, *automaton.solve(word))
            yield conv, gaps, *last[1], conv_id

    return staged(map_rows(ranged, rows, f"{AUDITED}, conv_id {kind}"), "audits")


def _edited(turns: DataFrame, audits: DataFrame, one, schema: str) -> DataFrame:
    """``one(audit row, its turns)`` over each conversation; a turn is ``(turn, role, text)``. Turns stream past in order."""
    rows = _turns(turns)
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in audits.dtypes if name != "conv"]
    heads = audits.select("*", F.lit(0).alias("is_turn"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in (*ORDER, "text")])
    bodies = rows.select("conv", *nothing, F.lit(1).alias("is_turn"), *ORDER, "text")
    names = audits.columns
    both = heads.select(*names, "is_turn", *ORDER, "text").unionByName(bodies.select(*names, "is_turn", *ORDER, "text"))
    dealt = both.repartition("conv").sortWithinPartitions("conv", "is_turn", *ORDER)
    width, text = len(names), len(names) + 1 + len(ORDER)

    def run(found: Iterable[tuple]) -> Iterator[tuple]:
        found = iter(found)
        ahead = next(found, None)

        def following() -> Iterator[tuple]:
            nonlocal ahead
            while (ahead := next(found, None)) is not None and ahead[width]:
                yield ahead[width + 2], ahead[width + 3], ahead[text]

        while ahead is not None:
            turns = following()
            yield from one(dict(zip(names, ahead[:width])), turns)
            for _ in turns:
                pass

    return map_rows(dealt, run, schema)


def edits(audit: str, turns: Iterable[tuple]) -> Iterator[tuple]:
    """(edit, turn, role, text) for each letter of an audit; deleted rows as they were, inserted ones without a turn."""
    state, turns = START, iter(turns)
    for edit in audit:
        if edit == "I":
            yield edit, None, ROLES[state], ""
            state = EXPECTED[state]
            continue
        turn, role, text = next(turns)
        if edit == "R":
            role, state = ROLES[state], EXPECTED[state]
        elif edit == "K":
            state = FOLLOWS[state, INITIALS.index(role[0])]
        yield edit, turn, role, text


def repaired(turns: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: ``conv_id``, ``place`` (from 0), ``turn`` (null for inserted rows), ``role``, ``text``, ``edit``."""
    audits = audited(turns)

    def one(head: dict, rows: Iterator[tuple]) -> Iterator[tuple]:
        kept = (x for x in edits(head["audit"], rows) if x[0] != "D")
        for place, (edit, turn, role, text) in enumerate(kept):
            yield head["conv_id"], place, turn, role, text, edit

    return _edited(turns, audits, one, f"conv_id {dict(audits.dtypes)['conv_id']}, place bigint, turn bigint, role string, text string, edit string")


def digests(turns: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """``audited`` with ``repaired_sha256``: of the repaired rows as "role:text", joined by line feeds, in UTF-8.

    An empty table gives no rows; a conversation without rows has the hash of the empty text.
    """
    audits = audited(turns, every)

    def one(head: dict, rows: Iterator[tuple]) -> Iterator[tuple]:
        state, joint = hashlib.sha256(), ""
        for edit, _, role, text in edits(head["audit"], rows):
            if edit != "D":
                state.update(f"{joint}{role}:{text}".encode("utf-8", "surrogatepass"))
                joint = "\n"
        yield *(head[x.split()[0]] for x in columns), state.hexdigest()

    columns = [f"conv_id {dict(audits.dtypes)['conv_id']}", *AUDITED.split(", ")[1:]]
    return _edited(turns, audits, one, ", ".join([*columns, "repaired_sha256 string"]))
