"""Document fingerprints by spot signatures, with DataFrame functions only.

A spot signature is a common word (an anchor) with the chain of content words that follow it. A document's fingerprint is
the set of its signatures' hashes. Two sets can only be alike if their lengths are, so sets are partitioned by length and
compared where the lengths allow it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from colonnade.llm.frames import staged

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine für im ist mit nicht sich sie und von zu "
    "au dans de du elle en est et il la le les par pas pour que qui sur un une "
    "al con del el lo los las no para por se su una y"
).split()
#: Content words in a chain.
CHAIN = 2
SIMILARITY = 0.75
#: Sets of one signature and band that are joined with as many others in a task.
PART = 1024
MARK = "\u0001"
#: Buckets of neighbouring ids at most, and ids that each gets about; the table of their borders is broadcast.
MOST_BUCKETS, BUCKET_ROWS, CUTS = 1 << 16, 2048, 256
#: Texts, about, that a task gets where there are more than the session's partitions would hold.
TASK_ROWS = 4096


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted distinct hashes (32 bits) of a text's spot signatures; empty for null and for texts without words.

    Words are runs of letters and digits, in lower case. A chain is cut off by the end of the text. In a text without anchors
    before content words each word starts a chain.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    # "of the cat sat" becomes "of|the|cat sat": each piece is a content word with the anchors before it.
    marked = F.regexp_replace(plain, rf"(?<= )({'|'.join(sorted(set(ANCHORS)))}) ", f"$1{MARK}")
    some = F.filter(F.split(marked, " "), lambda p: (p != "") & ~F.endswith(p, F.lit(MARK)))
    # Nothing but anchors: they are the content.
    pieces = F.when(F.size(some) > 0, some).otherwise(F.filter(F.split(plain, " "), lambda p: p != ""))

    def of_piece(pieces: Column, words: Column, bare: Column) -> Column:
        def chained(piece: Column, i: Column) -> Column:
            following = F.array_join(F.slice(words, i + 1, F.lit(chain)), " ")
            anchors = F.split(piece, MARK)
            # The last part is the content word itself.
            before = F.when(bare, F.array(F.lit(""))).otherwise(F.slice(anchors, F.lit(1), F.size(anchors) - 1))
            return F.transform(before, lambda a: F.xxhash64(a, following).bitwiseAND(F.lit(0xFFFFFFFF)).cast("long"))

        return F.flatten(F.transform(pieces, chained))

    # Bound as arguments of a function over a one-element array, so that each is computed once.
    held = F.transform(F.array(pieces), lambda p: F.struct(p.alias("p"), F.transform(p, lambda x: F.substring_index(x, MARK, -1)).alias("w")))
    found = F.transform(held, lambda h: of_piece(h["p"], h["w"], ~F.exists(h["p"], lambda x: F.contains(x, F.lit(MARK)))))
    return F.array_sort(F.array_distinct(found[0]))


def fingerprint(found: Column) -> Column:
    """A set of signatures as text: eight hexadecimal digits for each, in order."""
    return F.array_join(F.transform(found, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets, 0 where their lengths alone keep it below ``least``; two empty sets are alike."""
    few, many = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    whole = common.cast("double") / (F.size(a) + F.size(b) - common)
    return F.when(many == 0, F.lit(1.0)).when((few == 0) | (few < least * many), F.lit(0.0)).otherwise(whole)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text``, its signatures ``own``, and ``next_text`` with its signatures ``following``.

    The next text is that of the next smaller id, for the smallest that of the largest.

    A null id is smaller than all others. Rows of one id follow each other by the hash of their text. Ids are dealt into
    buckets at sampled quantiles, each cut evenly again, and every bucket gets a copy of the last row before it. So each text
    is shuffled once, and only the buckets' borders are seen together.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    quantiles = [i / CUTS for i in range(CUTS + 1)]
    seen = source.agg(F.count("*").alias("n"), F.percentile_approx("id", quantiles, 20_000).alias("cuts")).first()
    cuts = sorted(set(seen["cuts"] or []))
    within = max(1, min(MOST_BUCKETS // CUTS, math.ceil(seen["n"] / (CUTS * BUCKET_ROWS))))
    if not cuts:
        bucket = F.lit(-1).cast("long")
    else:
        known = F.array(*(F.lit(c).cast("long") for c in cuts))
        part = F.greatest(F.size(F.filter(known, lambda c: c <= F.col("id"))), F.lit(1))
        low = F.element_at(known, part)
        high = F.element_at(known, F.least(part + 1, F.lit(len(cuts))))
        step = F.greatest((high - low) / F.lit(within), F.lit(1.0))
        inner = F.least(F.greatest(F.floor((F.col("id") - low) / step), F.lit(0)), F.lit(within - 1))
        bucket = F.coalesce(part * within + inner, F.lit(-1)).cast("long")
    dealt = source.withColumn("bucket", bucket).withColumn("row", F.xxhash64("text"))
    place = F.struct(F.col("id").isNotNull().alias("known"), "id", "row")
    last = staged(dealt.groupBy("bucket").agg(F.max(place).alias("last")), "bucket-borders")
    # One row for each bucket, at most MOST_BUCKETS.
    order = Window.orderBy("bucket")
    before = last.withColumn("before", F.coalesce(F.lag("last").over(order), F.last("last").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    borders = before.select(F.col("bucket").alias("to"), F.col("before.id").alias("b_id"), F.col("before.row").alias("b_row"))
    copies = (
        dealt.join(F.broadcast(borders), F.col("id").eqNullSafe(F.col("b_id")) & (F.col("row") == F.col("b_row")))
        .select("id", "text", F.col("to").alias("bucket"), "row", F.lit(0).alias("own"))
    )
    both = dealt.select("id", "text", "bucket", "row", F.lit(1).alias("own")).unionByName(copies)
    # Signatures are computed after the shuffle, which then carries texts only, and once for each text.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, math.ceil(seen["n"] / TASK_ROWS)))
    signed = both.repartition(parts, "bucket").withColumn("own_signatures", signatures(F.col("text")))
    neighbours = Window.partitionBy("bucket").orderBy("own", F.col("id").asc_nulls_first(), "row")
    return (
        signed.select("id", "text", "own", F.col("own_signatures"), F.lag("text").over(neighbours).alias("next_text"), F.lag("own_signatures").over(neighbours).alias("following"))
        .where(F.col("own") == 1).select("id", "text", F.col("own_signatures").alias("own"), "next_text", "following")
    )


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half (rounded down) replaced by as much of the beginning of ``following``, or all of it."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_chars``, ``edited_text``, the signatures of text, edited and next text (``own``, ``changed``, ``following``).

    Null texts are empty. An empty table gives no rows.
    """
    changed = edited(F.col("text"), F.col("next_text"))
    return with_next(docs, id_col, text_col).select(
        "id", F.char_length("text").alias("n_chars"), changed.alias("edited_text"), "own", signatures(changed).alias("changed"), "following",
    )


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, part: int = PART) -> DataFrame:
    """``a``, ``b`` (a < b), ``similarity`` of all pairs of different sets with at least ``least``, and no pair twice.

    Sets stand for all their documents: ``a`` and ``b`` are the smallest ids that have them (see ``set_members``). Null ids are
    left out. A set is filed under the first signatures of its order by rarity, within the band of its length and the next
    one, so it meets each set that can reach ``least``. Files of more than ``part`` sets are joined part by part.
    """
    sets = set_members(docs, id_col, text_col)
    sets = staged(sets.groupBy("found").agg(F.min("id").alias("id")).where(F.size("found") > 0), "spot-sets")
    rarity = sets.select("id", F.explode("found").alias("h")).groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    listed = sets.select("id", F.size("found").alias("n"), F.explode("found").alias("h")).join(rarity, "h", "left")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "h"))
    # Bands grow by the factor that a similar set's length can differ by.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(least))).cast("int")
    first = listed.withColumn("rank", rank).where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least) + 1) & F.col("df").isNotNull())
    first = first.select("id", "n", "h", band.alias("band"))
    left = first.select(F.col("id").alias("a"), F.col("n").alias("na"), "h", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    right = first.select(F.col("id").alias("b"), F.col("n").alias("nb"), "h", "band")
    hot = left.groupBy("h", "band").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1")

    def dealt(side: DataFrame, name: str, mine: str, other: str) -> DataFrame:
        """Each row in its own part, beside every part of the other side."""
        parts = F.coalesce("parts", F.lit(1))
        spread = side.join(F.broadcast(hot), ["h", "band"], "left").withColumn(mine, F.pmod(F.xxhash64(name), parts).cast("int"))
        return spread.withColumn(other, F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")

    met = dealt(left, "a", "part_a", "part_b").join(dealt(right, "b", "part_b", "part_a"), ["h", "band", "part_a", "part_b"])
    pairs = met.where(((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") >= least * F.col("nb")))
    met = pairs.select("a", "b").distinct()
    one, two = sets.select(F.col("id").alias("a"), F.col("found").alias("fa")), sets.select(F.col("id").alias("b"), F.col("found").alias("fb"))
    scored = met.join(one, "a").join(two, "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("fa"), F.col("fb"), least).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def set_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``found`` (the signatures) of every row with an id; rows with equal ``found`` are one set."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), signatures(F.col(text_col)).alias("found"))
