"""Left lookup of a number by value, safe for any number of values and any skew.

Up to a checked number of entries the table is broadcast. Beyond it, the
entries holding at least one row in ``HOT_PARTS`` are broadcast - there are at
most ``HOT_PARTS`` of them, whatever the data - and only the rows of other
values are shuffled. A value that was rare when the table was made, or unknown
to it, may hold many of the rows now, so these are salted by the number of
their task: equal rows of different tasks go apart, a task that is run again
deals its rows as before, and no task gets more than a few inputs' rows of one
value. Adaptive execution splits what is still too large. That join is asked
for as a merge: the copies of the rarer entries count as one where Spark
judges by the size of the file whether to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entries are a key of bounded length and a few numbers: about 100 bytes each.
BROADCAST_ENTRIES = 100_000
HOT_PARTS = 10_000
# Tasks that the rows of one value are spread over; the rarer entries are copied as often.
SALTS = 16

_KEY, _PAYLOAD, _COLD, _SALT = "__key", "__payload", "__cold", "__salt"


def lookup(df: DataFrame, key: Column, table: DataFrame, entries: int, output: str) -> DataFrame:
    """Adds ``output`` from ``table(key, value, share)``; NULL for unknown keys.

    ``entries`` is the number of rows of the table, ``share`` each entry's part
    of all rows when the table was made.
    """
    values = table.select(F.col("key").alias(_KEY), F.struct(F.col("value")).alias(_PAYLOAD), "share")
    keyed = df.withColumn(_KEY, key)
    if entries <= BROADCAST_ENTRIES:
        joined = keyed.join(F.broadcast(values.drop("share")), _KEY, "left")
        return joined.withColumn(output, F.col(_PAYLOAD)["value"]).drop(_KEY, _PAYLOAD)
    hot = values.where(F.col("share") >= 1.0 / HOT_PARTS).drop("share")
    cold = values.where(F.col("share") < 1.0 / HOT_PARTS).select(
        F.col(_KEY).alias(_COLD), F.col(_PAYLOAD).alias(_PAYLOAD + "_cold"),
        F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias(_SALT),
    )
    known = keyed.join(F.broadcast(hot), _KEY, "left")
    # Rows that are done, or have no key, get a key that matches nothing and
    # spreads them: value keys never begin with "!".
    spread = F.concat(F.lit("!"), F.spark_partition_id().cast("string"))
    routed = known.withColumn(
        _COLD, F.when(F.col(_PAYLOAD).isNull() & F.col(_KEY).isNotNull(), F.col(_KEY)).otherwise(spread)
    ).withColumn(_SALT, F.spark_partition_id() % SALTS)
    return (
        routed.join(cold.hint("merge"), [_COLD, _SALT], "left")
        .withColumn(output, F.coalesce(F.col(_PAYLOAD)["value"], F.col(_PAYLOAD + "_cold")["value"]))
        .drop(_KEY, _COLD, _SALT, _PAYLOAD, _PAYLOAD + "_cold")
    )
