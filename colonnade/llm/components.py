"""Connected components by smallest label, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colonnade.llm.frames import staged

#: Ways that the nodes of one label are spread over.
SALTS = 16


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label`` (the smallest node that links reach) of every node of ``links``; links to null are left out.

    Each round a node takes the smallest label around it and then the label of that label, so paths halve. A node with
    very many links is a key that only smallest labels are sent to, merged before the shuffle.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") != F.col("y")))
    both = staged(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("label")), "labels")
    while True:
        # The labels of a node's neighbours, with its own.
        around = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(around, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        # Most labels are final and head many nodes: those that are not are few, so these are copied for each salt.
        salt = F.pmod(F.xxhash64("node"), F.lit(SALTS))
        further = (
            moved.where(F.col("node") != F.col("label")).select(F.col("node").alias("label"), F.col("label").alias("next"))
            .withColumn("salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))))
        )
        labels = staged(moved.withColumn("salt", salt).join(further, ["label", "salt"], "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "was"), "labels")
        if labels.where(F.col("label") != F.col("was")).isEmpty():
            return labels.select("node", "label")
