"""Class labels to indices and back, for any number of classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.util import MLReader, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.columns import NUMERIC_KINDS, col, kind_of
from colonnade.operators.lookup import lookup
from colonnade.operators.running import dense_numbers
from colonnade.plans.steps import _Fitted, _TableReader, _TableWriter
from colonnade.session import scratch_path

# Up to this many labels stand in the plan and in the model's state; more are a table.
INLINE_CLASSES = 1_000

LABEL, PREDICTION, PROBABILITY, RAW = "__label", "__prediction", "__probability", "__raw"


@dataclass(frozen=True)
class LabelTable:
    """The labels of a target with very many classes: a written table ``(text, index, share)``."""

    path: str
    count: int

    def __len__(self) -> int:
        return self.count

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("text string, index bigint, share double").parquet(self.path)


Labels = list[str] | LabelTable


def sorted_labels(df: DataFrame, target: str) -> Labels:
    """The text forms of all labels: numbers in numeric order, others as texts.

    Above ``INLINE_CLASSES`` they are numbered where they are and written to the
    scratch folder; then no more than that number of them reaches the driver.
    """
    numeric = kind_of(df.schema[target].dataType) in NUMERIC_KINDS
    values = df.select(col(target).alias("y")).where(F.col("y").isNotNull())
    rows = values.distinct().select("y", F.col("y").cast("string").alias("text")).limit(INLINE_CLASSES + 1).collect()
    if len(rows) <= INLINE_CLASSES:
        return [r["text"] for r in sorted(rows, key=lambda r: r["y"] if numeric else r["text"])]
    total = values.count()
    counted = values.groupBy("y").agg((F.count(F.lit(1)) / F.lit(float(total))).alias("share")).select(
        (F.col("y") if numeric else F.col("y").cast("string")).alias("place"), F.col("y").cast("string").alias("text"), "share")
    path = scratch_path(df.sparkSession, "labels")
    dense_numbers(counted, "place", "index").select("text", "index", "share").write.parquet(path)
    return LabelTable(path, df.sparkSession.read.parquet(path).count())


def indexed(df: DataFrame, target: str, labels: Labels) -> DataFrame:
    """Adds the label index; a label that is not known is an error."""
    text = col(target).cast("string")
    if isinstance(labels, LabelTable):
        table = labels.read(df.sparkSession).select(
            F.concat(F.lit("="), "text").alias("key"), F.col("index").cast("double").alias("value"), "share")
        found = lookup(df, F.concat(F.lit("="), text), table, len(labels), LABEL)
        unknown = F.raise_error(F.concat(F.lit("unknown label: "), text)).cast("double")
        return found.withColumn(LABEL, F.when(F.col(LABEL).isNull() & text.isNotNull(), unknown).otherwise(F.col(LABEL)))
    indexer = StringIndexerModel.from_labels(labels, inputCol="__target", outputCol=LABEL, handleInvalid="error")
    return indexer.transform(df.withColumn("__target", text)).drop("__target")


class LabelDecoder(_Fitted):
    """Turns the model's output into ``prediction`` and ``prediction_probability``.

    The probability is that of class index 1, and absent for models without
    probabilities; for regression the prediction is taken as it is. The labels
    of very many classes are a table, kept and saved beside the state.
    """

    _table: DataFrame | None = None

    @classmethod
    def for_target(cls, df: DataFrame, target: str, labels: Labels | None) -> LabelDecoder:
        state = {"labels": labels, "type": df.schema[target].dataType.simpleString()}
        if not isinstance(labels, LabelTable):
            return cls.of(state)
        decoder = cls.of({**state, "labels": None, "classes": len(labels)})
        decoder._table = labels.read(df.sparkSession)
        return decoder

    @property
    def keeps_table(self) -> bool:
        return self.learned.get("classes") is not None

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        labels, label_type = self.learned["labels"], self.learned["type"]
        prediction = F.col(PREDICTION)
        if self.keeps_table:
            table = self._table.select(
                F.concat(F.lit("="), F.col("index").cast("string")).alias("key"), F.col("text").alias("value"), "share")
            key = F.concat(F.lit("="), prediction.cast("bigint").cast("string"))
            df = lookup(df, key, table, self.learned["classes"], "__decoded")
            prediction = F.col("__decoded").cast(label_type)
        elif labels is not None:
            texts = F.array(*[F.lit(v) for v in labels])
            prediction = texts[prediction.cast("int")].cast(label_type)
        added = {"prediction": prediction}
        if PROBABILITY in df.columns:
            probabilities = vector_to_array(F.col(PROBABILITY))
            added["prediction_probability"] = F.when(F.size(probabilities) > 1, F.get(probabilities, F.lit(1)))
        return df.withColumns(added).drop(LABEL, PREDICTION, PROBABILITY, RAW, "features", "__decoded")

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)
