"""Scoring a stream with the pipeline that scores tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from colonnade.operators.score import score_batch

FORMATS = ("parquet", "csv", "json")


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, file_format: str = "parquet") -> DataFrame:
    """Files arriving in a folder, as a stream."""
    if file_format not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, not {file_format!r}")
    reader = spark.readStream.schema(schema).format(file_format)
    return (reader.option("header", True) if file_format == "csv" else reader).load(folder)


def score_stream(fitted: PipelineModel, stream: DataFrame) -> DataFrame:
    """The scored stream; missing columns are an error before anything is read."""
    return score_batch(fitted, stream)


def start_scoring(
    fitted: PipelineModel,
    stream: DataFrame,
    out: str,
    checkpoint: str,
    file_format: str = "parquet",
    available_now: bool = True,
) -> StreamingQuery:
    """Appends scored rows to a folder, each input row once.

    With ``available_now`` the query ends when it has caught up; otherwise it
    keeps running.
    """
    writer = (
        score_stream(fitted, stream).writeStream.format(file_format).outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    if file_format == "csv":
        writer = writer.option("header", True)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(out)
