"""A log of runs: one row per candidate with tags, params and metrics."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.plans.compare import score_summary

RUN = (
    "run_id string, run_name string, at timestamp, tags map<string,string>, "
    "params map<string,string>, metrics map<string,double>"
)


class RunLog:
    """An append-only ``runs`` table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(
        self,
        run_name: str,
        params: Mapping[str, object] | None = None,
        metrics: Mapping[str, float] | None = None,
        tags: Mapping[str, object] | None = None,
    ) -> str:
        """Adds one run; returns its id."""
        run_id = uuid.uuid4().hex
        row = (
            run_id, run_name, datetime.now(timezone.utc), {k: str(v) for k, v in (tags or {}).items()},
            {k: str(v) for k, v in (params or {}).items()}, {k: float(v) for k, v in (metrics or {}).items()},
        )
        self.spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").parquet(self.path)
        return run_id

    def append_comparison(self, fold_scores: DataFrame, dataset: str, problem: str, folds: int) -> None:
        """One run per candidate of a comparison, with means and deviations as metrics."""
        rows = runs_of(fold_scores, dataset, problem, folds)
        rows.coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(self.path)


def runs_of(fold_scores: DataFrame, dataset: str, problem: str, folds: int) -> DataFrame:
    """Run rows of a comparison."""
    entries = F.array(
        F.struct(F.col("metric").alias("k"), F.col("mean").alias("v")),
        F.struct(F.concat("metric", F.lit("_std")).alias("k"), F.col("std").alias("v")),
    )
    metrics = score_summary(fold_scores).select("model", "seconds", F.explode(entries).alias("e")).groupBy("model").agg(
        F.map_from_entries(F.collect_list("e")).alias("scores"), F.max("seconds").alias("seconds")
    )
    return metrics.select(
        F.uuid().alias("run_id"), F.col("model").alias("run_name"), F.current_timestamp().alias("at"),
        F.create_map(F.lit("dataset"), F.lit(dataset), F.lit("problem"), F.lit(problem)).alias("tags"),
        F.create_map(F.lit("model"), F.col("model"), F.lit("folds"), F.lit(str(folds))).alias("params"),
        F.map_concat("scores", F.create_map(F.lit("fit_seconds"), F.col("seconds"))).alias("metrics"),
    )
