"""Model versions: append-only tables and the queries over them.

Nothing is rewritten in place. Saving adds a row to ``model_versions``,
promoting adds one to ``promotions``, deleting adds one to ``deletions``; what
is current is a query. Numbers are never used twice.

Any number of sessions may write at once. Every entry is a folder of its own
with one file that appears when it is complete, so writers do not share the
folder in which Spark prepares its output. A writer first claims a number: it
appends a claim and reads the claims back. Of two writers with one number at
least the later reader sees both claims, so at most one keeps it; whoever sees
a rival draws again. A version is there once its row is, after its model.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from colonnade.functions.names import safe_name_of

VERSION = (
    "dataset string, version bigint, model_name string, problem string, created_at timestamp, "
    "metrics map<string,double>, hyperparameters map<string,string>, feature_columns array<string>, "
    "n_train_rows bigint, notes string, path string"
)
EVENT = "dataset string, version bigint, at timestamp"
CLAIM = "dataset string, version bigint, claimed_by string"
# Tries at a number, and seconds that the wait between them grows from.
CLAIM_TRIES, CLAIM_WAIT = 20, 0.2


class UnknownVersion(LookupError):
    """No such dataset or version."""


def next_versions(versions: DataFrame) -> DataFrame:
    """``(dataset, next_version)``; a dataset without versions starts at 1."""
    return versions.groupBy("dataset").agg((F.max("version") + 1).alias("next_version"))


def live_versions(versions: DataFrame, deletions: DataFrame) -> DataFrame:
    return versions.join(deletions.select("dataset", "version"), ["dataset", "version"], "left_anti")


def current_versions(versions: DataFrame, promotions: DataFrame, deletions: DataFrame) -> DataFrame:
    """``(dataset, version)`` in force per dataset.

    The latest promotion counts if its version is still there; if it was
    deleted, the newest remaining version does. A dataset without promotions
    has none in force.
    """
    live = live_versions(versions, deletions)
    latest = promotions.groupBy("dataset").agg(
        F.max(F.struct("at", "version"))["version"].alias("promoted")
    )
    choice = live.join(latest, "dataset").groupBy("dataset").agg(
        F.max("version").alias("newest"),
        F.max(F.when(F.col("version") == F.col("promoted"), F.col("version"))).alias("kept"),
    )
    return choice.select("dataset", F.coalesce("kept", "newest").alias("version"))


def versions_newest_first(versions: DataFrame, deletions: DataFrame, dataset: str) -> DataFrame:
    return live_versions(versions.where(F.col("dataset") == dataset), deletions).orderBy(F.col("version").desc())


def datasets_with_versions(versions: DataFrame, deletions: DataFrame) -> DataFrame:
    return live_versions(versions, deletions).select("dataset").distinct().orderBy("dataset")


class ModelStore:
    """Fitted pipelines and their versions under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, table: str, schema: str, row: Sequence) -> None:
        entry = f"{self.folder}/{table}/entry-{uuid.uuid4().hex}"
        self.spark.createDataFrame([tuple(row)], schema).coalesce(1).write.parquet(entry)

    def _claim(self, name: str) -> int:
        """A version number that no other writer has or gets."""
        mine = F.col("dataset") == name
        for attempt in range(CLAIM_TRIES):
            taken = self._read("claims", CLAIM).select("dataset", "version").unionByName(self.versions.select("dataset", "version"))
            version = (taken.where(mine).agg(F.max("version")).first()[0] or 0) + 1
            self._append("claims", CLAIM, (name, version, uuid.uuid4().hex))
            if self._read("claims", CLAIM).where(mine & (F.col("version") == version)).count() == 1:
                return version
            time.sleep(random.uniform(0, CLAIM_WAIT * 2 ** min(attempt, 6)))
        raise TimeoutError(f"no free version number of {name} after {CLAIM_TRIES} tries")

    @property
    def versions(self) -> DataFrame:
        return self._read("model_versions", VERSION)

    @property
    def promotions(self) -> DataFrame:
        return self._read("promotions", EVENT)

    @property
    def deletions(self) -> DataFrame:
        return self._read("deletions", EVENT)

    def save(
        self,
        dataset: str,
        model_name: str,
        problem: str,
        fitted: PipelineModel,
        metrics: Mapping[str, float],
        hyperparameters: Mapping[str, object],
        feature_columns: Sequence[str],
        n_train_rows: int,
        promote: bool = True,
        notes: str = "",
    ) -> Row:
        """Stores a fitted pipeline as the next version; returns its record.

        A save that fails leaves its number unused.
        """
        name = safe_name_of(dataset)
        version = self._claim(name)
        path = f"{self.folder}/models/{name}/v{version}-{safe_name_of(model_name)}"
        fitted.write().save(path)
        self._append("model_versions", VERSION, (
            name, version, model_name, problem, _now(), {k: float(v) for k, v in metrics.items()},
            {k: str(v) for k, v in hyperparameters.items()}, list(feature_columns), n_train_rows, notes, path,
        ))
        if promote:
            self._append("promotions", EVENT, (name, version, _now()))
        return self.metadata(dataset, version)

    def metadata(self, dataset: str, version: int | None = None) -> Row:
        """The record of a version, by default of the one in force."""
        name = safe_name_of(dataset)
        live = live_versions(self.versions, self.deletions).where(F.col("dataset") == name)
        if version is None:
            current = current_versions(self.versions, self.promotions, self.deletions)
            found = current.where(F.col("dataset") == name).first()
            if found is None:
                raise UnknownVersion(f"no version of {name} is in force")
            version = found["version"]
        record = live.where(F.col("version") == version).first()
        if record is None:
            raise UnknownVersion(f"{name} has no version {version}")
        return record

    def load(self, dataset: str, version: int | None = None) -> PipelineModel:
        return PipelineModel.load(self.metadata(dataset, version)["path"])

    def list_versions(self, dataset: str) -> DataFrame:
        return versions_newest_first(self.versions, self.deletions, safe_name_of(dataset))

    def promote(self, dataset: str, version: int) -> None:
        record = self.metadata(dataset, version)
        self._append("promotions", EVENT, (record["dataset"], version, _now()))

    def delete(self, dataset: str, version: int) -> None:
        """Takes a version out of use; if it was in force, the newest remaining one takes over."""
        record = self.metadata(dataset, version)
        name = record["dataset"]
        before = current_versions(self.versions, self.promotions, self.deletions).where(F.col("dataset") == name).first()
        self._append("deletions", EVENT, (name, version, _now()))
        if before is not None and before["version"] == version:
            remaining = self.list_versions(dataset).first()
            if remaining is not None:
                self._append("promotions", EVENT, (name, remaining["version"], _now()))

    def datasets(self) -> DataFrame:
        return datasets_with_versions(self.versions, self.deletions)


def _now() -> datetime:
    return datetime.now(timezone.utc)
