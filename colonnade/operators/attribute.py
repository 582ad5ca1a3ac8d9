"""Attribution of tree-model predictions to features, as a Spark job.

The trees and a background sample of fixed size go to every task; the rows to
explain are dealt evenly to many tasks, as vectors. Neighbouring leaves
are tabled together for all rows of a task, so a row is one look into each table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, GBTClassificationModel, RandomForestClassificationModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colonnade.functions import shapley
from colonnade.functions.columns import col, row_hash
from colonnade.functions.growth import LOGISTIC
from colonnade.functions.shapley import Ensemble, Leaf, leaves_of, shapley_values
from colonnade.operators.metrics import top_rows
from colonnade.operators.split import SEED
from colonnade.plans.ensembles import TreeModel
from colonnade.plans.prepare import feature_names
from colonnade.session import scratch_path

# The kernel travels with the task, so executors need not have this package.
cloudpickle.register_pickle_by_value(shapley)

# Fixed values of the reports.
TOP_GLOBAL, TOP_BEESWARM, TOP_WATERFALL = 15, 12, 10

BACKGROUND_ROWS = 100
# A row costs a task some tenths of a millisecond and the tables of all leaves some seconds: rows of a task at least, and at
# most, which are also those that a task explains at once; and rows that it gives back at a time.
LEAST_ROWS, MOST_ROWS = 250, 131_072
BATCH_ROWS = 10_000
# Nodes are sent to every task; an ensemble larger than this is refused unless a caller raises the bound.
MAX_NODES = 1_000_000

_FORESTS = (RandomForestClassificationModel, RandomForestRegressionModel)
_BOOSTED = (GBTClassificationModel, GBTRegressionModel)
_TREES = (DecisionTreeClassificationModel, DecisionTreeRegressionModel)
_CLASS_SHARES = (RandomForestClassificationModel, DecisionTreeClassificationModel)


@dataclass(frozen=True)
class Explainer:
    """A fitted pipeline, its trees as boxes, and the background to compare with."""

    fitted: PipelineModel
    names: list[str]
    ensemble: Ensemble
    background: np.ndarray
    base_value: float


def tree_model(fitted: PipelineModel) -> Model:
    for stage in fitted.stages:
        if isinstance(stage, (TreeModel, *_FORESTS, *_BOOSTED, *_TREES)):
            return stage
    kinds = ", ".join(type(s).__name__ for s in fitted.stages)
    raise ValueError(f"attribution needs a tree model; this pipeline has {kinds}")


def make_explainer(
    fitted: PipelineModel,
    reference: DataFrame,
    key_cols: Sequence[str] | None = None,
    background_rows: int = BACKGROUND_ROWS,
    seed: int = SEED,
    max_nodes: int = MAX_NODES,
) -> Explainer:
    """Reads the trees, at most ``max_nodes`` nodes, and draws the background: the rows with the smallest hashes."""
    model, names = tree_model(fitted), feature_names(fitted)
    ensemble = ensemble_of(model, reference.sparkSession, len(names), max_nodes)
    sample = hash_sample(reference, background_rows, key_cols, seed)
    background = np.array([r["x"] for r in _vectors(fitted, sample, ()).select("x").collect()], dtype=float)
    if not len(background):
        raise ValueError("the reference table has no rows")
    return Explainer(fitted, names, ensemble, background, float(ensemble.output(background).mean()))


def ensemble_of(model: Model, spark, n_features: int, max_nodes: int = MAX_NODES) -> Ensemble:
    """The trees of a model; those of Spark's own models come from the node table they are saved as."""
    if isinstance(model, TreeModel):
        return _own_ensemble(model, n_features)
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if isinstance(model, _TREES):
        nodes = nodes.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
        weights = [1.0]
    elif isinstance(model, _FORESTS):
        weights = [1.0 / model.getNumTrees] * model.getNumTrees
    else:
        weights = list(model.treeWeights)
    node = F.col("nodeData")
    if isinstance(model, _CLASS_SHARES):
        stats = node["impurityStats"]
        if model.numClasses != 2:
            raise ValueError("attribution of classifiers needs two classes")
        value = F.try_divide(stats[1], stats[0] + stats[1])
    else:
        value = node["prediction"]
    flat = nodes.select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), node["leftChild"].alias("left"),
        node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["split"]["numCategories"].alias("categories"), value.alias("value"),
    )
    rows = flat.limit(max_nodes + 1).collect()
    if len(rows) > max_nodes:
        raise ValueError(f"the ensemble has more than {max_nodes} nodes")
    if any(r["left"] >= 0 and r["categories"] > -1 for r in rows):
        raise ValueError("splits on categorical features are not supported; assemble plain numbers")
    trees: dict[int, list[dict]] = {}
    for r in rows:
        trees.setdefault(r["tree"], []).append(r.asDict())
    leaves = [leaf for t, found in sorted(trees.items()) for leaf in leaves_of(found, weights[t])]
    return Ensemble(leaves, n_features, logistic=isinstance(model, GBTClassificationModel))


def _own_ensemble(model: TreeModel, n_features: int) -> Ensemble:
    rule = model.rule
    if rule.outputs > 1:
        raise ValueError("attribution of classifiers needs two classes")
    logistic = rule.link == LOGISTIC
    # The logistic link of the kernel doubles its margins.
    weight = (0.5 if logistic else 1.0) if rule.boosted else 1.0 / rule.trees
    nothing = np.zeros(0)
    leaves = [Leaf(nothing.astype(int), nothing, nothing, weight * model.learned["start"][0])] if rule.boosted else []
    for tree, limits in model.trees:
        nodes = [
            {"id": i, "left": int(left) if f >= 0 else -1, "right": int(left) + 1, "feature": int(f), "threshold": float(limit), "value": float(value)}
            for i, (f, left, limit, value) in enumerate(zip(tree.feature, tree.left, limits, tree.value[0]))
        ]
        leaves += leaves_of(nodes, weight)
    return Ensemble(leaves, n_features, logistic=logistic)


def hash_sample(df: DataFrame, rows: int, key_cols: Sequence[str] | None = None, seed: int = SEED) -> DataFrame:
    """The ``rows`` rows with the smallest hashes: the same ones on every run."""
    return df.orderBy(row_hash(df, key_cols, seed)).limit(rows)


def _vectors(fitted: PipelineModel, df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    keys = F.struct(F.lit(0).alias("__any"), *[col(c).alias(f"__k{i}") for i, c in enumerate(key_cols)])
    prepared = df.withColumn("__keys", keys)
    for stage in fitted.stages:
        prepared = stage.transform(prepared)
        if "features" in prepared.columns:
            break
    return prepared.select(
        *[F.col("__keys")[f"__k{i}"].alias(c) for i, c in enumerate(key_cols)],
        vector_to_array("features").alias("x"),
    )


def explain(explainer: Explainer, df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """``(key..., feature, value, shap, base_value)`` for every row and feature.

    ``value`` is the prepared feature value. The attributions of a row add up to
    its output - the probability of the positive class, or the predicted number -
    minus ``base_value``. The rows are dealt evenly, whatever files they come from.
    """
    rows = _vectors(explainer.fitted, df, key_cols)
    n = df.count()
    cores = min(df.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS))
    tasks = max(1, cores, -(-n // MOST_ROWS))
    rows = rows.repartition(tasks)
    ensemble, background = explainer.ensemble, explainer.background
    # The grouping of the leaves, for the rows that a task has, travels with them.
    ensemble.groups(shapley.cells_for(ensemble, -(-n // tasks)))

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def explained() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            x = whole.column("x").combine_chunks()
            made = shapley_values(ensemble, x.flatten().to_numpy(zero_copy_only=False).reshape(whole.num_rows, -1), background)
            ends = np.arange(whole.num_rows + 1, dtype=np.int32) * made.shape[1]
            yield from whole.append_column("shap", pa.ListArray.from_arrays(ends, made.ravel()).cast(x.type)).to_batches(BATCH_ROWS)

        for batch in batches:
            if batch.num_rows:
                waiting, held = [*waiting, batch], held + batch.num_rows
            if held >= MOST_ROWS:
                yield from explained()
                waiting, held = [], 0
        if waiting:
            yield from explained()

    schema = rows.select("*", F.col("x").alias("shap")).schema
    names = F.array(*[F.lit(n) for n in explainer.names])
    cells = F.arrays_zip(names.alias("feature"), F.col("x").alias("value"), F.col("shap").alias("shap"))
    return (
        rows.mapInArrow(attribute, schema)
        .select(*[col(c) for c in key_cols], F.explode(cells).alias("cell"))
        .select(
            *[col(c) for c in key_cols], F.col("cell")["feature"].alias("feature"), F.col("cell")["value"].alias("value"),
            F.col("cell")["shap"].alias("shap"), F.lit(explainer.base_value).alias("base_value"),
        )
    )


def explain_sample(
    explainer: Explainer, df: DataFrame, key_cols: Sequence[str], rows: int | None = None, seed: int = SEED
) -> DataFrame:
    """Attributions of all rows, or of the ``rows`` rows with the smallest hashes."""
    return explain(explainer, df if rows is None else hash_sample(df, rows, key_cols, seed), key_cols)


def explain_row(explainer: Explainer, df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Attributions of a table of exactly one row."""
    found = len(df.limit(2).collect())
    if found != 1:
        raise ValueError(f"exactly one row is explained at a time, not {'none' if not found else 'several'}")
    return explain(explainer, df, key_cols)


def explained_output(shap: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """``(key..., base_value, output)``: what the attributions of each row add up to."""
    return shap.groupBy(*key_cols, "base_value").agg((F.first("base_value") + F.sum("shap")).alias("output"))


def global_importance(shap: DataFrame) -> DataFrame:
    """``(feature, mean_abs_shap)``, combined before the shuffle."""
    return shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))


def top_global(shap: DataFrame, top: int = TOP_GLOBAL) -> DataFrame:
    return top_rows(global_importance(shap), "mean_abs_shap", "feature", top)


def beeswarm(shap: DataFrame, key_cols: Sequence[str], top: int = TOP_BEESWARM) -> DataFrame:
    """``(key..., feature, place, shap, position)`` of the top features.

    ``position`` is the feature value scaled to 0..1 over the table, 0 for a
    constant. The scale comes from an aggregate per feature, joined back as at
    most ``top`` rows; a window per feature would hold all rows in one task.
    """
    features = shap.groupBy("feature").agg(
        F.avg(F.abs("shap")).alias("mean_abs_shap"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    order = W.orderBy(F.col("mean_abs_shap").desc(), "feature")
    chosen = top_rows(features, "mean_abs_shap", "feature", top).withColumn("place", F.row_number().over(order))
    width = F.col("high") - F.col("low")
    return shap.join(F.broadcast(chosen), "feature").select(
        *[col(c) for c in key_cols], "feature", "place", "shap",
        F.coalesce(F.try_divide(F.col("value") - F.col("low"), width), F.lit(0.0)).alias("position"),
    )


def waterfall(shap: DataFrame, key_cols: Sequence[str], top: int = TOP_WATERFALL) -> DataFrame:
    """``(key..., place, feature, value, shap, pushes)``: the strongest attributions of each row."""
    order = W.partitionBy(*key_cols).orderBy(F.abs("shap").desc(), "feature")
    return (
        shap.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top)
        .select(
            *[col(c) for c in key_cols], "place", "feature", "value", "shap",
            F.when(F.col("shap") > 0, "up").otherwise("down").alias("pushes"),
        )
    )
