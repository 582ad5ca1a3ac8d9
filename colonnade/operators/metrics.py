"""Evaluation of predictions, as aggregations over a predictions table.

Input columns are named by the caller: the true value, the prediction and,
where needed, the score of the positive class. Rows without a true value are
left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import col
from colonnade.operators.running import dense_numbers, running_sums


def _known(df: DataFrame, y: str) -> DataFrame:
    return df.where(col(y).isNotNull())


def accuracy_of(y: str, p: str) -> Column:
    return F.avg(F.when(col(y).eqNullSafe(col(p)), 1.0).otherwise(0.0))


def accuracy(df: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    return _known(df, y).agg(accuracy_of(y, p).alias("accuracy"))


def confusion_cells(df: DataFrame, y: str = "label", p: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """``(by..., actual, predicted, n)`` of the cells that occur."""
    return (
        _known(df, y).groupBy(*by, col(y).alias("actual"), col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    )


def confusion(df: DataFrame, y: str = "label", p: str = "prediction", zero_filled: bool = True) -> DataFrame:
    """``(actual, predicted, n)``; rows without a prediction are cells whose ``predicted`` is NULL.

    ``zero_filled`` adds the pairs of labels that do not occur. The labels are numbered where they are, and a pair is a
    number below the square of theirs; for a target with very many labels ask for the cells that occur.
    """
    cells = confusion_cells(df, y, p)
    if not zero_filled:
        return cells
    labels = cells.select(F.explode(F.array("actual", "predicted")).alias("label")).where(
        F.col("label").isNotNull()
    ).distinct()
    numbered = dense_numbers(labels, "label")
    known = numbered.count()
    grid = (
        df.sparkSession.range(known * known)
        .select(F.expr(f"id DIV {max(known, 1)}").alias("row"), F.expr(f"id % {max(known, 1)}").alias("column"))
        .join(numbered.select(F.col("number").alias("row"), F.col("label").alias("actual")), "row")
        .join(numbered.select(F.col("number").alias("column"), F.col("label").alias("predicted")), "column")
    )
    filled = grid.join(cells, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )
    return filled.unionByName(cells.where(F.col("predicted").isNull()))


def class_scores(df: DataFrame, y: str = "label", p: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """``(by..., label, support, predicted, hits, precision, recall, f1)`` per class; no predictions score 0."""
    cells = confusion_cells(df, y, p, by)
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("actual").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(F.lit(0)).alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )
    totals = (
        cells.select(*by, F.explode(sides).alias("side")).select(*by, "side.*")
        .groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    scored = totals.withColumns({
        "precision": F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0)),
    })
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("precision") * F.col("recall"), both), F.lit(0.0)))


def classification_scores(df: DataFrame, y: str = "label", p: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """``(by..., accuracy, precision, recall, f1)``, classes weighted by their support."""
    rows = F.sum("support")

    def weighted(name: str) -> Column:
        return F.try_divide(F.sum(F.col(name) * F.col("support")), rows).alias(name)

    return class_scores(df, y, p, by).groupBy(*by).agg(
        F.try_divide(F.sum("hits").cast("double"), rows).alias("accuracy"),
        weighted("precision"), weighted("recall"), weighted("f1"),
    )


def _by_score(df: DataFrame, y: str, score: str, positive) -> DataFrame:
    """``(score, pos, neg)`` per distinct score; this combines equal scores before the shuffle."""
    hit = col(y) == F.lit(positive)
    return (
        df.where(col(y).isNotNull() & col(score).isNotNull() & ~F.isnan(col(score).cast("double")))
        .groupBy((col(score).cast("double") + F.lit(0.0)).alias("score"))
        .agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    )


def roc_points(df: DataFrame, y: str = "label", score: str = "score", positive=1) -> DataFrame:
    """``(threshold, tp, fp, tpr, fpr)`` at every distinct score, highest first, after a start at (0, 0)."""
    run = running_sums(_by_score(df, y, score, positive), "score", ["pos", "neg"])
    points = run.select(
        F.col("score").alias("threshold"), F.col("pos_upto").alias("tp"), F.col("neg_upto").alias("fp"),
        F.try_divide(F.col("pos_upto"), F.col("pos_total")).alias("tpr"),
        F.try_divide(F.col("neg_upto"), F.col("neg_total")).alias("fpr"),
    )
    start = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("bigint").alias("tp"),
        F.lit(0).cast("bigint").alias("fp"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"),
    )
    return start.unionByName(points)


def roc_auc(df: DataFrame, y: str = "label", score: str = "score", positive=1) -> DataFrame:
    """``(roc_auc)``: exact area with ties at half; NULL unless there are exactly two labels."""
    run = running_sums(_by_score(df, y, score, positive), "score", ["pos", "neg"])
    # A negative row ranks below the positives above it, and halfway through those of its own score.
    won = F.sum(F.col("neg") * (F.col("pos_upto") - F.col("pos") / 2.0))
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    area = run.agg(F.try_divide(won, pairs).alias("roc_auc"))
    labels = [r["y"] for r in _known(df, y).select(col(y).alias("y")).distinct().limit(3).collect()]
    two = len(labels) == 2 and positive in labels
    return area if two else area.select(F.lit(None).cast("double").alias("roc_auc"))


def pr_points(df: DataFrame, y: str = "label", score: str = "score", positive=1) -> DataFrame:
    """``(threshold, precision, recall)`` at every distinct score, and the end at precision 1, recall 0."""
    run = running_sums(_by_score(df, y, score, positive), "score", ["pos", "neg"])
    points = run.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("pos_upto"), F.col("pos_upto") + F.col("neg_upto")).alias("precision"),
        F.try_divide(F.col("pos_upto"), F.col("pos_total")).alias("recall"),
    )
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def regression_scores(df: DataFrame, y: str = "label", p: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """``(by..., mae, rmse, r2, mape)`` from one aggregate; MAPE is NULL if any true value is 0."""
    truth, guess = col(y).cast("double"), col(p).cast("double")
    error = truth - guess
    sse, sst = F.sum(error * error), F.var_pop(truth) * F.count(truth)
    return _known(df, y).groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(sst > 0, 1 - F.try_divide(sse, sst)).when(sse == 0, F.lit(1.0)).when(sse > 0, F.lit(0.0)).alias("r2"),
        F.when(F.count_if(truth == 0) == 0, F.avg(F.abs(F.try_divide(error, truth))) * 100).alias("mape"),
    )


def residuals(df: DataFrame, y: str = "label", p: str = "prediction", keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., actual, predicted, residual)`` per row."""
    truth, guess = col(y).cast("double"), col(p).cast("double")
    return _known(df, y).select(
        *[col(c) for c in keep], truth.alias("actual"), guess.alias("predicted"), (truth - guess).alias("residual")
    )


def common_range(df: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    """``(low, high)`` over the true and predicted values together."""
    truth, guess = col(y).cast("double"), col(p).cast("double")
    return _known(df, y).agg(
        F.least(F.min(truth), F.min(guess)).alias("low"), F.greatest(F.max(truth), F.max(guess)).alias("high")
    )


def top_rows(df: DataFrame, by: str, name: str, top: int) -> DataFrame:
    """The ``top`` rows by value, equal values by name."""
    return df.orderBy(F.col(by).desc(), F.col(name)).limit(top)
