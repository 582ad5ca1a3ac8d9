"""Every operator as a query over the test tables: ``name -> (spark, folder) -> DataFrame``.

The tables hold no missing values, so queries on missing data plant them with an
expression that ``plans/oracle.py`` repeats in SQL. Every query reads whole
tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.columns import col
from colonnade.functions.dates import read_datetime
from colonnade.functions.names import hints_at_id_column, safe_name
from colonnade.operators import attribute, correlate, describe, metrics, outliers, profile, quality, quantiles, roles
from colonnade.operators import score, split, validate
from colonnade.plans import candidates, compare, curves, prepare, steps, tune
from colonnade.plans.labels import LABEL, PREDICTION, indexed, sorted_labels
from colonnade.session import scratch_path
from colonnade.sources import runs, tables, versions
from colonnade.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]

PROFILED = (
    "lineitem", "orders", "events", "customer", "part", "supplier", "nation", "region", "documents", "labels",
    "conversations", "pages", "benchmark",
)
SUMMARISED = ("lineitem", "orders", "events", "documents", "customer", "part")
OUTLYING = {"documents": "doc_id", "events": "event_id"}
PROBLEM_TARGETS = {
    "orders": ["o_orderstatus", "o_totalprice", "o_custkey"], "labels": ["quality"], "part": ["p_size", "p_retailprice"],
}
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tables.read_parquet(spark, f"{folder.rstrip('/')}/{name}.parquet")


def _stacked(parts: dict[str, DataFrame]) -> DataFrame:
    named = [df.select(F.lit(name).alias("table_name"), "*") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, named)


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(col(c), digits) for c in names})


# Planted views.

def _holed_lineitem(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.expr("CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END").alias("l_quantity"),
        F.expr("CASE WHEN l_linenumber <= 4 THEN NULL ELSE l_discount END").alias("l_discount"),
        F.expr("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END").alias("l_returnflag"),
    )


def _holed_orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey",
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END").alias("o_totalprice"),
        F.expr("CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END").alias("o_orderpriority"),
        "o_orderstatus", "o_orderdate",
    )


ORDER_ROLES = {
    "o_orderkey": roles.ID_LIKE, "o_custkey": roles.NUMERICAL, "o_totalprice": roles.NUMERICAL,
    "o_orderpriority": roles.CATEGORICAL, "o_orderstatus": roles.CATEGORICAL, "o_orderdate": roles.ROLE_DATETIME,
}


def _judged_lines(spark, folder):
    """A binary label, a rule that predicts it, and a score with many ties."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.expr("CAST(l_extendedprice * (1 - l_discount) > 30000 AS INT)").alias("label"),
        F.expr("CAST(l_quantity > 25 AS INT)").alias("prediction"),
        F.expr("CAST(floor(l_extendedprice / 100) + l_quantity AS DOUBLE)").alias("score"),
    )


def _judged_orders(spark, folder):
    """Three classes, one of them predicted under a name that never occurs as truth."""
    return table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("label"),
        F.expr("CASE WHEN o_orderpriority LIKE '1%' THEN 'F' WHEN o_orderpriority LIKE '2%' THEN 'O' "
               "WHEN o_orderpriority LIKE '3%' THEN 'X' ELSE o_orderstatus END").alias("prediction"),
    )


def _judged_parts(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", F.col("p_retailprice").alias("label"), F.expr("900 + p_partkey * 0.05 + p_size").alias("prediction"),
    )


# Roles and validation.

@query
def profile_roles(spark, folder):
    return _stacked({t: roles.roles_frame(table(spark, folder, t)) for t in PROFILED})


@query
def date_text_roles(spark, folder):
    """Texts that are all dates, and texts that turn to junk after some."""
    orders = table(spark, folder, "orders").select(
        F.expr("date_format(o_orderdate, 'yyyy-MM-dd') AS day"),
        F.expr("CASE WHEN o_orderkey > 100 THEN 'junk' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS junk_later"),
        F.expr("CASE WHEN o_orderkey % 3 > 0 THEN date_format(o_orderdate, 'dd.MM.yyyy') END AS day_with_holes"),
    )
    return roles.roles_frame(orders)


@query
def distinct_counts(spark, folder):
    return _stacked({
        t: profile.distinct_counts(df, df.columns)
        for t in ("lineitem", "orders", "documents") for df in [table(spark, folder, t)]
    })


@query
def problem_type(spark, folder):
    return _stacked({t: roles.problem_type_frame(table(spark, folder, t), ys) for t, ys in PROBLEM_TARGETS.items()})


@query
def id_name_hints(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", "url", hints_at_id_column(F.col("url")).alias("hints_at_id"))


@query
def read_dates(spark, folder):
    text = F.expr(
        "CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') "
        "WHEN 1 THEN date_format(o_orderdate, 'dd.MM.yyyy') WHEN 2 THEN date_format(o_orderdate, 'MM/dd/yyyy') "
        "ELSE 'not a date' END"
    )
    orders = table(spark, folder, "orders").select("o_orderkey", text.alias("text"))
    return orders.select("o_orderkey", read_datetime(F.col("text")).cast("date").alias("day"))


def _validated(spark, folder):
    return table(spark, folder, "events").select(
        "event_type",
        F.expr("CAST(floor(value / 10) AS INT)").alias("bucket"),
        F.expr("CASE WHEN event_type = 'click' THEN value END").alias("click_value"),
        F.expr("CAST(NULL AS DOUBLE)").alias("nothing"),
    )


@query
def validation_rules(spark, folder):
    report = validate.validate_table(_validated(spark, folder))
    return report.select("rule", "severity", "column", F.round("value", 6).alias("value"))


@query
def validation_verdict(spark, folder):
    return _stacked({
        "events": validate.verdict(validate.validate_table(table(spark, folder, "events"))),
        "planted": validate.verdict(validate.validate_table(_validated(spark, folder))),
    })


@query
def target_rules(spark, folder):
    labels = table(spark, folder, "labels").select(
        "quality",
        F.expr("CASE WHEN toxic = 1 THEN NULL ELSE quality END").alias("holed"),
        F.lit(1).alias("constant"), F.expr("CAST(NULL AS INT)").alias("nothing"),
    )
    reports = {t: validate.validate_target(labels, t) for t in ("quality", "holed", "constant", "nothing", "absent")}
    return _stacked(reports).select("table_name", "rule", "severity", "column", "value")


@query
def shape_rules(spark, folder):
    """The rules on few rows, a single column and a repeated name."""
    orders = table(spark, folder, "orders")
    reports = {
        "region": validate.validate_table(table(spark, folder, "region")),
        "one_column": validate.validate_table(table(spark, folder, "customer").select("c_custkey")),
        "repeated": validate.validate_table(orders.select("o_orderkey", F.col("o_totalprice").alias("o_orderkey"))),
    }
    return _stacked(reports).select("table_name", "rule", "severity", "column", "value")


@query
def hinted_roles(spark, folder):
    """The same unique, not consecutive integers under names that hint at an identifier and names that do not."""
    names = ("amount", "paid", "Row-Index", "GU_ID", "height", "in_dex")
    return roles.roles_frame(table(spark, folder, "orders").select(*[(F.col("o_orderkey") * 3).alias(n) for n in names]))


@query
def overridden_roles(spark, folder):
    """Given roles win, and those of columns that are not there are ignored."""
    given = {"o_custkey": roles.CATEGORICAL, "o_totalprice": roles.CATEGORICAL, "absent": roles.NUMERICAL}
    return roles.roles_frame(table(spark, folder, "orders"), given)


@query
def label_numbers(spark, folder):
    """Class indices of a target with a class per customer, and of the customers' numbers."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    numbered = indexed(customers, "c_name", sorted_labels(customers, "c_name")).withColumnRenamed(LABEL, "by_name")
    return indexed(numbered, "c_custkey", sorted_labels(customers, "c_custkey")).withColumnRenamed(LABEL, "by_number")


@query
def drop_missing_target(spark, folder):
    orders = validate.drop_missing_target(_holed_orders(spark, folder), "o_orderpriority")
    return orders.select("o_orderkey", "o_orderpriority")


# Quality.

@query
def missing_report(spark, folder):
    return quality.missing_report(_holed_lineitem(spark, folder))


@query
def missing_total(spark, folder):
    return quality.missing_total(_holed_lineitem(spark, folder))


@query
def high_risk_columns(spark, folder):
    return quality.high_risk_columns(_holed_lineitem(spark, folder))


@query
def duplicate_count(spark, folder):
    return quality.duplicate_count(table(spark, folder, "documents").select("text", "lang"))


@query
def duplicate_rows(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return quality.duplicate_rows(documents, ["doc_id"]).select("doc_id", "lang", F.length("text").alias("n"))


@query
def duplicate_rows_null_key(spark, folder):
    """Every seventh key missing: rows without one come first and are told apart by their content."""
    documents = table(spark, folder, "documents").select(
        F.expr("CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS doc_id"), "lang", F.expr("substring(source, 1, 4) AS source"))
    return quality.duplicate_rows(documents, ["doc_id"])


# Statistics.

@query
def table_size(spark, folder):
    return _stacked({t: describe.table_size(table(spark, folder, t)) for t in PROFILED})


@query
def column_counts(spark, folder):
    return describe.column_counts(_holed_lineitem(spark, folder))


@query
def numeric_summary(spark, folder):
    summary = _stacked({t: describe.numeric_summary(table(spark, folder, t)) for t in SUMMARISED})
    return _rounded(summary, 4, "mean", "std", "min", "q25", "median", "q75", "max", "skewness", "kurtosis")


@query
def categorical_summary(spark, folder):
    return _stacked({t: describe.categorical_summary(table(spark, folder, t)) for t in SUMMARISED})


@query
def top_values(spark, folder):
    return _stacked({t: describe.top_values(table(spark, folder, t)) for t in SUMMARISED})


@query
def quantiles_by_narrowing(spark, folder):
    """The path for tables too large for one aggregation buffer, on the whole table."""
    names, shares = ["l_extendedprice", "l_quantity", "l_orderkey"], [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    found = quantiles.exact_quantiles(table(spark, folder, "lineitem"), names, shares, direct_cells=0)
    rows = [(c, p, v) for c in names for p, v in zip(shares, found[c])]
    return spark.createDataFrame(rows, "column string, share double, value double")


# Correlation and outliers.

def _linear_lineitem(spark, folder):
    return table(spark, folder, "lineitem").withColumns({
        "doubled": F.expr("2 * l_extendedprice + 1"),
        "noisy": F.expr("l_extendedprice + 20000 * l_discount * l_quantity"),
        "holed": F.expr("CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_orderkey + l_extendedprice END"),
        "constant": F.expr("CAST(5.0 AS DOUBLE)"),
    })


def _pairs(spark, folder):
    lines = _linear_lineitem(spark, folder)
    return correlate.correlation_pairs(lines, columns=["l_orderkey", "l_extendedprice", "doubled", "noisy", "holed", "constant"])


@query
def corr_pairs(spark, folder):
    parts = {
        t: correlate.correlation_pairs(table(spark, folder, t))
        for t in ("orders", "lineitem", "supplier")
    }
    return _rounded(_stacked({**parts, "planted": _pairs(spark, folder)}), 6, "corr")


@query
def corr_matrix(spark, folder):
    return _rounded(correlate.correlation_matrix(_pairs(spark, folder)), 6, "corr")


@query
def corr_wide(spark, folder):
    """Columns with holes, a constant and a near copy."""
    lines = _linear_lineitem(spark, folder)
    names = ["l_orderkey", "l_extendedprice", "doubled", "noisy", "holed", "constant", "l_quantity", "l_tax"]
    return _rounded(correlate.correlation_pairs(lines, columns=names), 6, "corr")


@query
def corr_high(spark, folder):
    return correlate.strong_pairs(_pairs(spark, folder))


@query
def corr_target(spark, folder):
    return correlate.target_ranking(_pairs(spark, folder), "l_extendedprice")


@query
def outlier_report(spark, folder):
    return _stacked({
        t: outliers.outlier_report(df, outliers.fit_bounds(df))
        for t in OUTLYING for df in [table(spark, folder, t)]
    })


@query
def outlier_rows(spark, folder):
    return _stacked({
        t: outliers.outlier_rows(df, outliers.fit_bounds(df), [key]).withColumnRenamed(key, "row_key")
        for t, key in OUTLYING.items() for df in [table(spark, folder, t)]
    })


# Preparation.

def _fitted(step, df):
    return step.fit(df).transform(df)


@query
def drop_ids(spark, folder):
    return _fitted(steps.IdDropper(), table(spark, folder, "customer"))


@query
def impute_median(spark, folder):
    orders = _holed_orders(spark, folder)
    return _fitted(steps.ExactImputer(ORDER_ROLES), orders).select("o_orderkey", "o_totalprice")


@query
def impute_mode(spark, folder):
    orders = _holed_orders(spark, folder)
    return _fitted(steps.ExactImputer(ORDER_ROLES), orders).select("o_orderkey", "o_orderpriority")


@query
def interactions(spark, folder):
    orders = table(spark, folder, "orders")
    return _fitted(steps.FeatureMaker(ORDER_ROLES), orders).select("o_orderkey", "o_custkey_x_o_totalprice")


@query
def datetime_parts(spark, folder):
    orders = table(spark, folder, "orders")
    return _fitted(steps.FeatureMaker(ORDER_ROLES), orders).select(
        "o_orderkey", *[f"o_orderdate_{p}" for p in ("year", "month", "day", "dayofweek")])


@query
def onehot(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return _fitted(steps.CategoryEncoder({"o_orderstatus": roles.CATEGORICAL, "o_orderpriority": roles.CATEGORICAL}), orders)


@query
def frequency_encode(spark, folder):
    """Fitted without one brand, which is then unseen."""
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    encoder = steps.CategoryEncoder({"p_brand": roles.CATEGORICAL}).fit(parts.where("p_brand <> 'Brand#3'"))
    return encoder.transform(parts)


@query
def scale_standard(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return _rounded(_fitted(steps.Scaler("standard", ORDER_ROLES), orders), 6, "o_custkey", "o_totalprice")


@query
def scale_minmax(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return _rounded(_fitted(steps.Scaler("minmax", ORDER_ROLES), orders), 6, "o_custkey", "o_totalprice")


@query
def prepared_table(spark, folder):
    """The whole preparation, with the key passed through beside the features."""
    orders = _holed_orders(spark, folder).withColumn("row_key", F.col("o_orderkey"))
    fitted = prepare.fit_preparation(orders, ORDER_ROLES, assemble=False)
    scaled = _rounded(fitted.transform(orders), 6, "o_custkey", "o_totalprice")
    # Products run into billions, where a double holds no six decimals.
    return _rounded(scaled, 4, "o_custkey_x_o_totalprice")


# Splits.

@query
def split_flags(spark, folder):
    return split.with_test_flag(table(spark, folder, "orders"), ["o_orderkey"]).select("o_orderkey", "is_test")


@query
def split_shares(spark, folder):
    """Rows and test rows per class: the share is exact to the row."""
    orders = split.with_test_flag(table(spark, folder, "orders"), ["o_orderkey"], stratify="o_orderstatus")
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"))


@query
def fold_flags(spark, folder):
    return split.with_folds(table(spark, folder, "orders"), key_cols=["o_orderkey"]).select("o_orderkey", "fold")


@query
def fold_shares(spark, folder):
    orders = split.with_folds(table(spark, folder, "orders"), key_cols=["o_orderkey"], stratify="o_orderstatus")
    return split.part_shares(orders, "fold", ["o_orderstatus"])


@query
def split_train_test(spark, folder):
    """Which side every row of a stratified split is on."""
    train, test = split.split(table(spark, folder, "orders"), ["o_orderkey"], stratify="o_orderstatus")
    sides = [side.select("o_orderkey", "o_orderstatus", F.lit(name).alias("side")) for side, name in ((train, "train"), (test, "test"))]
    return sides[0].unionByName(sides[1])


# Evaluation.

@query
def accuracy(spark, folder):
    return _rounded(metrics.accuracy(_judged_orders(spark, folder)), 6, "accuracy")


@query
def class_scores(spark, folder):
    return _rounded(metrics.class_scores(_judged_orders(spark, folder)), 6, "precision", "recall", "f1")


@query
def weighted_scores(spark, folder):
    return _rounded(
        metrics.classification_scores(_judged_orders(spark, folder)), 6, "accuracy", "precision", "recall", "f1")


@query
def confusion(spark, folder):
    return metrics.confusion(_judged_orders(spark, folder))


@query
def confusion_missing(spark, folder):
    """The cells that occur, with rows that have no prediction."""
    judged = _judged_orders(spark, folder)
    holed = judged.withColumn("prediction", F.when(F.pmod(F.col("o_orderkey"), F.lit(10)) != 0, F.col("prediction")))
    return metrics.confusion(holed, zero_filled=False)


@query
def roc_points(spark, folder):
    return _rounded(metrics.roc_points(_judged_lines(spark, folder)), 8, "tpr", "fpr")


@query
def roc_auc(spark, folder):
    return _rounded(metrics.roc_auc(_judged_lines(spark, folder)), 8, "roc_auc")


@query
def pr_points(spark, folder):
    return _rounded(metrics.pr_points(_judged_lines(spark, folder)), 8, "precision", "recall")


@query
def regression_metrics(spark, folder):
    return _rounded(metrics.regression_scores(_judged_parts(spark, folder)), 6, "mae", "rmse", "r2", "mape")


@query
def residuals(spark, folder):
    found = metrics.residuals(_judged_parts(spark, folder), keep=["p_partkey"])
    return _rounded(found, 6, "actual", "predicted", "residual")


@query
def residual_range(spark, folder):
    return _rounded(metrics.common_range(_judged_parts(spark, folder)), 6, "low", "high")


# Models.

def _part_task(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return compare.Task.of(parts, "p_retailprice", overrides={"p_partkey": roles.NUMERICAL})


def _mean(shape):
    return candidates.Baseline(roles.REGRESSION)


def _line():
    return candidates.candidates(roles.REGRESSION)["linear_regression"]


@query
def linear_fit_one_feature(spark, folder):
    fitted = _part_task(spark, folder).fit(_line())
    model = next(s for s in fitted.stages if hasattr(s, "coefficients"))
    row = [("p_partkey", float(model.coefficients[0]), float(model.intercept))]
    fit = spark.createDataFrame(row, "feature string, coefficient double, intercept double")
    return _rounded(fit, 4, "coefficient", "intercept")


@query
def batch_score(spark, folder):
    fitted = _part_task(spark, folder).fit(_line())
    return _rounded(score.score_batch(fitted, table(spark, folder, "part")), 4, "prediction")


@query
def scoring_missing_columns(spark, folder):
    """A column the model needs is an error when it is missing, any other is not."""
    fitted, parts = _part_task(spark, folder).fit(_line()), table(spark, folder, "part")
    found = []
    for dropped in ("p_name", "p_partkey"):
        try:
            found.append((dropped, score.score_batch(fitted, parts.drop(dropped)).count(), None))
        except steps.MissingColumns as error:
            found.append((dropped, 0, str(error)))
    return spark.createDataFrame(found, "dropped string, n_scored bigint, error string")


@query
def stream_score(spark, folder):
    fitted = _part_task(spark, folder).fit(_line())
    out = scratch_path(spark, "stream")
    schema = table(spark, folder, "part").schema
    arriving = scoring.read_stream(spark, f"{folder.rstrip('/')}/part.parquet*", schema)
    scoring.start_scoring(fitted, arriving, f"{out}/scored", f"{out}/progress").awaitTermination()
    return _rounded(spark.read.parquet(f"{out}/scored"), 4, "prediction")


@query
def baseline_predictions(spark, folder):
    orders = table(spark, folder, "orders")
    guess = candidates.Baseline(roles.REGRESSION).fit(orders.select(F.col("o_totalprice").alias(LABEL)))
    scored = metrics.regression_scores(guess.transform(orders), "o_totalprice", PREDICTION)
    return _rounded(scored, 4, "mae", "rmse", "r2", "mape")


def _rule_scores(spark, folder):
    """Fold scores of three fixed rules on the lines, with the order deciding the fold."""
    lines = table(spark, folder, "lineitem").select(
        F.expr("CAST(l_orderkey % 5 AS INT)").alias("fold"),
        F.expr("CAST(l_extendedprice * (1 - l_discount) > 30000 AS INT)").alias("label"),
        F.explode(F.expr(
            "array(struct('always' AS model, 1 AS prediction), "
            "struct('by_price' AS model, CAST(l_extendedprice > 32000 AS INT) AS prediction), "
            "struct('by_quantity' AS model, CAST(l_quantity > 25 AS INT) AS prediction))")).alias("rule"),
    ).select("fold", "label", "rule.*")
    wide = metrics.classification_scores(lines, by=["model", "fold"])
    return wide.select("model", "fold", F.explode(F.array(
        F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("score")),
        F.struct(F.lit("f1").alias("metric"), F.col("f1").alias("score")),
    )).alias("s")).select("model", "fold", "s.*", F.lit(0.0).alias("seconds"))


@query
def score_summary(spark, folder):
    return _rounded(compare.score_summary(_rule_scores(spark, folder)), 6, "mean", "std")


@query
def leaderboard(spark, folder):
    return compare.leaderboard(_rule_scores(spark, folder), roles.CLASSIFICATION)


def _revenue_task(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.expr("l_extendedprice * (1 - l_discount) > 30000").alias("large"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    numbers = dict.fromkeys(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), roles.NUMERICAL)
    overrides = {**numbers, "l_returnflag": roles.CATEGORICAL, "l_linestatus": roles.CATEGORICAL, "l_shipdate": roles.ROLE_DATETIME}
    return compare.Task.of(lines, "large", overrides=overrides)


@query
def compare_classifiers(spark, folder):
    task = _revenue_task(spark, folder)
    return compare.leaderboard(compare.compare_models(task), task.problem)


def _event_task(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value", "event_type", F.expr("3 * value + 5").alias("y"))
    overrides = {"value": roles.NUMERICAL, "event_type": roles.CATEGORICAL}
    return compare.Task.of(events, "y", ["event_id"], overrides)


@query
def compare_regressors(spark, folder):
    task = _event_task(spark, folder)
    return compare.leaderboard(compare.compare_models(task), task.problem)


def _exact_regressors():
    """Candidates whose fits SQL can follow."""
    return {"linear_regression": _line(), "mean": _mean}


@query
def compare_exact(spark, folder):
    """The leaderboard of the line and the mean."""
    task = _event_task(spark, folder)
    board = compare.leaderboard(compare.compare_models(task, _exact_regressors()), task.problem)
    scores = ("neg_rmse", "neg_rmse_std", "r2", "r2_std")
    return board.select("model", *[(F.round(c, 3) + 0.0).alias(c) for c in scores])


@query
def best_refit(spark, folder):
    """The winner of a comparison, refitted and scored on rows it has not seen."""
    task = _event_task(spark, folder)
    train, test = split.split(task.train, ["event_id"])
    learned = compare.Task.of(train, "y", ["event_id"], task.roles)
    name, fitted = compare.fit_best(learned, compare.compare_models(learned, _exact_regressors()), _exact_regressors())
    held_out = compare.held_out_score(fitted, test, "y", learned.problem)
    return held_out.select(F.lit(name).alias("model"), "metric", F.round("score", 6).alias("score"))


def _family(task, name):
    return candidates.candidates(task.problem)[name]


@query
def tune_random(spark, folder):
    task = _event_task(spark, folder)
    return _tuned(spark, tune.tune(task, "boosting_fast", _family(task, "boosting_fast")))


@query
def tune_grid(spark, folder):
    task = _event_task(spark, folder)
    return _tuned(spark, tune.tune(task, "random_forest", _family(task, "random_forest"), "grid", candidates.GRIDS["random_forest"]))


@query
def tune_without_space(spark, folder):
    """A family without a space is fitted as it is; a method that is not known is refused."""
    task = _part_task(spark, folder)
    found = tune.tune(task, "mean", _mean)
    try:
        tune.tune(task, "mean", _mean, "annealing")
        refused = None
    except ValueError as error:
        refused = str(error)
    scored = score.score_batch(found.fitted, table(spark, folder, "part"))
    return scored.select("p_partkey", F.lit(found.method).alias("method"), F.lit(found.tried).alias("tried"),
                         F.lit(refused).alias("refused"), F.round("prediction", 4).alias("prediction"))


def _tuned(spark, found):
    row = [(found.model, found.method, found.score, {k: str(v) for k, v in found.params.items()}, found.tried)]
    return spark.createDataFrame(row, "model string, method string, score double, params map<string,string>, tried int").select(
        "model", "method", "score", F.to_json("params").alias("params"), "tried")


@query
def learning_curve(spark, folder):
    task = _event_task(spark, folder)
    curve = curves.learning_curve(curves.learning_scores(task, _line()))
    return _rounded(curve, 6, "train_mean", "train_std", "validation_mean", "validation_std")


@query
def feature_importance(spark, folder):
    task = _revenue_task(spark, folder)
    fitted = task.fit(_family(task, "random_forest"))
    return curves.top_features(curves.feature_importance(fitted, spark))


@query
def line_importance(spark, folder):
    """Absolute coefficients of a line that one column decides alone."""
    task = _event_task(spark, folder)
    found = curves.top_features(curves.feature_importance(task.fit(_line()), spark))
    return _rounded(found, 3, "importance")


# Attribution.

def _forest_on_orders(spark, folder):
    orders = table(spark, folder, "orders").withColumn("dear", F.expr("o_totalprice > 250000 OR o_orderstatus = 'F'"))
    task = compare.Task.of(orders, "dear", ["o_orderkey"], ORDER_ROLES)
    return orders, task


@query
def shap_adds_up(spark, folder):
    """Every row's attributions and the base value give its probability."""
    orders, task = _forest_on_orders(spark, folder)
    fitted = task.fit(_family(task, "random_forest"))
    explainer = attribute.make_explainer(fitted, orders, ["o_orderkey"])
    total = attribute.explained_output(attribute.explain(explainer, orders, ["o_orderkey"]), ["o_orderkey"])
    scored = score.score_batch(fitted, orders).select("o_orderkey", "prediction_probability")
    gap = F.abs(F.col("output") - F.col("prediction_probability"))
    return total.join(scored, "o_orderkey").select("o_orderkey", (gap < 1e-9).alias("adds_up"))


@query
def shap_boosted_adds_up(spark, folder):
    orders, task = _forest_on_orders(spark, folder)
    fitted = task.fit(_family(task, "boosting_fast"))
    explainer = attribute.make_explainer(fitted, orders, ["o_orderkey"])
    total = attribute.explained_output(attribute.explain(explainer, orders, ["o_orderkey"]), ["o_orderkey"])
    scored = score.score_batch(fitted, orders).select("o_orderkey", "prediction_probability")
    gap = F.abs(F.col("output") - F.col("prediction_probability"))
    return total.join(scored, "o_orderkey").select("o_orderkey", (gap < 1e-9).alias("adds_up"))


@query
def shap_global(spark, folder):
    orders, task = _forest_on_orders(spark, folder)
    fitted = task.fit(_family(task, "random_forest"))
    explainer = attribute.make_explainer(fitted, orders, ["o_orderkey"])
    return attribute.top_global(attribute.explain_sample(explainer, orders, ["o_orderkey"]))


@query
def shap_global_exact(spark, folder):
    """Mean absolute attributions of a stump, which its two levels and the background's mean decide."""
    parts = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice", F.expr("IF(p_size > 25, 10D, 0D)").alias("y"))
    numbers = {"p_size": roles.NUMERICAL, "p_retailprice": roles.NUMERICAL}
    task = compare.Task.of(parts, "y", ["p_partkey"], numbers, roles.REGRESSION)
    fitted = task.fit(DecisionTreeRegressor(maxDepth=1, maxBins=64))
    explainer = attribute.make_explainer(fitted, parts, ["p_partkey"])
    shap = attribute.global_importance(attribute.explain(explainer, parts, ["p_partkey"]))
    return _rounded(shap, 6, "mean_abs_shap")


@query
def shap_one_row(spark, folder):
    """The attributions of the dearest order give its probability."""
    orders, task = _forest_on_orders(spark, folder)
    fitted = task.fit(_family(task, "random_forest"))
    explainer = attribute.make_explainer(fitted, orders, ["o_orderkey"])
    dearest = orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(1)
    total = attribute.explained_output(attribute.explain_row(explainer, dearest, ["o_orderkey"]), ["o_orderkey"])
    scored = score.score_batch(fitted, dearest).select("o_orderkey", "prediction_probability")
    gap = F.abs(F.col("output") - F.col("prediction_probability"))
    return total.join(scored, "o_orderkey").select("o_orderkey", (gap < 1e-9).alias("adds_up"))


def _shap_table(spark, folder):
    """Attributions of a plain sum of three centred columns, in the long form of the explainer."""
    lines = table(spark, folder, "part").select(
        "p_partkey", F.explode(F.expr(
            "array(struct('p_retailprice' AS feature, p_retailprice AS value, p_retailprice - 1000 AS shap), "
            "struct('p_size' AS feature, CAST(p_size AS DOUBLE) AS value, 3.0D * (25 - p_size) AS shap), "
            "struct('p_brand_length' AS feature, CAST(length(p_brand) AS DOUBLE) AS value, length(p_brand) - 7.5D AS shap), "
            "struct('constant' AS feature, 1.0D AS value, 0.0D AS shap))")).alias("c"))
    return lines.select("p_partkey", "c.*", F.lit(0.5).alias("base_value"))


@query
def shap_top_global(spark, folder):
    return _rounded(attribute.top_global(_shap_table(spark, folder), 3), 6, "mean_abs_shap")


@query
def shap_beeswarm(spark, folder):
    return _rounded(attribute.beeswarm(_shap_table(spark, folder), ["p_partkey"], 3), 6, "shap", "position")


@query
def shap_waterfall(spark, folder):
    return _rounded(attribute.waterfall(_shap_table(spark, folder), ["p_partkey"], 2), 6, "value", "shap")


# Versions and names; the event log stands for the tables of a model store.

def _store_tables(spark, folder):
    events = table(spark, folder, "events")
    saved = events.select(F.col("event_type").alias("dataset"), F.col("event_id").alias("version"))
    promoted = events.where("value > 120").select(
        F.col("event_type").alias("dataset"), F.col("event_id").alias("version"), F.col("ts").alias("at"))
    deleted = events.where("user_id < 40").select(F.col("event_type").alias("dataset"), F.col("event_id").alias("version"))
    return saved, promoted, deleted


@query
def version_next(spark, folder):
    return versions.next_versions(_store_tables(spark, folder)[0])


@query
def version_resolve(spark, folder):
    saved, promoted, deleted = _store_tables(spark, folder)
    return versions.current_versions(saved, promoted, deleted)


@query
def version_delete(spark, folder):
    """Deleting all promoted versions leaves the newest remaining one in force."""
    saved, promoted, deleted = _store_tables(spark, folder)
    gone = deleted.unionByName(promoted.select("dataset", "version"))
    return versions.current_versions(saved, promoted, gone)


@query
def version_list(spark, folder):
    saved, _, deleted = _store_tables(spark, folder)
    return versions.versions_newest_first(saved, deleted, "click")


@query
def version_datasets(spark, folder):
    saved, _, deleted = _store_tables(spark, folder)
    return versions.datasets_with_versions(saved, deleted)


def _filled_store(spark, folder):
    """A store written step by step: the last two of three versions come into force, one is deleted, the first is promoted."""
    task, parts = _part_task(spark, folder), table(spark, folder, "part")
    store = versions.ModelStore(spark, scratch_path(spark, "store"))
    fits = {"line": task.fit(_line()), "mean": task.fit(_mean)}
    rows = parts.count()
    for name in ("line", "mean", "mean"):
        errors = metrics.regression_scores(score.score_batch(fits[name], parts), "p_retailprice", "prediction").first()
        store.save("Parts (all).csv", name, task.problem, fits[name], {"rmse": errors["rmse"]}, {"scaling": task.scaling}, list(task.roles), rows)
    store.delete("Parts (all).csv", 3)
    store.promote("Parts (all).csv", 1)
    return store


@query
def store_scores(spark, folder):
    """Every part scored by the version in force, loaded from the store."""
    fitted = _filled_store(spark, folder).load("Parts (all).csv")
    return _rounded(score.score_batch(fitted, table(spark, folder, "part")), 4, "prediction")


@query
def store_versions(spark, folder):
    """What the store says about its versions, and which one is in force."""
    store = _filled_store(spark, folder)
    current = store.metadata("Parts (all).csv")["version"]
    return store.list_versions("Parts (all).csv").select(
        "dataset", "version", "model_name", "problem", F.round(F.col("metrics")["rmse"], 4).alias("rmse"),
        F.col("hyperparameters")["scaling"].alias("scaling"), F.array_join("feature_columns", ",").alias("features"),
        "n_train_rows", (F.col("version") == current).alias("in_force"),
    )


@query
def sanitize_name(spark, folder):
    return table(spark, folder, "pages").select("page_id", safe_name(F.col("url")).alias("name"))


# Sources and sinks.

@query
def csv_roundtrip(spark, folder):
    """A table written as CSV and read back with inferred types."""
    path = scratch_path(spark, "csv")
    orders = table(spark, folder, "orders")
    tables.write_csv(orders, path)
    read = tables.read_csv(spark, path)
    typed = read.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in orders.schema.fields])
    return typed.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


@query
def csv_texts(spark, folder):
    """Cells with commas, quotes and line breaks."""
    path = scratch_path(spark, "texts")
    documents = table(spark, folder, "documents").select("doc_id", F.concat(F.lit(' say "yes", '), "text").alias("text"), "lang")
    tables.write_csv(documents, path)
    return tables.read_csv(spark, path, documents.schema)


@query
def csv_windows(spark, folder):
    """Typographic quotes and the euro sign in windows-1252."""
    path = scratch_path(spark, "windows")
    names = table(spark, folder, "customer").select("c_custkey", F.concat(F.lit("“"), "c_name", F.lit("” 5 €")).alias("c_name"))
    stored = names.withColumn("c_name", F.translate("c_name", tables.SIGNS, tables.CONTROLS))
    stored.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return tables.read_csv(spark, path, names.schema)


@query
def csv_latin1(spark, folder):
    """Names with an umlaut in a single-byte encoding, which UTF-8 cannot decode."""
    path = scratch_path(spark, "latin1")
    names = table(spark, folder, "customer").select("c_custkey", F.concat("c_name", F.lit(" Müller")).alias("c_name"))
    names.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return tables.read_csv(spark, path, names.schema)


@query
def land_dataset(spark, folder):
    path = tables.land(table(spark, folder, "supplier"), scratch_path(spark, "landed"), "My Suppliers (new).csv")
    return tables.read_parquet(spark, path)


@query
def run_log(spark, folder):
    """One run per compared rule, written and read back."""
    log = runs.RunLog(spark, scratch_path(spark, "runs"))
    log.append_comparison(_rule_scores(spark, folder), "lineitem", roles.CLASSIFICATION, 5)
    return log.read().select(
        "run_name", F.col("tags")["dataset"].alias("dataset"), F.col("params")["folds"].alias("folds"),
        F.round(F.col("metrics")["accuracy"], 6).alias("accuracy"),
        F.round(F.col("metrics")["accuracy_std"], 6).alias("accuracy_std"),
    )


@query
def table_profile(spark, folder):
    """Per column: role, missing values, distinct values, and the numeric summary where there is one."""
    lines = table(spark, folder, "lineitem")
    found = roles.infer_roles(lines)
    by_role = spark.createDataFrame(list(found.items()), "column string, role string")
    summary = describe.numeric_summary(lines, found).drop("n_present")
    profiled = (
        by_role.join(describe.column_counts(lines), "column")
        .join(profile.distinct_counts(lines, lines.columns), "column")
        .join(summary, "column", "left")
    )
    return _rounded(profiled, 4, "mean", "std", "min", "q25", "median", "q75", "max", "skewness", "kurtosis")
