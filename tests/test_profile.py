"""Validation, roles, quality, statistics, correlation and outliers on small planted frames."""

import random
import statistics
from collections import Counter

import pandas as pd
import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colonnade.functions.names import hints_at_id_column, safe_name_of
from colonnade.operators import correlate, describe, outliers, profile, quality, quantiles, roles, validate


def frame(spark, columns: dict, schema: str):
    return spark.createDataFrame(list(zip(*columns.values())), schema)


@pytest.fixture(scope="module")
def valid(spark):
    """River gauges: a running number, a flow, a river of three, and whether the weir is open at every other one."""
    n = range(28)
    return frame(spark, {
        "gauge": [100 + i for i in n], "flow": [0.25 * i * i + 3.0 for i in n],
        "river": [("Elbe", "Oder", "Spree")[i * i % 3] for i in n], "open": [(i + 1) % 2 for i in n],
    }, "gauge int, flow double, river string, open int")


def test_clean_table_is_valid(valid):
    assert validate.is_valid(validate.validate_table(valid))
    assert roles.infer_roles(valid) == {
        "gauge": "id_like", "flow": "numerical", "river": "categorical", "open": "categorical"}
    assert roles.problem_type(valid, "open") == "classification"
    assert roles.problem_type(valid, "flow") == "regression"
    assert roles.problem_type(valid, "river") == "classification"


def test_few_rows_are_an_error(spark):
    report = validate.validate_table(spark.createDataFrame([(1, 2), (3, 4)], "a int, b int"))
    assert rows(report, "rule", "severity") == [("min_rows", "error")]
    assert "rows" in report.first()["message"]
    assert not validate.is_valid(report)


def test_empty_column_is_an_error_and_mostly_missing(valid):
    report = validate.validate_table(valid.withColumn("empty_col", F.lit(None).cast("double")))
    assert rows(report, "rule", "severity", "column") == [
        ("empty_column", "error", "empty_col"), ("mostly_missing", "warning", "empty_col")]


def test_half_missing_is_not_more_than_half(valid):
    half = valid.withColumn("half", F.when(F.col("open") == 1, 1))
    assert validate.validate_table(half).isEmpty()


def test_repeated_names_and_single_column(valid):
    doubled = valid.select("gauge", F.col("flow").alias("gauge"))
    assert ("repeated_name", "gauge") in rows(validate.validate_table(doubled), "rule", "column")
    assert ("min_columns", None) in rows(validate.validate_table(valid.select("gauge")), "rule", "column")


def test_target_rules(valid):
    df = valid.withColumns({
        "constant_target": F.lit(1), "holed": F.when(F.col("gauge") > 104, F.col("open")),
        "nothing": F.lit(None).cast("int")})

    def rules(target):
        return rows(validate.validate_target(df, target), "rule", "value")

    assert rules("open") == []
    assert rules("constant_target") == [("target_constant", 1.0)]
    assert rules("nothing") == [("target_constant", 0.0), ("target_missing", 28.0)]
    assert rules("holed") == [("target_missing", 5.0)]
    assert rules("absent") == [("target_absent", None)]


def test_missing_and_statistics(spark):
    n = range(27)
    df = frame(spark, {
        "depth": [None if i % 9 == 4 else 1.5 * (i % 9) for i in n], "volume": [311 + 47 * i * i for i in n],
        "river": [("Elbe", "Oder", "Spree")[i // 2 % 3] for i in n],
    }, "depth double, volume int, river string")
    assert rows(quality.missing_report(df), "column", "n_missing") == [("depth", 3), ("river", 0), ("volume", 0)]
    assert rows(quality.missing_total(df)) == [(3, 81, 3.7)]
    assert rows(describe.table_size(df)) == [(27, 3)]
    found = roles.infer_roles(df)
    assert found == {"depth": "categorical", "volume": "numerical", "river": "categorical"}
    assert [r["column"] for r in describe.numeric_summary(df, found).collect()] == ["volume"]
    assert rows(describe.categorical_summary(df, found), "column", "mode") == [("depth", "0.0"), ("river", "Elbe")]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c")], "x double, s string")
    assert rows(quality.missing_report(df), "column", "n_missing") == [("s", 0), ("x", 2)]


def test_high_risk_is_at_least_forty_percent(spark):
    df = spark.createDataFrame(
        [(1.0 if i < 2 else None, 1.0 if i < 6 else None, i) for i in range(10)],
        "mostly_missing double, on_the_line double, fine int")
    assert rows(quality.high_risk_columns(df), "column") == [("mostly_missing",), ("on_the_line",)]


def test_duplicates(spark):
    df = spark.createDataFrame(
        [(i, *[(7, "Elbe"), (7, None), (None, "Elbe"), (9, "Spree")][i % 4]) for i in range(8)], "id int, gauge int, river string")
    plain = df.drop("id")
    assert rows(quality.duplicate_count(plain)) == [(8, 4, 50.0)]
    assert rows(quality.duplicate_rows(df, ["id"]), "id") == [(i,) for i in range(4, 8)]


def test_rows_that_only_join_to_the_same_text_differ(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "x"), ("x", None), ("-", "x")], "a string, b string")
    assert quality.duplicate_count(df).first()["n_duplicates"] == 0


def test_role_rules(spark):
    n = 40
    df = frame(spark, {
        "order_uuid": [1000 - 7 * i for i in range(n)], "code": [3 * i for i in range(n)],
        "run": list(range(5, 5 + n)), "price": [1.5 * i for i in range(n)], "flag": [i % 2 == 0 for i in range(n)],
        "name": [f"n{i}" for i in range(n)], "day": [f"2023-01-{1 + i % 28:02d}" for i in range(n)],
        "mixed": [("2023-01-01", "no date")[i % 2] for i in range(n)], "level": [i % 20 for i in range(n)],
        "more": [i % 21 for i in range(n)], "holed_run": [None if i == 7 else i for i in range(n)],
        "listed": [[i] for i in range(n)],
    }, "order_uuid int, code int, run int, price double, flag boolean, name string, day string, mixed string, "
       "level int, more int, holed_run int, listed array<int>")
    assert roles.infer_roles(df) == {
        "order_uuid": "id_like", "code": "numerical", "run": "id_like", "price": "numerical", "flag": "boolean",
        "name": "id_like", "day": "datetime", "mixed": "categorical", "level": "categorical", "more": "numerical",
        "holed_run": "numerical", "listed": "unsupported"}


def test_twenty_rows_are_too_few_for_an_id(spark):
    assert roles.infer_roles(spark.range(20))["id"] == "categorical"
    assert roles.infer_roles(spark.range(21))["id"] == "id_like"


def test_overrides():
    found = {"a": "numerical", "b": "id_like"}
    assert roles.with_overrides(found, {"b": "categorical", "absent": "numerical"}) == {"a": "numerical", "b": "categorical"}
    with pytest.raises(ValueError, match="unknown role"):
        roles.with_overrides(found, {"a": "number"})


def test_names(spark):
    names = spark.createDataFrame([("Passenger_ID",), ("width",), ("age",), (" u_u-id ",)], "name string")
    assert rows(names.select("name", hints_at_id_column(names["name"]).alias("hinted"))) == [
        (" u_u-id ", True), ("Passenger_ID", True), ("age", False), ("width", True)]
    assert safe_name_of("../My data (1).csv") == "___my_data__1_"


def test_sketch_and_exact_counts_agree_on_roles(spark, medium):
    """The sketch decides as counting does, on every test table."""
    for name in ("lineitem", "orders", "customer", "events"):
        df = spark.read.parquet(f"{medium}/{name}.parquet")
        facts = profile.column_facts(df)
        exact = profile.exact_distinct(df, df.columns)
        by_counting = {f.name: roles._role(f, exact[f.name]) for f in facts}
        assert roles.infer_roles(df, facts) == by_counting


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (10, "a"), (9, "b"), (None, None)], "n int, s string")
    assert rows(profile.modes(df, ["n", "s"]), "column", "value") == [("n", "9"), ("s", "a")]


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_frequent_long_texts(spark, monkeypatch, broadcast):
    """Texts that share a beginning are ordered by what follows, short ones among them."""
    monkeypatch.setattr(profile, "BROADCAST_CANDIDATES", broadcast)
    begin = "w" * profile.PREFIX
    texts = [begin + "b"] * 3 + [begin + "a"] * 3 + [begin] * 3 + ["z" * 200] * 4 + ["short"] * 3 + [begin + f"{i:02}" for i in range(20)] + [None]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "t string, n int")
    counts = Counter(t for t in texts if t is not None)
    expected = sorted(counts.items(), key=lambda item: (-item[1], item[0]))
    for top in (1, 3, 4, 9, 40):
        found = profile.frequent_values(df.select("t"), ["t"], top).orderBy("rank").collect()
        assert [(r["value"], r["n"]) for r in found] == expected[:top] and [r["rank"] for r in found] == list(range(1, len(found) + 1))
    assert rows(profile.modes(df, ["t", "n"]), "column", "value") == [("n", "0"), ("t", "z" * 200)]
    summary = describe.categorical_summary(df, {"t": "categorical", "n": "categorical"})
    assert rows(summary.where("column = 't'")) == [("t", 36, 25, "z" * 200, 4)]


def test_long_texts_are_told_apart(spark):
    df = spark.createDataFrame([("x" * 100 + "1",), ("x" * 100 + "2",), ("x" * 100 + "1",)], "t string")
    assert profile.exact_distinct(df, ["t"]) == {"t": 2}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float), st.floats(-1e6, 1e6)), max_size=60))
def test_quantiles_by_narrowing_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    quantiles_before = quantiles.SKETCH_SIZE
    quantiles.SKETCH_SIZE = 8
    try:
        found = quantiles.exact_quantiles(df, ["x"], shares, direct_cells=0)["x"]
    finally:
        quantiles.SKETCH_SIZE = quantiles_before
    present = pd.Series([v for v in values if v is not None], dtype=float)
    if present.empty:
        assert found == [None] * len(shares)
    else:
        assert found == pytest.approx([present.quantile(p) for p in shares], rel=1e-12, abs=1e-9)


def test_quantiles_with_one_hot_value(spark):
    source = random.Random(3)
    values = [7.0] * 20000 + [source.uniform(0, 14) for _ in range(40000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    shares = [0.25, 0.5, 0.75, 0.999]
    found = quantiles.exact_quantiles(df, ["x"], shares, direct_cells=0)["x"]
    assert found == pytest.approx([pd.Series(values).quantile(p) for p in shares], rel=1e-12)


def test_moments_against_pandas(spark):
    source = random.Random(1)
    values = [source.expovariate(0.1) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = describe.numeric_summary(df, {"x": "numerical"}).first()
    series = pd.Series(values)
    assert got["std"] == pytest.approx(statistics.stdev(values))
    assert got["skewness"] == pytest.approx(series.skew())
    assert got["kurtosis"] == pytest.approx(series.kurt())
    assert got["q25"] == pytest.approx(series.quantile(0.25))


@pytest.mark.parametrize("values, skew, kurt", [([1.0, 2.0], None, None), ([5.0] * 6, 0.0, 0.0), ([1.0, 2.0, 4.0], 0.9352, None)])
def test_moments_of_few_and_constant_values(spark, values, skew, kurt):
    got = describe.numeric_summary(spark.createDataFrame([(v,) for v in values], "x double"), {"x": "numerical"}).first()
    assert (got["skewness"] and round(got["skewness"], 4)) == skew
    assert got["kurtosis"] == kurt


@pytest.fixture(scope="module")
def correlated(spark):
    """``low`` falls as ``high`` rises, ``other`` jumps about."""
    n = range(26)
    return frame(spark, {
        "high": [i * i - 3 * i for i in n], "low": [4 - 0.5 * (i * i - 3 * i) for i in n], "other": [29 * i * i % 53 for i in n],
    }, "high int, low double, other int")


def test_correlation(correlated):
    pairs = correlate.correlation_pairs(correlated)
    assert rows(correlate.strong_pairs(pairs)) == [("high", "low", -1.0)]
    assert [r["column"] for r in correlate.target_ranking(pairs, "high").collect()] == ["low", "other"]
    assert correlate.correlation_matrix(pairs).count() == 9
    assert correlate.correlation_pairs(correlated, columns=["high"]).isEmpty()


def test_wide_correlation_equals_pandas(spark):
    source = random.Random(5)
    names = [f"c{i}" for i in range(25)]
    data = [[source.gauss(1000, 1) if source.random() > 0.1 else None for _ in names] for _ in range(60)]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names)).withColumn("k", F.lit(0.1))
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in correlate.correlation_pairs(df, columns=df.columns).collect()}
    expected = pd.DataFrame(data, columns=names, dtype=float).corr()
    assert len(got) == 26 * 25 // 2
    for (a, b), value in got.items():
        if b == "k":
            assert value is None
        else:
            assert value == pytest.approx(expected.loc[a, b], abs=1e-9)


def test_outliers(spark):
    values = [*(2.5 + 0.5 * (i % 7) for i in range(24)), 90.0, -75.0]
    df = spark.createDataFrame(list(enumerate(values)), "id int, level double")
    bounds = outliers.fit_bounds(df, columns=["level"])
    report = outliers.outlier_report(df, bounds).first()
    assert (report["n_present"], report["iqr_count"]) == (26, 2)
    assert rows(outliers.outlier_rows(df, bounds, ["id"]), "value") == [(-75.0,), (90.0,)]


def test_constant_has_no_outliers_and_nan_is_none(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(15)] + [(99, float("nan"))], "id int, x double")
    bounds = outliers.fit_bounds(df, columns=["x"])
    report = outliers.outlier_report(df, bounds).first()
    assert (report["n_present"], report["iqr_count"], report["zscore_count"]) == (15, 0, 0)
    assert outliers.outlier_rows(df, bounds, ["id"]).isEmpty()


def test_correlation_far_from_the_mean(spark):
    """Pairs that are complete in few rows only, far from the columns' means, and more than ten columns."""
    rng = np.random.default_rng(4)
    n = 4000
    frame = pd.DataFrame({f"c{i}": rng.normal(size=n) for i in range(9)})
    base = 1e7 + rng.normal(size=n)
    far = np.arange(n) % 100 == 0
    frame["a"] = np.where(far, base, rng.normal(size=n))
    frame["b"] = np.where(far, base + 0.05 * rng.normal(size=n), np.nan)
    frame["constant"] = 0.1
    names = list(frame.columns)
    found = {(r["col_a"], r["col_b"]): r["corr"] for r in correlate.correlation_pairs(spark.createDataFrame(frame).repartition(7), columns=names).collect()}
    expected = frame.corr()
    assert len(found) == len(names) * (len(names) - 1) // 2
    for (a, b), value in found.items():
        if "constant" in (a, b):
            assert value is None
        else:
            assert value == pytest.approx(expected.loc[a, b], abs=1e-6)
    assert found["a", "b"] > 0.99


def test_duplicates_without_a_unique_key(spark):
    df = spark.createDataFrame([(None, "x"), (2, "y"), (3, "y"), (4, "z"), (4, "z"), (None, "w"), (None, "w"), (7, "w")], "k int, t string")
    assert rows(quality.duplicate_rows(df, ["k"])) == sorted([(3, "y"), (4, "z"), (None, "w"), (7, "w")], key=repr)


def test_outlier_filter_reaches_the_reader(spark, small):
    from colonnade.operators import outliers
    from colonnade.sources.tables import read_parquet

    df = read_parquet(spark, f"{small}/events.parquet")
    found = outliers.outlier_rows(df, outliers.fit_bounds(df, columns=["value"]), ["event_id"])
    assert "PushedFilters: [Or(" in found._jdf.queryExecution().toString()


def test_texts_that_cannot_be_dates_are_told_without_trying(spark):
    """Texts of two digits in a frame of signs are no dates; whatever a layout reads still counts as one."""
    dates = ["2024-01-31T10:11:12.123456+02:00", "2024-01-31T10:11:12Z", "2024-01-31 10:11:12.5", "2024-01-31 10:11", " 2024-01-31 ", "2024/01/31",
             "2024/01/31 10:11:12", "01/31/2024", "01/31/2024 10:11:12", "01-31-2024", "31.01.2024", "31 Jan 2024", "Jan 31, 2024", "20240131"]
    others = ['{"k": 76}', "Customer#000000012", "2024-01-31_2", "(12) 34 56"]
    df = spark.createDataFrame([(t,) for t in dates + others], "t string")
    assert profile.column_facts(df)[0].dates == len(dates)
    tried = {r["t"] for r in df.where(F.trim("t").rlike(profile.DATE_LIKE)).collect()}
    assert tried == set(dates)
