"""Preparation steps, splits and folds."""

import pytest
from conftest import rows
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from colonnade.operators import lookup, split
from colonnade.plans import prepare, steps

RIVERS = ["Elbe", "Oder", "Spree", None]


@pytest.fixture(scope="module")
def train(spark):
    data = [(i, None if i == 8 else 7 * i * i % 31, RIVERS[(0, 0, 1, 2, 3)[i % 5]], f"G{i % 13}") for i in range(27)]
    return spark.createDataFrame(data, "id int, depth int, river string, gauge string")


ROLES = {"depth": "numerical", "river": "categorical", "gauge": "categorical"}


def depths(train):
    return sorted(r["depth"] for r in train.collect() if r["depth"] is not None)


def test_test_rows_get_the_median_and_mode_of_training(spark, train):
    model = steps.ExactImputer(ROLES).fit(train)
    test = spark.createDataFrame([(1, None, None, "G1"), (2, 999, "Rhine", "G2")], train.schema)
    known = depths(train)
    median = (known[12] + known[13]) / 2
    assert rows(model.transform(test), "depth", "river") == [(median, "Elbe"), (999.0, "Rhine")]


def test_column_without_values_becomes_missing(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "t string, n double")
    filled = steps.ExactImputer({"t": "categorical", "n": "numerical"}).fit(df).transform(df)
    assert rows(filled) == [("missing", None)] * 2


def test_encoding(spark, train):
    model = steps.CategoryEncoder(ROLES).fit(train.fillna({"river": "Elbe"}))
    out = model.transform(spark.createDataFrame([(1, 1, "Spree", "G0"), (2, 2, "Rhine", "G99")], train.schema))
    assert out.columns == ["id", "depth", "river_Elbe", "river_Oder", "river_Spree", "gauge_freq"]
    assert rows(out, *out.columns[2:]) == [(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 3 / 27)]


def test_awkward_names_and_levels(spark):
    df = spark.createDataFrame([(1, "a.b`c"), (2, "x y"), (3, None)], "`n.o` int, `c a.t` string")
    out = steps.CategoryEncoder({"c a.t": "categorical"}).fit(df).transform(df)
    assert out.columns == ["n.o", "c a.t_a.b`c", "c a.t_x y"]
    vector = steps.FeatureVector(passthrough=[]).fit(out).transform(out)
    assert vector.first()["features"].toArray().tolist() == [1.0, 1.0, 0.0]


def test_ids_are_dropped_and_unfitted_models_refuse(spark, train):
    df = train.select(F.col("id").alias("gauge_id"), "depth").unionByName(
        spark.range(27, 33).select(F.col("id").cast("int").alias("gauge_id"), F.lit(3).alias("depth")))
    assert steps.IdDropper().fit(df).transform(df).columns == ["depth"]
    with pytest.raises(RuntimeError, match="not been fitted"):
        steps.IdDropperModel().transform(df)


def test_scaling_uses_training_values(spark):
    df = spark.createDataFrame([(7 * i * i % 31, 5.0) for i in range(24)], "depth int, k double")
    kinds = {"depth": "numerical", "k": "numerical"}
    standard = steps.Scaler("standard", kinds).fit(df)
    scaled = standard.transform(df)
    assert scaled.agg(F.avg("depth")).first()[0] == pytest.approx(0)
    assert scaled.agg(F.stddev_pop("depth")).first()[0] == pytest.approx(1)
    assert scaled.agg(F.max(F.abs("k"))).first()[0] == 0
    assert standard.transform(spark.createDataFrame([(999, 5.0)], df.schema)).first()["depth"] > 5
    ranged = steps.Scaler("minmax", kinds).fit(df).transform(df)
    assert ranged.agg(F.min("depth"), F.max("depth"), F.max("k")).first()[:] == (0.0, 1.0, 0.0)
    with pytest.raises(ValueError, match="standard, minmax"):
        steps.Scaler("robust")


def test_products_are_made_of_the_first_six(spark):
    df = spark.createDataFrame([tuple(float(i) for i in range(8))], ", ".join(f"c{i} double" for i in range(8)))
    made = steps.FeatureMaker(dict.fromkeys(df.columns, "numerical")).fit(df).transform(df)
    assert len(made.columns) == 8 + 15
    assert made.first()["c4_x_c5"] == 20.0


def test_dates_become_parts(spark):
    df = spark.createDataFrame([("2023-01-01",), ("05/17/2024",), ("soon",), (None,)], "day string")
    out = steps.FeatureMaker({"day": "datetime"}).fit(df).transform(df)
    assert rows(out) == sorted(
        [(2023, 1, 1, 6), (2024, 5, 17, 4), (None,) * 4, (None,) * 4], key=repr)


@pytest.fixture(scope="module")
def whole(spark):
    data = [(None if i == 11 else 0.1 * i * i - 4, RIVERS[i % 4], i % 5 == 0, f"2023-02-{1 + i % 27:02d}", f"c{i % 13}", i % 2)
            for i in range(50)]
    return spark.createDataFrame(data, "depth double, river string, member boolean, day string, code string, target int")


def test_whole_preparation(spark, whole):
    pipeline = prepare.build_preparation(whole, exclude=["target"], assemble=True)
    by_steps = pipeline.fit(whole)
    out = by_steps.transform(whole)
    assert "river" not in out.columns and "target" in out.columns
    numeric = [t for c, t in out.dtypes if c not in ("features",)]
    assert set(numeric) <= {"int", "double"}
    assert out.dropna().count() == 50
    assert by_steps.transform(whole.limit(7)).columns == out.columns


def test_fused_fit_equals_the_fit_of_every_step(spark, whole):
    roles = prepare.feature_roles(whole, exclude=["target"])
    by_steps = prepare.build_preparation(whole, exclude=["target"], assemble=True).fit(whole)
    fused = prepare.fit_preparation(whole, roles)
    for a, b in zip(by_steps.stages, fused.stages, strict=True):
        assert type(a) is type(b) and a.learned == b.learned


def test_many_levels_use_the_table_path(spark, whole, tmp_path, monkeypatch):
    roles = prepare.feature_roles(whole, exclude=["target"])
    expected = rows(prepare.fit_preparation(whole, roles, assemble=False).transform(whole))
    monkeypatch.setattr(steps, "INLINE_LEVELS", 5)
    monkeypatch.setattr(lookup, "BROADCAST_ENTRIES", 5)
    monkeypatch.setattr(lookup, "HOT_PARTS", 13)
    model = prepare.fit_preparation(whole, roles, assemble=False)
    assert rows(model.transform(whole)) == expected
    model.write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert rows(loaded.transform(whole)) == expected


def test_lookup_keeps_rows_without_key_and_hot_values(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_ENTRIES", 1)
    monkeypatch.setattr(lookup, "HOT_PARTS", 4)
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"v{i}") for i in range(30)], "i int, k string")
    table = spark.createDataFrame([("hot", 1.0, 0.33), ("v2", 2.0, 0.01), ("v5", 5.0, 0.01)], "key string, value double, share double")
    out = {r["i"]: r["x"] for r in lookup.lookup(df, F.col("k"), table, 3, "x").collect()}
    assert len(out) == 30 and out[0] == 1.0 and out[1] is None and out[2] == 2.0 and out[5] == 5.0 and out[8] is None


def test_missing_features_are_an_error_or_zero(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    with pytest.raises(Exception, match="null"):
        steps.FeatureVector().fit(df).transform(df).collect()
    filled = steps.FeatureVector(missing="zero").fit(df).transform(df)
    assert filled.first()["features"].toArray().tolist() == [1.0, 0.0]


def test_overrides_are_obeyed_and_absent_ones_ignored(spark):
    df = spark.createDataFrame([(1 + i % 3,) for i in range(30)], "code int")
    pipeline = prepare.build_preparation(df, overrides={"code": "numerical", "absent": "categorical"})
    assert pipeline.fit(df).transform(df).columns == ["code"]


# Splits.

@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(1000).withColumn("target", F.when(F.col("id") % 5 == 0, "rare").otherwise("common"))


def test_split_is_complete_disjoint_and_stratified(labelled):
    train, test = split.split(labelled, ["id"], stratify="target")
    assert train.count() + test.count() == 1000
    assert train.join(test, "id").isEmpty()
    assert rows(test.groupBy("target").count()) == [("common", 160), ("rare", 40)]


def test_split_does_not_depend_on_partitions(labelled):
    flags = [rows(split.with_test_flag(df, ["id"], stratify="target")) for df in (labelled, labelled.repartition(17))]
    folds = [rows(split.with_folds(df, 4, ["id"])) for df in (labelled, labelled.repartition(17))]
    assert flags[0] == flags[1] and folds[0] == folds[1]


def test_singleton_class_falls_back(spark):
    df = spark.range(20).withColumn("target", F.when(F.col("id") == 7, "rare").otherwise("common"))
    train, test = split.split(df, ["id"], stratify="target")
    assert train.count() + test.count() == 20


@pytest.mark.parametrize("errors", [8.0, 0.01])
def test_shares_are_exact_in_classes_of_any_size(spark, monkeypatch, errors):
    """Also where the first place to look for a threshold does not hold it."""
    monkeypatch.setattr(split, "STANDARD_ERRORS", errors)
    df = spark.range(30_203).withColumn("target", F.when(F.col("id") < 203, "small").otherwise("large"))
    flagged = split.with_test_flag(df, ["id"], stratify="target")
    assert rows(flagged.groupBy("target").agg(F.count_if("is_test").alias("n"))) == [("large", 6000), ("small", 41)]


def test_lookup_of_a_value_hot_only_now(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_ENTRIES", 1)
    monkeypatch.setattr(lookup, "HOT_PARTS", 2)
    entries = spark.createDataFrame([("=a", 1.0, 0.6), ("=b", 2.0, 0.3), ("=c", 3.0, 0.1)], "key string, value double, share double")
    df = spark.range(900).withColumn("v", F.expr("CASE WHEN id % 9 = 0 THEN 'a' WHEN id % 9 < 6 THEN 'c' WHEN id % 9 < 8 THEN 'unseen' END"))
    found = lookup.lookup(df, F.concat(F.lit("="), "v"), entries, 3, "found")
    assert rows(found.groupBy("v", "found").count()) == sorted([("a", 1.0, 100), ("c", 3.0, 500), ("unseen", None, 200), (None, None, 100)], key=repr)


def test_equal_hot_rows_are_spread(spark, monkeypatch):
    """A table of one column in which a value that was rare now holds nearly all rows."""
    monkeypatch.setattr(lookup, "BROADCAST_ENTRIES", 1)
    entries = spark.createDataFrame([("=a", 1.0, 0.00001), ("=b", 2.0, 0.3)], "key string, value double, share double")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df = spark.range(80_000, numPartitions=8).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("v"))
        found = lookup.lookup(df, F.concat(F.lit("="), "v"), entries, 2, "found")
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert rows(found.groupBy("v", "found").count()) == [("a", 1.0, 72_000), ("b", 2.0, 8_000)]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert max(sizes) < 60_000 and len(sizes) > 2


def test_many_entries_are_never_broadcast(spark, monkeypatch, tmp_path):
    """The file of a table is small, its salted copies are not: no threshold may send them all to the driver."""
    monkeypatch.setattr(lookup, "BROADCAST_ENTRIES", 1)
    spark.range(300).select(F.concat(F.lit("="), "id").alias("key"), F.col("id").alias("value"), F.lit(0.00001).alias("share")).write.parquet(
        str(tmp_path / "entries"))
    entries = spark.read.parquet(str(tmp_path / "entries"))
    found = lookup.lookup(spark.range(400), F.concat(F.lit("="), "id"), entries, 300, "found")
    assert found.where("found = id").count() == 300 and found.where("found IS NULL").count() == 100
    joins = found._jdf.queryExecution().executedPlan().toString()
    # The entries of many rows are broadcast, the others are not.
    assert joins.count("BroadcastHashJoin") == 1 and "SortMergeJoin" in joins


def test_many_classes_do_not_reach_the_driver(spark, labelled, monkeypatch):
    expected = rows(split.with_folds(labelled, 5, ["id"], stratify="target"))
    monkeypatch.setattr(split, "INLINE_CLASSES", 1)
    assert rows(split.with_folds(labelled, 5, ["id"], stratify="target")) == expected


def test_folds_are_even_within_classes(labelled):
    counted = split.part_shares(split.with_folds(labelled, 5, ["id"], stratify="target"), "fold", ["target"])
    assert {r["n"] for r in counted.collect()} == {160, 40}
    with pytest.raises(ValueError, match="between 2 and 10"):
        split.with_folds(labelled, 11)


def test_equal_rows_share_a_fold_without_a_key(spark):
    df = spark.createDataFrame([(1, "a")] * 5 + [(2, "b")] * 5, "n int, s string")
    assert split.with_folds(df, 3).distinct().count() == 2
