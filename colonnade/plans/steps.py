"""Preparation steps: ``Estimator``/``Model`` pairs whose transforms are column expressions.

What a step has learned is one JSON param, so the models save and load like any
other ``pyspark.ml`` stage. Only the frequency table of a column with very many
values is too large for that; it is kept and saved as a parquet table, as are
the labels of a target with very many classes.
Columns without a role pass through every step untouched.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReader, MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import DATETIME, FLOAT, INTEGER, STRING, as_text, col, kinds, nan_to_null, value_key
from colonnade.functions.dates import DATE_PARTS, date_parts, read_datetime
from colonnade.operators.lookup import lookup
from colonnade.operators.profile import exact_distinct, modes, value_histogram
from colonnade.operators.quantiles import exact_quantiles
from colonnade.operators.roles import (
    CATEGORICAL, ID_LIKE, NUMERICAL, ROLE_BOOLEAN, ROLE_DATETIME, UNSUPPORTED, infer_roles, of_role,
)
from colonnade.session import scratch_path

# Fixed values of the preparation.
PRODUCT_COLUMNS = 6
ONE_HOT_LEVELS = 10
NO_VALUE = "missing"
SCALINGS = ("standard", "minmax")

# Frequencies of up to this many levels are kept in the JSON state.
INLINE_LEVELS = 10_000


class _Json(Params):
    """A JSON value held in a string param."""

    def _json(self, param: Param):
        return json.loads(self.getOrDefault(param))


class _Step(Estimator, _Json, DefaultParamsReadable, DefaultParamsWritable):
    roles = Param(Params._dummy(), "roles", "JSON object of column roles; inferred on fit if empty", TypeConverters.toString)

    def _roles(self, df: DataFrame) -> dict[str, str]:
        given = self._json(self.roles) if self.isSet(self.roles) else {}
        return {c: r for c, r in (given or infer_roles(df)).items() if c in df.columns}

    def with_roles(self, roles: Mapping[str, str] | None):
        if roles:
            self._set(roles=json.dumps(dict(roles)))
        return self


class _Fitted(Model, _Json, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "what was learned, as JSON", TypeConverters.toString)

    @classmethod
    def of(cls, state):
        model = cls()
        model._set(state=json.dumps(state))
        return model

    @property
    def learned(self):
        if not self.isSet(self.state):
            raise RuntimeError(f"{type(self).__name__} has not been fitted")
        return self._json(self.state)


class MissingColumns(ValueError):
    """Columns the model was trained on are not in the table."""


class ColumnCheck(_Fitted):
    """First stage of a fitted pipeline: the raw columns it needs, in training order."""

    @staticmethod
    def check(df: DataFrame, required: Sequence[str]) -> list[str]:
        absent = [c for c in required if c not in df.columns]
        if absent:
            raise MissingColumns(f"missing columns: {', '.join(absent)}")
        return list(required)

    def _transform(self, df: DataFrame) -> DataFrame:
        self.check(df, self.learned)
        return df


class IdDropper(_Step):
    """Drops identifiers and columns of a type that cannot be a feature."""

    def __init__(self, roles: Mapping[str, str] | None = None):
        super().__init__()
        self.with_roles(roles)

    def _fit(self, df: DataFrame) -> IdDropperModel:
        return IdDropperModel.of(of_role(self._roles(df), ID_LIKE, UNSUPPORTED))


class IdDropperModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        gone = set(self.learned)
        return df.select(*[col(c) for c in df.columns if c not in gone])


class ExactImputer(_Step):
    """Numerical columns get the exact median, categories and flags the mode."""

    def __init__(self, roles: Mapping[str, str] | None = None):
        super().__init__()
        self.with_roles(roles)

    def _fit(self, df: DataFrame) -> ExactImputerModel:
        roles, df = self._roles(df), nan_to_null(df)
        numerical, levels = of_role(roles, NUMERICAL), of_role(roles, CATEGORICAL, ROLE_BOOLEAN)
        medians = {c: q[0] for c, q in exact_quantiles(df, numerical, (0.5,)).items()}
        found = {r["column"]: r["value"] for r in modes(df, levels).collect()} if levels else {}
        return ExactImputerModel.of({
            "numbers": {c: m for c, m in medians.items() if m is not None},
            "levels": {c: found.get(c) for c in levels},
        })


class ExactImputerModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        df = nan_to_null(df)
        numbers, levels, kind = self.learned["numbers"], self.learned["levels"], kinds(df)

        def filled(c: str) -> Column:
            if c in numbers:
                return F.coalesce(col(c).cast("double"), F.lit(numbers[c])).alias(c)
            if c in levels and levels[c] is not None:
                return F.coalesce(col(c), F.lit(levels[c]).cast(df.schema[c].dataType)).alias(c)
            if c in levels and kind[c] == STRING:
                return F.coalesce(col(c), F.lit(NO_VALUE)).alias(c)
            return col(c)

        return df.select(*[filled(c) for c in df.columns])


class FeatureMaker(_Step):
    """Products of the first numerical columns, and calendar parts of dates."""

    def __init__(self, roles: Mapping[str, str] | None = None):
        super().__init__()
        self.with_roles(roles)

    def _fit(self, df: DataFrame) -> FeatureMakerModel:
        roles = self._roles(df)
        numerical = [c for c in df.columns if roles.get(c) == NUMERICAL][:PRODUCT_COLUMNS]
        return FeatureMakerModel.of({
            "products": list(combinations(numerical, 2)), "dates": of_role(roles, ROLE_DATETIME),
        })


class FeatureMakerModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        products, dates, kind = self.learned["products"], self.learned["dates"], kinds(df)
        made = [
            (col(a).cast("double") * col(b).cast("double")).alias(f"{a}_x_{b}") for a, b in products
        ]
        for c in dates:
            stamp = col(c) if kind[c] == DATETIME else read_datetime(col(c).cast("string"))
            parts = date_parts(stamp)
            made += [parts[p].alias(f"{c}_{p}") for p in DATE_PARTS]
        return df.select(*[col(c) for c in df.columns if c not in set(dates)], *made)


class CategoryEncoder(_Step):
    """One-hot columns for few levels, the share of training rows for many."""

    def __init__(self, roles: Mapping[str, str] | None = None):
        super().__init__()
        self.with_roles(roles)

    def _fit(self, df: DataFrame) -> CategoryEncoderModel:
        roles, df = self._roles(df), nan_to_null(df)
        names = of_role(roles, CATEGORICAL, ROLE_BOOLEAN)
        if not names:
            return CategoryEncoderModel.of({"one_hot": {}, "shares": {}, "entries": {}})
        histogram = value_histogram(df, names, digest=True)
        seen = histogram.limit(INLINE_LEVELS + 1).collect()
        if len(seen) <= INLINE_LEVELS:
            counts: dict[str, dict[str, int]] = {c: {} for c in names}
            for r in seen:
                counts[r["column"]][r["value"]] = r["n"]
            return encoder_of(df, counts, df.count())
        distinct = exact_distinct(df, names)
        few = [c for c in names if distinct[c] <= ONE_HOT_LEVELS]
        many = [c for c in names if c not in few]
        rows = df.count()
        path = scratch_path(df.sparkSession, "levels")
        # Written, so that neither the histogram nor the training data is needed again.
        (
            value_histogram(df, many, digest=True)
            .select("column", F.col("value").alias("key"), (F.col("n") / F.lit(float(rows))).alias("share"))
            .write.parquet(path)
        )
        model = CategoryEncoderModel.of({
            "one_hot": _levels(df, few), "shares": {c: None for c in many}, "entries": {c: distinct[c] for c in many},
        })
        model._table = df.sparkSession.read.parquet(path)
        return model


def _levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """The sorted levels of columns that have few."""
    levels: dict[str, list[str]] = {c: [] for c in columns}
    if columns:
        for r in value_histogram(df, columns).collect():
            levels[r["column"]].append(r["value"])
    return {c: sorted(found) for c, found in levels.items()}


def encoder_of(df: DataFrame, counts: Mapping[str, Mapping[str, int]], rows: int) -> CategoryEncoderModel:
    """The encoder for counts of value keys that fit on the driver."""
    kind = kinds(df)
    few = [c for c, n in counts.items() if len(n) <= ONE_HOT_LEVELS]
    digested = [c for c in few if kind[c] == STRING and any(k.startswith("#") for k in counts[c])]
    one_hot = _levels(df, digested)
    for c in few:
        if c not in one_hot:
            one_hot[c] = sorted(k[1:] if kind[c] == STRING else k for k in counts[c])
    shares = {c: {k: n / rows for k, n in counts[c].items()} for c in counts if c not in one_hot}
    return CategoryEncoderModel.of({
        "one_hot": {c: one_hot[c] for c in few}, "shares": shares, "entries": {c: len(v) for c, v in shares.items()},
    })


def _free_names(wanted: list[str], taken: list[str]) -> list[str]:
    """``wanted``, with a number behind each name that an earlier one has, whatever the case."""
    seen, found = {t.lower() for t in taken}, []
    for name in wanted:
        free, n = name, 1
        while free.lower() in seen:
            n += 1
            free = f"{name}__{n}"
        seen.add(free.lower())
        found.append(free)
    return found


class CategoryEncoderModel(_Fitted):
    """Levels unseen in training are all zeros, or share 0."""

    _table: DataFrame | None = None

    def _share_table(self, df: DataFrame, column: str) -> DataFrame:
        inline = self.learned["shares"][column]
        if inline is None:
            table = self._table.where(F.col("column") == column).select("key", "share")
        else:
            table = df.sparkSession.createDataFrame(list(inline.items()), "key string, share double")
        return table.select("key", F.col("share").alias("value"), "share")

    def _transform(self, df: DataFrame) -> DataFrame:
        learned = self.learned
        one_hot, shares, kind = learned["one_hot"], learned["shares"], kinds(df)
        encoded = set(one_hot) | set(shares)
        untouched = [c for c in df.columns if c not in encoded]
        names = _free_names([f"{c}_{level}" for c, levels in one_hot.items() for level in levels], [*untouched, *(f"{c}_freq" for c in shares)])
        indicators = [
            F.when(as_text(c, kind[c]) == level, F.lit(1.0)).otherwise(F.lit(0.0)).alias(name)
            for (c, level), name in zip(((c, level) for c, levels in one_hot.items() for level in levels), names)
        ]
        for c in shares:
            if shares[c] is None or shares[c]:
                df = lookup(df, value_key(c, kind[c]), self._share_table(df, c), learned["entries"][c], f"{c}_freq")
            else:
                df = df.withColumn(f"{c}_freq", F.lit(None).cast("double"))
        frequencies = [F.coalesce(col(f"{c}_freq"), F.lit(0.0)).alias(f"{c}_freq") for c in shares]
        return df.select(*[col(c) for c in untouched], *indicators, *frequencies)

    @property
    def keeps_table(self) -> bool:
        return any(v is None for v in self.learned["shares"].values())

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _TableWriter(DefaultParamsWriter):
    """Saves a model whose state is partly a table."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        if self.instance._table is not None:
            self.instance._table.write.parquet(f"{path}/levels")


class _TableReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        if model.keeps_table:
            model._table = self.sparkSession.read.parquet(f"{path}/levels")
        return model


class Scaler(_Step):
    """Numerical columns to mean 0 and population deviation 1, or to the range 0 to 1."""

    method = Param(Params._dummy(), "method", "standard or minmax", TypeConverters.toString)

    def __init__(self, method: str = "standard", roles: Mapping[str, str] | None = None):
        super().__init__()
        if method not in SCALINGS:
            raise ValueError(f"method must be one of {', '.join(SCALINGS)}, not {method!r}")
        self._set(method=method)
        self.with_roles(roles)

    def _fit(self, df: DataFrame) -> ScalerModel:
        names = of_role(self._roles(df), NUMERICAL)
        if not names:
            return ScalerModel.of({})
        return ScalerModel.of(fit_scaling(nan_to_null(df), {c: col(c) for c in names}, self.getOrDefault(self.method)))


def fit_scaling(df: DataFrame, columns: Mapping[str, Column], method: str) -> dict[str, list[float]]:
    """``{column: [shift, width]}`` from one aggregate."""
    parts = []
    for x in columns.values():
        x = x.cast("double")
        parts += [F.avg(x), F.stddev_pop(x)] if method == "standard" else [F.min(x), F.max(x) - F.min(x)]
    found = df.agg(*[p.alias(f"s{i}") for i, p in enumerate(parts)]).first()
    return {c: [found[2 * i] or 0.0, found[2 * i + 1] or 0.0] for i, c in enumerate(columns)}


class ScalerModel(_Fitted):
    def _transform(self, df: DataFrame) -> DataFrame:
        learned = self.learned

        def scaled(c: str) -> Column:
            if c not in learned:
                return col(c)
            shift, width = learned[c]
            x = col(c).cast("double") - F.lit(shift)
            # A constant column has no width; its training value becomes 0.
            return (x / F.lit(width) if width else x).alias(c)

        return df.select(*[scaled(c) for c in df.columns])


class FeatureVector(Estimator, _Json, DefaultParamsReadable, DefaultParamsWritable):
    """Collects every prepared column but the ones passed through into ``features``."""

    passthrough = Param(Params._dummy(), "passthrough", "JSON list of columns that are no features", TypeConverters.toString)
    missing = Param(Params._dummy(), "missing", "error, or zero for features still missing", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, passthrough: Sequence[str] = (), missing: str = "error"):
        super().__init__()
        if missing not in ("error", "zero"):
            raise ValueError(f"missing must be error or zero, not {missing!r}")
        self._set(passthrough=json.dumps(list(passthrough)), missing=missing)

    def _fit(self, df: DataFrame) -> FeatureVectorModel:
        outside, kind = set(self._json(self.passthrough)), kinds(df)
        names = [c for c in df.columns if c not in outside]
        odd = [c for c in names if kind[c] not in (INTEGER, FLOAT)]
        if odd:
            raise ValueError(f"not numeric after preparation: {', '.join(odd)}")
        if not names:
            raise ValueError("no feature is left after preparation")
        return FeatureVectorModel.of({"names": names, "missing": self.getOrDefault(self.missing)})


class FeatureVectorModel(_Fitted):
    @property
    def names(self) -> list[str]:
        return self.learned["names"]

    def _transform(self, df: DataFrame) -> DataFrame:
        names, zero = self.names, self.learned["missing"] == "zero"
        # The assembler reads a dot in a name as nesting, hence the plain names.
        plain = [f"__f{i}" for i in range(len(names))]
        parts = [col(c).cast("double") for c in names]
        if zero:
            parts = [F.coalesce(x, F.lit(0.0)) for x in parts]
        wide = df.select("*", *[x.alias(p) for x, p in zip(parts, plain)])
        assembler = VectorAssembler(inputCols=plain, outputCol="features", handleInvalid="error")
        return assembler.transform(wide).drop(*plain)
