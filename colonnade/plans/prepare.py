"""The preparation pipeline: drop ids, impute, make features, encode, scale, assemble."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.columns import STRING, col, kinds, nan_to_null
from colonnade.operators.profile import modes, value_histogram
from colonnade.operators.quantiles import exact_quantiles
from colonnade.operators.roles import (
    CATEGORICAL, NUMERICAL, ROLE_BOOLEAN, ROLES, infer_roles, of_role, with_overrides,
)
from colonnade.plans import steps


def feature_roles(
    df: DataFrame, overrides: Mapping[str, str] | None = None, exclude: Sequence[str] = ()
) -> dict[str, str]:
    """Roles of the feature columns; overrides for absent or excluded columns are ignored.

    The data is not looked at where the overrides name every feature.
    """
    names = [c for c in df.columns if c not in set(exclude)]
    given = {c: r for c, r in (overrides or {}).items() if c in names}
    if all(c in given for c in names) and all(r in ROLES for r in given.values()):
        return {c: given[c] for c in names}
    return with_overrides(infer_roles(df.select(*[col(c) for c in names])), given)


def build_preparation(
    df: DataFrame,
    scaling: str = "standard",
    overrides: Mapping[str, str] | None = None,
    exclude: Sequence[str] = (),
    assemble: bool = False,
    missing: str = "error",
) -> Pipeline:
    """An unfitted pipeline over the columns of ``df`` that are not excluded.

    Excluded columns (target, key, fold) pass through. With ``assemble`` the
    last stage makes the ``features`` vector.
    """
    roles = feature_roles(df, overrides, exclude)
    stages = [
        steps.ColumnCheck.of(list(roles)), steps.IdDropper(roles), steps.ExactImputer(roles), steps.FeatureMaker(roles),
        steps.CategoryEncoder(roles), steps.Scaler(scaling, roles),
    ]
    if assemble:
        stages.append(steps.FeatureVector(passthrough=[c for c in df.columns if c not in roles], missing=missing))
    return Pipeline(stages=stages)


def fit_preparation(
    df: DataFrame,
    roles: Mapping[str, str],
    scaling: str = "standard",
    assemble: bool = True,
    missing: str = "error",
) -> PipelineModel:
    """The same fitted pipeline in three scans instead of one or two per step.

    One scan finds the medians; one histogram gives modes, one-hot levels and
    frequencies, since imputing a mode only moves the missing rows onto it; one
    aggregate over the imputed columns gives the scaling. Where the levels do
    not fit the driver the encoder is fitted by itself.
    """
    df = nan_to_null(df)
    roles = {c: r for c, r in roles.items() if c in df.columns}
    kind = kinds(df)
    numerical, levelled = of_role(roles, NUMERICAL), of_role(roles, CATEGORICAL, ROLE_BOOLEAN)
    rows = df.count()
    medians = {c: q[0] for c, q in exact_quantiles(df, numerical, (0.5,), rows).items()}

    counts: dict[str, dict[str, int]] | None = {c: {} for c in levelled}
    if levelled:
        seen = value_histogram(df, levelled, digest=True).limit(steps.INLINE_LEVELS + 1).collect()
        if len(seen) > steps.INLINE_LEVELS:
            counts = None
        else:
            for r in seen:
                counts[r["column"]][r["value"]] = r["n"]
    if counts is None or any(k.startswith("#") for c in levelled if kind[c] == STRING for k in counts[c]):
        found = {r["column"]: r["value"] for r in modes(df, levelled).collect()}
    else:
        found = {c: _mode(counts[c], kind[c]) for c in levelled}
    imputer = steps.ExactImputerModel.of({
        "numbers": {c: m for c, m in medians.items() if m is not None},
        "levels": {c: found.get(c) for c in levelled},
    })
    dropper = steps.IdDropper(roles).fit(df)
    maker = steps.FeatureMaker(roles).fit(df)
    if counts is None:
        encoder = steps.CategoryEncoder(roles).fit(imputer.transform(df))
    else:
        for c in levelled:
            _impute_counts(counts[c], found.get(c), kind[c], rows)
        encoder = steps.encoder_of(imputer.transform(df), counts, rows)
    filled = {
        c: F.coalesce(col(c).cast("double"), F.lit(medians[c])) if medians[c] is not None else col(c).cast("double")
        for c in numerical
    }
    scaler = steps.ScalerModel.of(steps.fit_scaling(df, filled, scaling) if numerical else {})
    stages = [steps.ColumnCheck.of(list(roles)), dropper, imputer, maker, encoder, scaler]
    if assemble:
        prepared = PipelineModel(stages).transform(df)
        vector = steps.FeatureVector(passthrough=[c for c in df.columns if c not in roles], missing=missing)
        stages.append(vector.fit(prepared))
    return PipelineModel(stages)


def _mode(counts: Mapping[str, int], kind: str) -> str | None:
    """The most frequent value; ties go to the smallest, numbers compared as numbers."""
    if not counts:
        return None
    most = max(counts.values())
    tied = [k for k, n in counts.items() if n == most]
    if kind == STRING:
        return min(tied)[1:]
    try:
        return min(tied, key=lambda k: (float(k), k))
    except ValueError:
        return min(tied)


def _impute_counts(counts: dict[str, int], mode: str | None, kind: str, rows: int) -> None:
    """Moves the missing rows onto the imputed level, in place."""
    missing = rows - sum(counts.values())
    if not missing:
        return
    if kind == STRING:
        mode = steps.NO_VALUE if mode is None else mode
        key = f"={mode}"
        if len(mode) > 48:
            from hashlib import sha256

            key = "#" + sha256(mode.encode()).hexdigest()
    elif mode is None:
        return
    else:
        key = mode
    counts[key] = counts.get(key, 0) + missing


def feature_names(prepared: PipelineModel) -> list[str]:
    """Names of the assembled features, in vector order."""
    for stage in prepared.stages:
        if isinstance(stage, steps.FeatureVectorModel):
            return stage.names
    raise ValueError("this pipeline does not assemble features")
