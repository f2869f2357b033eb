"""Column names, target, projection and row completeness."""

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from harvestline import fixed_values as fv
from harvestline.functions.labels import source_badge
from harvestline.functions.numbers import compact_text
from harvestline.functions.text import display_name


def clean_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def clean_columns(
    df: DataFrame,
    target: str = fv.TARGET,
    drop: Iterable[str] = tuple(fv.EXCLUDED),
    strict: bool = True,
) -> DataFrame:
    """Normalised names, the target under its own name, leakage columns gone. Metadata only."""
    names = [clean_name(c) for c in df.columns]
    names = [f"cost_of_{n.removeprefix('costof_')}" if n.startswith("costof_") else n for n in names]
    candidates = [i for i, n in enumerate(names) if target in n]
    if candidates:
        names[candidates[0]] = target
    elif strict:
        raise KeyError(f"no column name contains {target!r}: {names}")
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"several columns clean to the same name: {repeated}")
    return df.toDF(*names).drop(*drop)


def check_no_leakage(df: DataFrame, target: str = fv.TARGET) -> DataFrame:
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is missing")
    leaked = [c for c in fv.EXCLUDED[:1] if c in df.columns]
    if leaked:
        raise ValueError(f"columns that reveal the target: {leaked}")
    return df


def missing_columns(df: DataFrame, required: Iterable[str] = tuple(fv.FEATURES)) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Iterable[str] = tuple(fv.FEATURES)) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns {missing}; available {df.columns}")
    return df


def project_features(df: DataFrame, types: Mapping[str, str] = fv.FEATURE_TYPES, keep: Iterable[str] = ()) -> DataFrame:
    """The features in schema order; an absent one is NULL."""
    return df.select(
        *keep,
        *[
            F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c)
            for c, t in types.items()
        ],
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def completeness(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Rows, complete rows and rows that miss a required value."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull()
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(whole).alias("kept"), F.count_if(~whole).alias("dropped")
    )


def complete_rows(df: DataFrame, required: Iterable[str], at_least: int = 10) -> tuple[DataFrame, dict]:
    """Rows without NULL in the required columns, with the counts; too few rows is an error."""
    required = [c for c in required if c in df.columns]
    counts = completeness(df, required).first().asDict()
    if counts["kept"] < at_least:
        raise ValueError(f"only {counts['kept']} complete rows")
    return df.select(*required).dropna("any"), counts


def _kind(feature) -> tuple:
    kind = (
        F.when(feature.isin(*fv.CATEGORICAL), "categorical")
        .when(feature.isin(*fv.WEATHER), "weather")
        .when(feature == fv.IRRIGATION, "irrigation")
        .when(feature == fv.FERTILIZER, "fertilizer")
        .otherwise("numerical")
    )
    origin = (
        F.when(feature.isin(*fv.WEATHER), "daily observations / seasonal forecast")
        .when(feature == fv.IRRIGATION, "irrigation dimension / user")
        .when(feature == fv.FERTILIZER, "fertilizer dimension / user")
        .otherwise("dataset")
    )
    return kind, origin


def feature_catalog(df: DataFrame, features: Iterable[str] = tuple(fv.FEATURES)) -> DataFrame:
    """One row per feature: display name, kind, origin and how many rows carry a value."""
    features = list(features)
    counts = df.agg(*[F.count(c).alias(c) for c in features])
    rows = counts.unpivot([], features, "feature", "n_values")
    kind, origin = _kind(F.col("feature"))
    return rows.select(
        "feature", display_name(F.col("feature")).alias("display"), kind.alias("kind"), origin.alias("origin"), "n_values"
    )


def input_summary(inputs: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per request and feature: display name, formatted value, where the value came from.

    `inputs` carries the features, `irrigation_source`, `npk_source` and `weather_source`.
    """
    texts = [
        (F.col(c).cast("string") if c in (*fv.CATEGORICAL, "crop_year") else compact_text(F.col(c))).alias(c)
        for c in fv.FEATURES
    ]
    sources = ["irrigation_source", "npk_source", "weather_source"]
    long = inputs.select(key, *sources, *texts).unpivot([key, *sources], fv.FEATURES, "feature", "value")
    source = (
        F.when(F.col("feature") == fv.IRRIGATION, F.col("irrigation_source"))
        .when(F.col("feature") == fv.FERTILIZER, F.col("npk_source"))
        .when(F.col("feature").isin(*fv.WEATHER), F.col("weather_source"))
        .otherwise("user")
    )
    return long.select(
        key,
        "feature",
        display_name(F.col("feature")).alias("display"),
        "value",
        source.alias("source"),
        source_badge(source).alias("badge"),
    )
