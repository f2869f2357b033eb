"""The feature schema document: columns, domains, encoded names and area statistics in one row."""

from pyspark.sql import DataFrame, functions as F

from harvestline import fixed_values as fv
from harvestline.operators.encoding import FeatureModel, fit_features
from harvestline.operators.insights import area_stats
from harvestline.operators.shaping import complete_rows
from harvestline.sources.stored import stored


def fit_schema(enriched: DataFrame) -> tuple[FeatureModel, DataFrame]:
    """Fit on the complete rows, keeping every category, and document the result."""
    complete, _ = complete_rows(enriched, [*fv.FEATURES, fv.TARGET])
    rows = stored(complete, "schema-rows")
    model = fit_features(rows, drop_first=False, impute=False)
    return model, schema_document(rows, model)


def schema_document(rows: DataFrame, model: FeatureModel) -> DataFrame:
    """Document of an already fitted encoding; nothing is refitted."""

    def texts(values):
        return F.array(*[F.lit(v) for v in values])

    area = area_stats(rows).select(F.struct("min", "max", "mean", "median", "std")).scalar()
    domain = {f"unique_{c}": F.array_sort(F.collect_set(c)).alias(f"unique_{c}") for c in (*model.categorical, "crop_year")}
    known = rows.agg(*domain.values(), F.count("*").alias("n_training_samples"))
    return known.select(
        texts([*model.categorical, *model.numerical]).alias("feature_columns"),
        texts(model.categorical).alias("categorical_columns"),
        texts(model.numerical).alias("numerical_columns"),
        F.lit(fv.TARGET).alias("target_column"),
        texts(model.names).alias("output_feature_names"),
        F.lit(model.width).alias("n_output_features"),
        F.lit("crop" if "crop" in model.categorical else None).alias("crop_column"),
        F.lit("state" if "state" in model.categorical else None).alias("state_column"),
        area.alias("stats_area"),
        "n_training_samples",
        *domain,
    )
