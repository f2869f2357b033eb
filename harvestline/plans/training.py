"""Train: split, clean, enrich, encode, search, check, record."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestline import fixed_values as fv
from harvestline.operators.encoding import fit_features
from harvestline.operators.enrichment import enrich_all
from harvestline.operators.metrics import check_quality, regression_metrics
from harvestline.operators.modeling import SEARCH_THREADS, YieldModel, score, search
from harvestline.operators.shaping import check_no_leakage, clean_columns, require_columns
from harvestline.operators.splitting import split, split_sizes
from harvestline.sources.stored import stored


@dataclass
class Trained:
    model: YieldModel
    metrics: DataFrame
    metadata: DataFrame
    test: DataFrame


def training_rows(
    production: DataFrame,
    snapshot: DataFrame | None,
    irrigation: DataFrame | None,
    fertilizer: DataFrame | None,
    key: str = "row_key",
    stratum: Sequence[str] = ("crop",),
) -> DataFrame:
    """Cleaned and enriched rows, stored once for all later passes, with their split label.

    The joins behind the rows run once.  Finding the split thresholds reads two stored columns, and the
    label itself is a hash comparison in each later pass.
    """
    enriched = enrich_all(check_no_leakage(clean_columns(production)), snapshot, irrigation, fertilizer)
    rows = stored(require_columns(enriched).select(key, *fv.FEATURES, fv.TARGET), "training-rows")
    return split(rows, key, stratum)


def train_job(
    spark: SparkSession,
    production: DataFrame,
    snapshot: DataFrame | None,
    irrigation: DataFrame | None,
    fertilizer: DataFrame | None,
    grid: Mapping[str, Sequence] = fv.GRID,
    folds: int = fv.FOLDS,
    key: str = "row_key",
    minimum_r2: float | None = fv.MIN_R2,
    created_at: str = "",
    parallelism: int = SEARCH_THREADS,
) -> Trained:
    rows = training_rows(production, snapshot, irrigation, fertilizer, key)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    features = fit_features(train)
    trees, scores, searched = search(features.transform(train), grid, folds, parallelism=parallelism, key=key)
    model = YieldModel(features, trees, scores, fv.TRAINED_VERSION, searched)
    scored = score(test, model).select(key, "crop", F.col(fv.TARGET).alias("y_true"), F.col("prediction").alias("y_pred"))
    scored = stored(scored, "scored-test")
    metrics = regression_metrics(scored)
    if minimum_r2 is not None:
        check_quality(metrics, minimum_r2)
    return Trained(model, metrics, training_metadata(rows, model, metrics, folds, created_at), scored)


def training_metadata(rows: DataFrame, model: YieldModel, metrics: DataFrame, folds: int, created_at: str) -> DataFrame:
    """One nested row: parameters, data sizes, test metrics and search result."""
    trees = model.trees
    best = max((s for _, s in model.cv_scores), default=None)
    sizes = split_sizes(rows).agg(
        F.max(F.when(F.col("split") == "train", F.col("n"))).alias("n_train"),
        F.max(F.when(F.col("split") == "test", F.col("n"))).alias("n_test"),
    )
    size = sizes.select(F.struct("n_train", "n_test")).scalar()
    return metrics.select(
        F.lit(model.version).alias("model_version"),
        F.lit(created_at).alias("created_at"),
        F.lit("GBTRegressor").alias("model_type"),
        F.lit(f"spark {rows.sparkSession.version}").alias("framework"),
        F.lit(fv.SEED).alias("random_seed"),
        F.struct(
            F.lit(trees.getOrDefault("stepSize")).alias("stepSize"),
            F.lit(trees.getOrDefault("maxDepth")).alias("maxDepth"),
            F.lit(trees.getNumTrees).alias("maxIter"),
            F.lit(trees.getOrDefault("subsamplingRate")).alias("subsamplingRate"),
        ).alias("hyperparameters"),
        F.struct(
            size["n_train"].alias("n_train"),
            size["n_test"].alias("n_test"),
            F.lit(model.features.width).alias("n_features"),
            F.lit(f"80/20 (seed={fv.SEED})").alias("split"),
        ).alias("training_data"),
        F.struct(
            F.struct("rmse", "mae", "r2", "mape").alias("test_metrics"),
            F.lit(folds).alias("grid_search_cv"),
            F.lit(None if best is None else round(best, 4)).cast("double").alias("grid_search_best_score"),
            F.lit(model.search_rows).cast("long").alias("grid_search_rows"),
        ).alias("evaluation"),
    )
