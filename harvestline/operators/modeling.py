"""Boosted-tree regressor: search, fit, apply, inspect."""

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harvestline import fixed_values as fv
from harvestline.operators.encoding import FeatureModel
from harvestline.session import ensure_checkpoints
from harvestline.sources.stored import stored

SEARCH_ROWS = 10_000  # of `search_sample`; the search itself reads every row
SEARCH_PARTS = 4
SEARCH_THREADS = 24  # the fits of the registered grid and folds, side by side: each is a long chain of short jobs
FIT_PART_ROWS = 250_000  # rows of a fit in a partition
HELD_ROWS = 8_000_000  # rows of the fits that run side by side: with more, fewer fits run at a time


@dataclass
class YieldModel:
    features: FeatureModel
    trees: GBTRegressionModel
    cv_scores: list[tuple[dict, float]]
    version: str = fv.MODEL_VERSION  # of the model record; this one without a record
    search_rows: int = 0  # rows that the search read

    def save(self, path: str) -> None:
        PipelineModel(stages=[*self.features.pipeline.stages, self.trees]).write().overwrite().save(path)

    @staticmethod
    def load(path: str, like: FeatureModel, version: str = fv.MODEL_VERSION) -> "YieldModel":
        """Read a saved model; `like` supplies the feature names recorded in the schema document, `version` is the record's."""
        stages = PipelineModel.load(path).stages
        features = replace(like, pipeline=PipelineModel(stages=stages[:-1]))
        return YieldModel(features, stages[-1], [], version)


def _hash_part(seed: int) -> Column:
    """A number below 2^20 by the row's key, not by its values: copies of a row go to folds one by one."""
    return F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(1 << 20))


def search_sample(matrix: DataFrame, folds: int, seed: int, search_rows: int, parts: int = SEARCH_PARTS) -> DataFrame:
    """At most `search_rows` rows of `matrix`, those with the smallest hash of `_key`, with their `_fold`, in several partitions.

    For trials on a part of a table.  `search` does not use it: with no more rows than asked for, both have the same folds.
    """
    share = min(1.0, 1.1 * search_rows / max(1, matrix.count()))
    near = matrix.withColumn("_part", _hash_part(seed)).where(F.col("_part") < int(share * (1 << 20)) + 1)
    near = near.orderBy("_part", "_key").limit(search_rows)
    near = near.withColumn("_fold", F.col("_part") % folds).drop("_part")
    return stored(near.repartition(parts, "_key"), "search-sample")


def search(
    prepared: DataFrame,
    grid: Mapping[str, Sequence] = fv.GRID,
    folds: int = fv.FOLDS,
    seed: int = fv.SEED,
    parallelism: int = SEARCH_THREADS,
    label: str = fv.TARGET,
    features: str = "features",
    key: str | None = None,
) -> tuple[GBTRegressionModel, list[tuple[dict, float]], int]:
    """Grid search by cross-validated R², best combination refitted on everything; the third value is the number of rows searched.

    The encoded rows are stored first: every fold and tree then reads the same columns from the shared
    folder, and the folds come out the same after a lost executor.  The first trees of a long fit are the trees of
    a shorter one with the same seed, so each number of trees is scored on one fit.  Every row is taught in all folds but its own
    and held out in that one; the fold follows from the hash of `key`.
    A level of a tree is a job of few short tasks, so a fit has no more partitions than its rows need, and many fits run side by
    side; each holds its rows in the executors' storage, so of large tables fewer run at a time.
    """
    ensure_checkpoints(prepared.sparkSession)
    name = F.monotonically_increasing_id() if key is None else F.col(key)
    matrix = stored(prepared.select(name.alias("_key"), features, F.col(label).cast("double").alias(label)), "training-matrix")
    trees = GBTRegressor(featuresCol=features, labelCol=label, seed=seed)
    combinations = [dict(zip(grid, values)) for values in product(*grid.values())]
    if len(combinations) == 1:
        return trees.copy(_settings(trees, combinations[0])).fit(matrix), [], 0

    sample = matrix.withColumn("_fold", _hash_part(seed) % folds)
    searched = matrix.count()
    parts = max(1, -(-searched // FIT_PART_ROWS))
    together = min(parallelism, max(1, HELD_ROWS // max(1, searched)))
    longest = max(grid["maxIter"])
    shapes = list({tuple((k, v) for k, v in c.items() if k != "maxIter"): None for c in combinations})

    def scores(task: tuple[int, tuple]) -> dict[tuple, float]:
        fold, shape = task
        held = sample.where(F.col("_fold") == fold)
        taught = sample.where(F.col("_fold") != fold).coalesce(parts)
        fitted = trees.copy(_settings(trees, dict(shape) | {"maxIter": longest})).fit(taught)
        errors = fitted.evaluateEachIteration(held, "squared")
        spread = held.agg(F.var_pop(label)).first()[0]
        return {(shape, n): 1.0 - errors[n - 1] / spread for n in grid["maxIter"]}

    with ThreadPoolExecutor(together) as pool:
        found = list(pool.map(scores, [(fold, shape) for fold in range(folds) for shape in shapes]))
    mean = lambda c: sum(f.get((tuple((k, v) for k, v in c.items() if k != "maxIter"), c["maxIter"]), 0.0) for f in found) / folds
    ranked = [(c, mean(c)) for c in combinations]
    best = max(ranked, key=lambda r: r[1])[0]
    return trees.copy(_settings(trees, best)).fit(matrix), ranked, searched


def _settings(trees: GBTRegressor, values: Mapping) -> dict:
    return {trees.getParam(name): value for name, value in values.items()}


def cv_table(spark: SparkSession, scores: list[tuple[dict, float]]) -> DataFrame:
    """One row per tried combination with its mean score and rank."""
    ordered = sorted(scores, key=lambda s: -s[1])
    rows = [(i, p["maxIter"], p["stepSize"], p["maxDepth"], p["subsamplingRate"], float(s)) for i, (p, s) in enumerate(ordered, 1)]
    return spark.createDataFrame(
        rows, "rank int, maxIter int, stepSize double, maxDepth int, subsamplingRate double, mean_r2 double"
    )


def score(df: DataFrame, model: YieldModel, prediction: str = "prediction") -> DataFrame:
    """Add the raw prediction; negative values stay as they are."""
    encoded = model.features.transform(df)
    trees = model.trees.copy().setPredictionCol(prediction)
    return trees.transform(encoded).drop(model.trees.getFeaturesCol())


def importances(spark: SparkSession, model: YieldModel) -> DataFrame:
    """`(feature, importance)` for every encoded feature, 0 where no tree uses it."""
    values = model.trees.featureImportances.toArray().tolist()
    rows = [(name, float(value)) for name, value in zip(model.features.names, values)]
    return spark.createDataFrame(rows, "feature string, importance double")


def top_importances(spark: SparkSession, model: YieldModel, n: int = 10) -> DataFrame:
    return importances(spark, model).orderBy(F.desc("importance"), "feature").limit(n)


def feature_counts(df: DataFrame, model: YieldModel) -> DataFrame:
    """Encoded width, model width and documented width side by side, over the rows of `df`."""
    encoded = model.features.transform(df)
    from pyspark.ml.functions import vector_to_array

    return encoded.agg(
        F.max(F.size(vector_to_array("features"))).alias("pipeline_features"),
        F.lit(model.trees.numFeatures).alias("model_features"),
        F.lit(model.features.width).alias("schema_features"),
    ).withColumn(
        "all_match",
        (F.col("pipeline_features") == F.col("model_features")) & (F.col("model_features") == F.col("schema_features")),
    )
