"""Imputation, one-hot encoding and scaling.

Fitting is a handful of aggregates; the fitted result is a `PipelineModel` of built-in stages, so it is
saved, loaded and applied like any other and stays on the JVM.
"""

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from harvestline import fixed_values as fv
from harvestline.operators.insights import per_column, unpivoted
from harvestline.operators.quantiles import exact_quantiles
from harvestline.sources.stored import stored


# --- statistics ----------------------------------------------------------------------------------
def medians(df: DataFrame, columns: Sequence[str] = tuple(fv.NUMERICAL)) -> DataFrame:
    """`(feature, median)` over the non-NULL values."""
    return exact_quantiles(unpivoted(df, columns), "value", {"median": 0.5}, ["feature"]).select("feature", "median")


def category_counts(df: DataFrame, columns: Sequence[str] = tuple(fv.CATEGORICAL)) -> DataFrame:
    """`(feature, value, _n)`. Counting goes through the combinations, which the map side reduces."""
    columns = list(columns)
    combos = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    values = combos.unpivot(["_n"], columns, "feature", "value").where(F.col("value").isNotNull())
    return values.groupBy("feature", "value").agg(F.sum("_n").alias("_n"))


def modes(counts: DataFrame) -> DataFrame:
    """`(feature, mode)` of `category_counts`: the most frequent value, the smallest on a tie."""
    return counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("_n"), "value")).alias("mode"))


def categories(counts: DataFrame) -> DataFrame:
    """`(feature, value, slot)` of `category_counts` in sort order, slots counted from 0."""
    labels = counts.groupBy("feature").agg(F.sort_array(F.collect_set("value")).alias("v"))
    return labels.select("feature", F.posexplode("v").alias("slot", "value"))


def imputed(df: DataFrame, median_of: dict, mode_of: dict) -> DataFrame:
    return df.withColumns(
        {
            **{c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in median_of.items()},
            **{c: F.coalesce(F.col(c), F.lit(m)) for c, m in mode_of.items()},
        }
    )


def scales(df: DataFrame, columns: Sequence[str] = tuple(fv.NUMERICAL)) -> DataFrame:
    """`(feature, mean, scale)`: population deviation, 1 where a column does not vary."""
    spread = per_column(df, list(columns), mean=F.avg, sd=F.stddev_pop)
    scale = F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    return spread.select("feature", "mean", scale.alias("scale"))


# --- fitted pipeline -----------------------------------------------------------------------------
@dataclass
class FeatureModel:
    pipeline: PipelineModel
    categorical: list[str]
    numerical: list[str]
    labels: dict[str, list[str]]
    drop_first: bool
    names: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.names)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df)


def _rows(df: DataFrame, key: str, *values: str) -> dict:
    """A per-feature statistic as a dict; the table has one row per feature."""
    return {r[key]: (r[values[0]] if len(values) == 1 else tuple(r[v] for v in values)) for r in df.collect()}


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_features(
    train: DataFrame,
    categorical: Sequence[str] = tuple(fv.CATEGORICAL),
    numerical: Sequence[str] = tuple(fv.NUMERICAL),
    drop_first: bool = True,
    impute: bool = True,
    output: str = "features",
) -> FeatureModel:
    """Categories first, then numbers. An unseen category encodes as zeros."""
    categorical, numerical = list(categorical), list(numerical)
    median_of = _rows(medians(train, numerical), "feature", "median") if impute else {}
    counts = stored(category_counts(train, categorical), "category-counts")
    mode_of = _rows(modes(counts), "feature", "mode") if impute else {}
    # A column without any value would have no median; it becomes constant.
    median_of = {c: median_of.get(c, 0.0) for c in numerical} if impute else {}
    # Filling in the most frequent value adds no category.
    scale_of = _rows(scales(imputed(train, median_of, {}), numerical), "feature", "mean", "scale")
    labels = {c: [] for c in categorical}
    for row in categories(counts).orderBy("feature", "slot").collect():
        labels[row["feature"]].append(row["value"])
    return assemble_features(train.sparkSession, categorical, numerical, labels, median_of, mode_of, scale_of, drop_first, output)


def assemble_features(
    spark: SparkSession,
    categorical: list[str],
    numerical: list[str],
    labels: dict[str, list[str]],
    median_of: dict[str, float],
    mode_of: dict[str, str],
    scale_of: dict[str, tuple[float, float]],
    drop_first: bool,
    output: str,
) -> FeatureModel:
    numbers = []
    for c in numerical:
        value = f"cast(`{c}` as double)"
        if c in median_of:
            value = f"coalesce({value}, {_number(median_of[c])})"
        mean, scale = scale_of[c]
        numbers.append(f"({value} - {_number(mean)}) / {_number(scale)} AS `num__{c}_{output}`")
    texts = [
        f"{f'coalesce(`{c}`, {_text(mode_of[c])})' if c in mode_of else f'`{c}`'} AS `cat__{c}_{output}`"
        for c in categorical
    ]
    clean = SQLTransformer(statement=f"SELECT *, {', '.join(texts + numbers)} FROM __THIS__")

    indexed = [f"idx__{c}_{output}" for c in categorical]
    indexers = [
        StringIndexerModel.from_labels(labels[c], f"cat__{c}_{output}", index, handleInvalid="keep")
        for c, index in zip(categorical, indexed)
    ]
    coded = [f"hot__{c}_{output}" for c in categorical]
    # The encoder only reads the label metadata, so it is fitted on an empty table.
    empty = spark.createDataFrame([], T.StructType([T.StructField(f"cat__{c}_{output}", T.StringType()) for c in categorical]))
    encoder = OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True).fit(PipelineModel(indexers).transform(empty))

    stages, parts, names, sources = [clean, *indexers, encoder], [], [], []
    for c, column in zip(categorical, coded):
        kept = labels[c][1:] if drop_first else labels[c]
        if not kept:
            continue
        if drop_first:
            part = f"cut__{c}_{output}"
            stages.append(VectorSlicer(inputCol=column, outputCol=part, indices=list(range(1, len(labels[c])))))
        else:
            part = column
        parts.append(part)
        names += [f"cat__{c}_{v}" for v in kept]
        sources += [c] * len(kept)
    names += [f"num__{c}" for c in numerical]
    sources += numerical
    stages.append(VectorAssembler(inputCols=parts + [f"num__{c}_{output}" for c in numerical], outputCol=output))
    helpers = [t.split(" AS ")[1] for t in texts + numbers] + [f"`{c}`" for c in (*indexed, *coded)]
    helpers += [f"`{p}`" for p in parts if p.startswith("cut__")]
    stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(helpers)}) FROM __THIS__"))
    return FeatureModel(PipelineModel(stages=stages), categorical, numerical, labels, drop_first, names, sources)


def feature_names(df: DataFrame, model: FeatureModel) -> DataFrame:
    """`(position, name, feature)` of the encoded vector."""
    rows = [(i, n, s) for i, (n, s) in enumerate(zip(model.names, model.sources))]
    return df.sparkSession.createDataFrame(rows, "position int, name string, feature string")
