"""Table files in and out."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from harvestline import fixed_values as fv
from harvestline.operators.shaping import clean_name
from harvestline.session import path_exists
from harvestline.sources.stored import stored

PRODUCTION_SCHEMA = (
    "crop string, state string, district string, season string, crop_year int, area double, production double, "
    "yield double"
)


def _format(path: str) -> str:
    """By the ending of the innermost folder or file that has one."""
    endings = (part.rsplit(".", 1)[-1] for part in reversed(path.split("/")))
    return next((e for e in endings if e in ("csv", "parquet")), "csv")


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header, or parquet. Without a schema the CSV types are inferred (one more pass)."""
    if _format(path) == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_dimension(spark: SparkSession, path: str, value: str, name: str = "state") -> DataFrame:
    """`(name, value, ord)` from a CSV dimension in file order.

    A missing file, a missing column or a value that is not a number gives an empty dimension.
    A name that occurs twice keeps its first position and its last value.
    """
    empty = spark.createDataFrame([], f"{name} string, {value} double, ord struct<file: string, block: bigint, row: bigint>")
    if not path_exists(spark, path):
        return empty
    raw = spark.read.option("header", True).csv(path)
    if not {name, value} <= {c.strip().lower() for c in raw.columns}:
        return empty
    # Splits are dealt out by size, so rows are placed by file, start of the split and only then by the running number.
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    ord_ = F.struct(*place, F.monotonically_increasing_id().alias("row"))
    raw = raw.select("*", ord_).toDF(*[c.strip().lower() for c in raw.columns], "ord")
    rows = raw.select(
        F.trim(name).alias(name),
        F.trim(value).try_cast("double").alias(value),
        (F.col(value).isNotNull() & F.trim(value).try_cast("double").isNull()).alias("bad"),
        "ord",
    )
    found = stored(rows.groupBy(name).agg(F.max_by(value, "ord").alias(value), F.min("ord").alias("ord"), F.max("bad").alias("bad")), "dimension")
    return empty if not found.where("bad").isEmpty() else found.drop("bad")


def first_source(spark: SparkSession, paths: Iterable[str], schema: str | None = None) -> DataFrame:
    """The first path that exists."""
    tried = []
    for path in paths:
        if path_exists(spark, path):
            return read_table(spark, path, schema)
        tried.append(path)
    raise FileNotFoundError(f"none of these exists: {tried}")


def first_suitable_source(
    spark: SparkSession,
    paths: Iterable[str],
    prepare=lambda df: df,
    required: Iterable[str] = (*fv.FEATURES, fv.TARGET),
    more_than: int = 5,
) -> tuple[DataFrame, str] | None:
    """The first existing source that, once prepared, has the columns and more than a handful of rows."""
    needed = {clean_name(c) for c in required}
    for path in paths:
        if not path_exists(spark, path):
            continue
        candidate = prepare(read_table(spark, path))
        if needed <= set(candidate.columns) and candidate.limit(more_than + 1).count() > more_than:
            return candidate, path
    return None


def write_table(df: DataFrame, path: str, fmt: str = "csv", partition_by: Iterable[str] = ()) -> None:
    """Overwrite a table folder; rows carry no index column."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_splits(split: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder with `split=train` and `split=test` partitions, written in one pass."""
    write_table(split, path, fmt, ["split"])


def read_split(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    return read_table(spark, f"{path}/split={name}", schema)
