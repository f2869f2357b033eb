"""Keyed weather and forecast snapshots.

A snapshot is a parquet table with one row per key.  An upsert publishes a complete new version next to the
old one, so readers never see a half-written table, a lost executor only repeats its tasks, and of two writers
the slower merges again with what the faster has published.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestline.sources.documents import latest_version
from harvestline.sources.versions import publish

WEATHER_SCHEMA = (
    "state string, crop_year int, mode string, mean_temperature double, total_precipitation double, "
    "mean_relative_humidity double, mean_solar_radiation double, lat double, lon double, start date, end date, "
    "cached_at timestamp_ntz"
)
FORECAST_SCHEMA = (
    "state string, season string, year_month string, mean_temperature double, total_precipitation double, "
    "mean_relative_humidity double, mean_solar_radiation double, forecast_spread struct<mean_temperature: double, "
    "total_precipitation: double, mean_relative_humidity: double, mean_solar_radiation: double>, "
    "forecast_confidence string, coverage_pct double, forecast_horizon_days int, data_points bigint, "
    "season_total_precipitation_mm double, warning string, cached_at timestamp_ntz"
)
WEATHER_KEY = ["state", "crop_year", "mode"]
FORECAST_KEY = ["state", "season", "year_month"]


def load_snapshot(spark: SparkSession, base: str, schema: str = WEATHER_SCHEMA) -> DataFrame:
    """Newest version, or an empty table before the first save."""
    path = latest_version(spark, base)
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def merge_snapshot(
    current: DataFrame, fresh: DataFrame, key: list[str], order: str = "cached_at", force: bool = False
) -> DataFrame:
    """One row per key: the newest of old and new, or with `force` the new row whatever its age.

    `max_by` keeps one row per key in the map-side aggregate, so a key with very many copies is cheap.
    """
    both = current.withColumn("_fresh", F.lit(0)).unionByName(
        fresh.withColumn("_fresh", F.lit(1)), allowMissingColumns=True
    )
    columns = [c for c in both.columns if c not in (*key, "_fresh")]
    age = [F.col("_fresh"), F.col(order)] if force else [F.col(order), F.col("_fresh")]
    newest = both.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*age)).alias("_row"))
    return newest.select(*key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def save_snapshot(df: DataFrame, base: str) -> str:
    return publish(df.sparkSession, base, lambda _: df)


def upsert_snapshot(
    spark: SparkSession,
    base: str,
    fresh: DataFrame,
    key: list[str] = WEATHER_KEY,
    schema: str = WEATHER_SCHEMA,
    force: bool = False,
) -> DataFrame:
    def merged(before: str | None) -> DataFrame:
        current = spark.read.schema(schema).parquet(before) if before else spark.createDataFrame([], schema)
        return merge_snapshot(current, fresh, key, force=force)

    return spark.read.schema(schema).parquet(publish(spark, base, merged))
