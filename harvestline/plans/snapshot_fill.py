"""Fill the weather snapshot with the keys a production table needs and the landed payloads bring."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestline.operators.enrichment import coordinates, key_coverage, missing_keys
from harvestline.operators.weather import period_weather, snapshot_stats, weather_snapshot
from harvestline.sources.snapshots import load_snapshot, upsert_snapshot
from harvestline.sources.stored import stored


def fill_snapshot(
    spark: SparkSession, base: str, production: DataFrame, observations: DataFrame, as_of: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(snapshot, statistics, coverage)`. Only keys that are needed and absent are aggregated.

    The observations are cut to the missing (state, year) keys before the aggregate.
    """
    before = load_snapshot(spark, base)
    wanted = stored(missing_keys(production, before), "missing-keys")
    year = F.year("obs_date").cast("int")
    relevant = observations.withColumn("crop_year", year).join(wanted, ["state", "crop_year"], "left_semi")
    fresh = stored(period_weather(relevant.drop("crop_year")), "fresh-weather")
    coverage = key_coverage(production, before, fresh)
    coverage = stored(coverage, "coverage")
    after = upsert_snapshot(spark, base, weather_snapshot(fresh, None, as_of, coordinates(fresh)))
    return after, snapshot_stats(after), coverage
