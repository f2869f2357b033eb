"""Daily observations to period weather."""

from datetime import date

from pyspark.sql import DataFrame, functions as F

from harvestline import fixed_values as fv
from harvestline.functions.numbers import half_even, nan_to_null
from harvestline.functions.text import as_date, key_state, key_year, period_start, state_year_key, year_end, year_start


def valid_observations(observations: DataFrame) -> DataFrame:
    """Readings that are neither NULL nor a fill value."""
    cleaned = observations.withColumn("val", nan_to_null(F.col("val")))
    return cleaned.where(F.col("val").isNotNull() & (F.col("val") > fv.FILL_LIMIT))


def _features() -> list:
    """Mean per parameter; precipitation is the mean day times the days of a year."""
    reading = F.when(nan_to_null(F.col("val")) > fv.FILL_LIMIT, F.col("val"))
    aggregates = []
    for param, feature in fv.DAILY_PARAMETERS.items():
        mean = F.avg(F.when(F.col("param") == param, reading))
        aggregates.append((mean * fv.DAYS_PER_YEAR if param == "PRECTOTCORR" else mean).alias(feature))
    return aggregates


def period_weather(observations: DataFrame) -> DataFrame:
    """One row per state and calendar year; a parameter with fill values only is NULL."""
    year = F.year("obs_date").cast("int")
    return observations.groupBy("state", year.alias("crop_year")).agg(*_features())


def trailing_weather(observations: DataFrame, as_of: date | str) -> DataFrame:
    """One row per state over the 365 days up to `as_of`, both ends included."""
    days = observations.where(F.col("obs_date").between(period_start(as_of), as_date(as_of)))
    return days.groupBy("state").agg(*_features())


def weather_snapshot(
    yearly: DataFrame | None, latest: DataFrame | None, as_of: date | str, coordinates: DataFrame | None = None
) -> DataFrame:
    """Snapshot rows of both kinds with their period and coordinates."""
    parts = []
    if yearly is not None:
        parts.append(
            yearly.select(
                "state",
                "crop_year",
                F.lit("YEAR").alias("mode"),
                *fv.WEATHER,
                year_start(F.col("crop_year")).alias("start"),
                year_end(F.col("crop_year")).alias("end"),
            )
        )
    if latest is not None:
        parts.append(
            latest.select(
                "state",
                F.lit(None).cast("int").alias("crop_year"),
                F.lit("LATEST").alias("mode"),
                *fv.WEATHER,
                period_start(as_of).alias("start"),
                as_date(as_of).alias("end"),
            )
        )
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if coordinates is None:
        placed = rows.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
    else:
        placed = rows.join(coordinates, "state", "left")
    return placed.select(
        "state", "crop_year", "mode", *fv.WEATHER, "lat", "lon", "start", "end",
        F.lit(str(as_of)).cast("timestamp_ntz").alias("cached_at"),
    )


def snapshot_stats(snapshot: DataFrame) -> DataFrame:
    """Entry counts, distinct states and years over both kinds of rows."""
    yearly = F.col("mode") == "YEAR"
    return snapshot.agg(
        F.count("*").alias("total_entries"),
        F.count_if(yearly).alias("year_specific"),
        F.count_if(~yearly).alias("latest"),
        F.array_join(F.sort_array(F.collect_set("state")), ",").alias("states"),
        F.array_join(F.transform(F.sort_array(F.collect_set("crop_year")), lambda y: y.cast("string")), ",").alias("years"),
    )


def snapshot_keys(snapshot: DataFrame) -> DataFrame:
    """The text key of each row and its parts read back from the text."""
    key = state_year_key(F.col("state"), F.col("crop_year"))
    return snapshot.select(
        key.alias("snapshot_key"), key_state(key).alias("key_state"), key_year(key).alias("key_year")
    )


def weather_norms(snapshot: DataFrame) -> DataFrame:
    """One row: median of the positive values of each feature, or the usual norm where there is none.

    The snapshot holds one row per (state, period), so the exact median sees a few values per state and year.
    """
    aggregates = []
    for feature in fv.WEATHER:
        value = nan_to_null(F.col(feature))
        median = half_even(F.median(F.when(value > 0, value)), 1)
        aggregates.append(F.coalesce(median, F.lit(fv.DEFAULT_NORMS[feature])).alias(feature))
    return snapshot.agg(*aggregates)
