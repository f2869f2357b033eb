"""Six-hourly forecast points to seasonal features, comparison with history, snapshot validity."""

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from harvestline import fixed_values as fv
from harvestline.functions.labels import (
    delta_direction,
    forecast_confidence,
    forecast_warning,
    shown_delta,
)
from harvestline.functions.numbers import half_even
from harvestline.functions.text import as_date, canonical_season, seasons_of_month

_ALL_POINTS = "*"


def season_forecast(points: DataFrame, as_of: date | str, group: str = "state") -> DataFrame:
    """One row per state and season that has points.

    A point belongs to every season that contains its month, so each row is repeated at most four times
    and one pass computes all seasons.  The extra `*` group counts all points of the state for the coverage.
    """
    seasons = F.array_append(F.coalesce(seasons_of_month(F.month("ts")), F.array().cast("array<string>")), F.lit(_ALL_POINTS))
    by_season = points.withColumn("season", F.explode(seasons))
    stats = by_season.groupBy(group, "season").agg(
        F.count("*").alias("data_points"),
        F.avg("temperature_2m").alias("_temp"),
        F.coalesce(F.sum("precipitation"), F.lit(0.0)).alias("_rain"),
        F.avg("relative_humidity_2m").alias("_hum"),
        F.avg("shortwave_radiation").alias("_rad"),
        F.stddev_pop("temperature_2m").alias("_temp_sd"),
        F.stddev_pop("precipitation").alias("_rain_sd"),
        F.stddev_pop("relative_humidity_2m").alias("_hum_sd"),
        F.stddev_pop("shortwave_radiation").alias("_rad_sd"),
    )
    all_points = F.max(F.when(F.col("season") == _ALL_POINTS, F.col("data_points"))).over(Window.partitionBy(group))
    stats = stats.withColumn("_all", all_points).where(F.col("season") != _ALL_POINTS)

    stats = stats.join(_median_days_ahead(points, as_of, group), [group, "season"], "left")

    days = F.col("data_points") / fv.READINGS_PER_DAY
    coverage = F.col("data_points") / F.col("_all") * 100
    horizon = F.greatest(F.lit(0), F.coalesce(F.col("_ahead").cast("int"), F.lit(fv.FORECAST_DAYS)))
    stats = stats.withColumn("_coverage", coverage).withColumn("forecast_horizon_days", horizon)
    rain_sd = F.col("_rain_sd") * fv.DAYS_PER_YEAR / F.greatest(days, F.lit(1.0)) * 2
    return stats.select(
        group,
        "season",
        half_even(F.col("_temp"), 2).alias("mean_temperature"),
        half_even(F.col("_rain") / days * fv.DAYS_PER_YEAR, 1).alias("total_precipitation"),
        half_even(F.col("_hum"), 1).alias("mean_relative_humidity"),
        half_even(F.col("_rad") * fv.WATTS_TO_MJ_PER_DAY, 2).alias("mean_solar_radiation"),
        F.struct(
            half_even(F.col("_temp_sd"), 2).alias("mean_temperature"),
            half_even(rain_sd, 1).alias("total_precipitation"),
            half_even(F.col("_hum_sd"), 1).alias("mean_relative_humidity"),
            half_even(F.col("_rad_sd") * fv.WATTS_TO_MJ_PER_DAY, 2).alias("mean_solar_radiation"),
        ).alias("forecast_spread"),
        forecast_confidence(F.col("forecast_horizon_days")).alias("forecast_confidence"),
        half_even(F.col("_coverage"), 1).alias("coverage_pct"),
        "forecast_horizon_days",
        "data_points",
        half_even(F.col("_rain"), 1).alias("season_total_precipitation_mm"),
        forecast_warning(F.col("_coverage"), F.col("forecast_horizon_days")).alias("warning"),
    )


def _median_days_ahead(points: DataFrame, as_of: date | str, group: str) -> DataFrame:
    """Median of the whole days from `as_of` to the points of each season.

    Points are counted per day first, so the exact median sees one row per day, and the counting is a hash
    aggregate.
    """
    ahead = F.datediff(F.to_date("ts"), as_date(as_of))
    daily = points.where(F.col("ts").isNotNull()).groupBy(group, ahead.alias("_day"), F.month("ts").alias("_month"))
    days = daily.agg(F.count("*").alias("_n")).withColumn("season", F.explode(seasons_of_month(F.col("_month"))))
    return days.groupBy(group, "season").agg(F.percentile(F.col("_day"), 0.5, F.col("_n")).alias("_ahead"))


def forecast_rejects(asked: DataFrame, forecast: DataFrame) -> DataFrame:
    """Asked `(state, season)` pairs that got no forecast, with the reason."""
    wanted = asked.select("state", canonical_season(F.col("season")).alias("season")).distinct()
    missing = wanted.join(forecast, ["state", "season"], "left_anti")
    unknown = ~F.col("season").isin(*fv.SEASON_MONTHS)
    return missing.withColumn(
        "reason",
        F.when(unknown, "unknown season").otherwise("no forecast points in the season's months"),
    )


def forecast_delta(forecast: DataFrame, history: DataFrame) -> DataFrame:
    """Forecast next to the trailing-period weather of its state: difference and percentage per feature.

    A NULL value counts as 0; a state without history keeps NULL differences.
    """
    base = history.select("state", F.lit(True).alias("_has"), *[F.col(c).alias(f"hist_{c}") for c in fv.WEATHER])
    joined = forecast.join(base, "state", "left")
    has = F.col("_has").isNotNull()
    columns = []
    for c in fv.WEATHER:
        past = F.coalesce(F.col(f"hist_{c}"), F.lit(0.0))
        diff = F.coalesce(F.col(c), F.lit(0.0)) - past
        delta = F.when(has, half_even(diff, 2))
        percent = F.when(F.abs(past) > 0.01, half_even(diff / F.abs(past) * 100, 1)).otherwise(F.lit(0.0))
        columns += [
            F.when(has, F.col(f"hist_{c}")).alias(f"hist_{c}"),
            delta.alias(f"delta_{c}"),
            F.when(has, percent).alias(f"delta_pct_{c}"),
            shown_delta(c, delta).alias(f"shown_{c}"),
        ]
    return joined.select(*forecast.columns, *columns).withColumn(
        "direction", delta_direction(F.col("delta_mean_temperature"))
    )


def is_fresh(cached_at: Column, as_of: str) -> Column:
    """Younger than 30 days and from the same calendar month; a missing time is not fresh.

    Plain ranges on the stored column, so they reach the scan.
    """
    month = datetime.fromisoformat(as_of).date().replace(day=1)
    following = (month + timedelta(days=31)).replace(day=1)
    return _within_ttl(cached_at, as_of) & (cached_at >= _instant(month)) & (cached_at < _instant(following))


def _within_ttl(cached_at: Column, as_of: str) -> Column:
    return cached_at > _instant(datetime.fromisoformat(as_of) - timedelta(seconds=fv.FORECAST_TTL_SECONDS))


def _instant(moment: date | datetime) -> Column:
    return F.lit(str(moment)).cast("timestamp_ntz")


def latest_valid(snapshot: DataFrame, as_of: str, key=("state", "season"), order=("cached_at", "snap_id")) -> DataFrame:
    """Newest fresh row per key. The aggregate keeps one row per key on the map side."""
    others = [c for c in snapshot.columns if c not in key]
    fresh = snapshot.where(is_fresh(F.col("cached_at"), as_of))
    newest = fresh.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return newest.select(*key, *[F.col(f"_row.{c}").alias(c) for c in others])


def forecast_snapshot_stats(snapshot: DataFrame, as_of: str) -> DataFrame:
    valid = F.coalesce(_within_ttl(F.col("cached_at"), as_of), F.lit(False))
    return snapshot.agg(
        F.count("*").alias("total_entries"),
        F.count_if(valid).alias("valid_entries"),
        F.count_if(~valid).alias("expired_entries"),
        F.lit(fv.FORECAST_TTL_SECONDS // 86400).alias("ttl_days"),
    )
