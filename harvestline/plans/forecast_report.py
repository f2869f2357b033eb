"""Seasonal forecast next to history for asked states and seasons."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestline.functions.text import canonical_season
from harvestline.operators.forecast import forecast_delta, forecast_rejects, latest_valid, season_forecast
from harvestline.sources.snapshots import FORECAST_KEY, FORECAST_SCHEMA, load_snapshot, upsert_snapshot


def forecast_report(
    points: DataFrame, history: DataFrame, as_of: date | str, asked: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """`(report, rejects)`; without asked pairs every state and season with points is reported."""
    forecast = season_forecast(points, as_of)
    if asked is None:
        return forecast_delta(forecast, history), None
    wanted = asked.select("state", canonical_season(F.col("season")).alias("season")).distinct()
    chosen = forecast.join(wanted, ["state", "season"], "left_semi")
    return forecast_delta(chosen, history), forecast_rejects(asked, forecast)


def cached_forecast(spark: SparkSession, base: str, points: DataFrame, as_of: str, asked: DataFrame) -> DataFrame:
    """The forecasts of asked pairs: saved rows that are still valid at `as_of`, new ones for the others.

    New rows are saved to the snapshot at `base` before they are returned; only the points of states with an open pair
    are aggregated for them. A pair without points has no row, and is computed again when it is next asked for.
    """
    wanted = asked.select("state", canonical_season(F.col("season")).alias("season")).distinct()
    saved = latest_valid(load_snapshot(spark, base, FORECAST_SCHEMA), as_of, order=("cached_at",))
    missing = wanted.join(saved, ["state", "season"], "left_anti")
    fresh = season_forecast(points.join(missing.select("state").distinct(), "state", "left_semi"), as_of)
    fresh = fresh.join(missing, ["state", "season"], "left_semi").withColumns(
        {"year_month": F.lit(as_of[:7]), "cached_at": F.lit(as_of).cast("timestamp_ntz")}
    )
    after = upsert_snapshot(spark, base, fresh, FORECAST_KEY, FORECAST_SCHEMA)
    return latest_valid(after, as_of, order=("cached_at",)).join(wanted, ["state", "season"], "left_semi")
