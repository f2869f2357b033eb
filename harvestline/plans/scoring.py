"""Score a table or a stream of requests."""

from pyspark.sql import DataFrame, functions as F

from harvestline import fixed_values as fv
from harvestline.functions.labels import gauge, shown_yield_delta
from harvestline.functions.numbers import half_even
from harvestline.operators.enrichment import override_inputs, route_weather
from harvestline.operators.modeling import YieldModel, score
from harvestline.operators.requests import Domains, accepted, validate_requests


def build_features(valid: DataFrame, snapshot: DataFrame, forecast: DataFrame, inputs: DataFrame) -> DataFrame:
    """All eleven features of a valid request, with the origin of each part.

    `inputs` is the stored match of the known states, made in batch before a stream starts.
    """
    return route_weather(override_inputs(valid, inputs), snapshot, forecast)


def score_both(features: DataFrame, model: YieldModel) -> DataFrame:
    """Score with the routed weather and with the year's weather, row by row."""
    scored = score(features, model, "predicted")
    kept = {f"_routed_{c}": F.col(c) for c in fv.WEATHER}
    swapped = scored.withColumns(kept).withColumns({c: F.col(f"hist_{c}") for c in fv.WEATHER})
    both = score(swapped, model, "predicted_hist")
    return both.withColumns({c: F.col(f"_routed_{c}") for c in fv.WEATHER}).drop(*kept)


def score_requests(
    requests: DataFrame,
    model: YieldModel,
    known: Domains,
    snapshot: DataFrame,
    forecast: DataFrame,
    inputs: DataFrame,
) -> DataFrame:
    """One response per valid request. Predictions below 0 become 0."""
    valid = accepted(validate_requests(requests, known))
    return responses(score_both(build_features(valid, snapshot, forecast, inputs), model), model.version)


def responses(scored: DataFrame, version: str = fv.MODEL_VERSION) -> DataFrame:
    """The answer columns. Without a weather row of the request's year there is nothing to compare a forecast with."""
    final = F.greatest(F.lit(0.0), F.col("predicted"))
    past = F.when(F.col("use_forecast") & F.col("has_history"), F.greatest(F.lit(0.0), F.col("predicted_hist")))
    delta = half_even(final - past, 4)
    dial = gauge(F.col("crop"), final)
    optional = [c for c in ("forecast_confidence", "forecast_spread") if c in scored.columns]
    warning = [F.col("warning").alias("forecast_warning")] if "warning" in scored.columns else []
    return scored.select(
        "request_id",
        half_even(final, 4).alias("predicted_yield"),
        "crop", "state", "season", "crop_year", "area",
        "weather_source",
        *fv.WEATHER,
        half_even(F.col(fv.IRRIGATION), 1).alias("irrigation_pct"),
        "irrigation_source",
        half_even(F.col(fv.FERTILIZER), 1).alias("npk_consumption"),
        "npk_source",
        *optional,
        *warning,
        half_even(past, 4).alias("historical_yield"),
        delta.alias("yield_delta"),
        shown_yield_delta(delta).alias("shown_yield_delta"),
        dial["gauge_max"].alias("gauge_max"),
        dial["gauge_band"].alias("gauge_band"),
        F.lit(version).alias("model_version"),
        F.lit(fv.YIELD_UNIT).alias("unit"),
    )
