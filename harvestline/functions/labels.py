"""Bands, labels and short report texts as column expressions."""

from pyspark.sql import Column, functions as F

from harvestline import fixed_values as fv
from harvestline.functions.numbers import compact_text, fixed_text
from harvestline.functions.text import lookup

_BAND_ICONS = {  # fixed values
    "Very High": "\U0001f7e2",
    "High": "\U0001f7e2",
    "Moderate": "\U0001f7e0",
    "Low": "\U0001f534",
    "Very Low": "\U0001f534",
}


def _band(value: Column, bands: list) -> Column:
    chain = None
    for bound, category, description in reversed(bands):
        label = F.struct(
            F.lit(category).alias("category"),
            F.lit(description).alias("description"),
            F.lit(_BAND_ICONS[category]).alias("icon"),
        )
        chain = label if bound is None else F.when(value >= bound, label).otherwise(chain)
    return F.when(value.isNotNull(), chain)


def irrigation_band(pct: Column) -> Column:
    return _band(pct, fv.IRRIGATION_BANDS)


def fertilizer_band(kg_per_ha: Column) -> Column:
    return _band(kg_per_ha, fv.FERTILIZER_BANDS)


def forecast_confidence(horizon_days: Column) -> Column:
    return (
        F.when(horizon_days <= fv.HORIZON_HIGH_DAYS, "high")
        .when(horizon_days <= fv.HORIZON_MEDIUM_DAYS, "medium")
        .otherwise("low")
    )


def confidence_icon(confidence: Column) -> Column:
    icons = {"high": "\U0001f7e2", "medium": "\U0001f7e0", "low": "\U0001f534"}  # fixed values
    return F.coalesce(lookup(icons, confidence), F.lit(""))


def forecast_warning(coverage_pct: Column, horizon_days: Column) -> Column:
    days = horizon_days.cast("string")
    return (
        F.when(
            coverage_pct < fv.LOW_COVERAGE_PCT,
            F.concat(
                F.lit("Low forecast coverage ("),
                fixed_text(coverage_pct, 0),
                F.lit(f"%). Season extends beyond the {fv.FORECAST_DAYS}-day forecast horizon."),
            ),
        )
        .when(
            horizon_days > fv.HORIZON_MEDIUM_DAYS,
            F.concat(
                F.lit("Forecast horizon is "),
                days,
                F.lit(
                    f" days — accuracy drops significantly beyond {fv.HORIZON_MEDIUM_DAYS} days."
                ),
            ),
        )
        .when(
            horizon_days > fv.HORIZON_HIGH_DAYS,
            F.concat(
                F.lit("Forecast horizon is "),
                days,
                F.lit(" days — treat as indicative trend, not precise prediction."),
            ),
        )
    )


def delta_direction(delta: Column) -> Column:
    return (
        F.when(delta > fv.DIRECTION_CUTOFF, "up").when(delta < -fv.DIRECTION_CUTOFF, "down").otherwise("flat")
    )


def shown_delta(feature: str, delta: Column) -> Column:
    """The difference where it is large enough to report, else NULL."""
    return F.when(F.abs(delta) > fv.DELTA_CUTOFFS[feature], delta)


def shown_yield_delta(delta: Column) -> Column:
    return F.when(F.abs(delta) > fv.YIELD_DELTA_CUTOFF, delta)


def contribution_direction(value: Column) -> Column:
    return F.when(value > 0, "Increases").otherwise("Decreases")


def gauge(crop: Column, prediction: Column) -> Column:
    """Scale end and the third of the scale the prediction falls in."""
    usual = F.coalesce(lookup(fv.GAUGE_MAX, F.upper(crop)), F.lit(fv.GAUGE_DEFAULT))
    top = F.when(prediction > usual, F.ceil(prediction * 1.3 / 10).cast("double") * 10).otherwise(usual)
    band = F.when(prediction < top * 0.33, "low").when(prediction < top * 0.66, "middle").otherwise("high")
    return F.struct(top.alias("gauge_max"), band.alias("gauge_band"))


def input_source(user_value: Column) -> Column:
    return F.when(user_value.isNotNull(), "user").otherwise("state-avg")


def source_badge(source: Column) -> Column:
    """Provenance text of the input summary."""
    badges = {  # fixed values
        "user": "\U0001f468\u200d\U0001f33e Your input",
        "state-avg": "\U0001f3db\ufe0f State default",
        "forecast": "\U0001f52e Forecast",
        "historical": "\U0001f570\ufe0f Historical",
    }
    return F.coalesce(lookup(badges, source), F.lit("—"))


def summary_value(x: Column) -> Column:
    return compact_text(x)
