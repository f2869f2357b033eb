"""Risk for every state: weather, norms, rules, tables."""

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame

from harvestline import fixed_values as fv
from harvestline.operators.risk import assess, by_severity, compact_table, level_counts, risk_table
from harvestline.operators.weather import period_weather, trailing_weather, weather_norms
from harvestline.sources.stored import stored


@dataclass
class RiskReport:
    assessments: DataFrame
    table: DataFrame
    compact: DataFrame
    counts: DataFrame


def risk_report(weather: DataFrame, norms: DataFrame | None = None, rules=None) -> RiskReport:
    """Reports over weather rows that may be one per state or one per state and period."""
    assessments = assess(weather, norms, rules)
    ordered = by_severity(assessments)
    return RiskReport(ordered, risk_table(ordered), compact_table(ordered), level_counts(assessments))


def yearly_risk(observations: DataFrame) -> RiskReport:
    """Observations to risk per state and year.

    The only shuffle of the observations is the year aggregate; norms and rules work on its small result.
    """
    weather = stored(period_weather(observations), "year-weather")
    return risk_report(weather, weather_norms(weather))


def current_risk(observations: DataFrame, as_of: date, norms: DataFrame | None = None) -> RiskReport:
    """Risk per state over the trailing period."""
    weather = stored(trailing_weather(observations, as_of), "trailing-weather")
    return risk_report(weather, weather_norms(weather) if norms is None else norms)


def trailing_start(as_of: date) -> date:
    return as_of - timedelta(days=fv.TRAILING_DAYS)
