"""The insight report set over one production table."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from harvestline import fixed_values as fv
from harvestline.operators import insights
from harvestline.operators.enrichment import enrich_all
from harvestline.sources.stored import stored


@dataclass
class InsightReport:
    by_crop: DataFrame
    top_states: DataFrame
    by_year: DataFrame
    distribution: DataFrame
    weather_scatter: dict[str, DataFrame]
    irrigation: DataFrame
    fertilizer: DataFrame
    correlation: DataFrame
    preview: DataFrame


def insight_report(
    production: DataFrame,
    snapshot: DataFrame | None,
    irrigation: DataFrame | None,
    fertilizer: DataFrame | None,
    crops=None,
    key: str = "row_key",
) -> InsightReport:
    """All reports read one stored, enriched table; `crops=None` means the first five crops."""
    enriched = enrich_all(production, snapshot, irrigation, fertilizer)
    rows = stored(insights.filter_crops(enriched, crops).select(key, *fv.FEATURES, fv.TARGET), "insight-rows")
    return InsightReport(
        insights.mean_target_ascending(rows, "crop"),
        insights.top_groups(rows, "state"),
        insights.trend(rows),
        insights.histogram(rows, fv.TARGET, by=["crop"]),
        {c: insights.scatter_summary(rows, c) for c in fv.WEATHER},
        insights.first_value(rows, "state", fv.IRRIGATION, key),
        insights.first_value(rows, "state", fv.FERTILIZER, key),
        insights.correlations(rows, [*fv.NUMERICAL, fv.TARGET]),
        insights.preview(rows, [key]),
    )
