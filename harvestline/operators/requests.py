"""Scoring requests: domains, limits, canonical spelling.  Row-wise, so it also runs on a stream."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from harvestline import fixed_values as fv
from harvestline.operators.insights import domains
from harvestline.sources.stored import stored


@dataclass
class Domains:
    crop: DataFrame
    season: DataFrame
    state: DataFrame


def request_domains(production: DataFrame) -> Domains:
    """Known crops, seasons and states, one stored table read three times."""
    known = stored(domains(production, fv.CATEGORICAL), "domains")

    def keyed(column: str, fold) -> DataFrame:
        own = known.where(F.col("domain") == column)
        return own.groupBy(fold("value").alias(f"_{column}_key")).agg(F.min("value").alias(f"_{column}"))

    return Domains(keyed("crop", F.upper), keyed("season", F.upper), keyed("state", F.lower))


def _unknown(kind: str) -> Column:
    return F.when(
        F.col(f"_{kind}").isNull(),
        F.concat(F.lit(f"Unknown {kind} '"), F.coalesce(F.col(kind), F.lit("")), F.lit("'.")),
    )


def _outside(column: str, limits: tuple, optional: bool) -> Column:
    value = F.col(column)
    bad = ~value.between(F.lit(limits[0]), F.lit(limits[1])) | F.isnan(value.cast("double"))
    if not optional:
        bad = value.isNull() | bad
    return F.when(bad, F.lit(f"{column} must be between {limits[0]} and {limits[1]}"))


def validate_requests(requests: DataFrame, known: Domains) -> DataFrame:
    """Requests in canonical spelling with an `errors` list; valid when the list is empty.

    Crop and season are compared in upper case, the state in lower case, and all three are rewritten to the
    known spelling, so that a request that passes is also encoded.  A missing area is one hectare.
    """
    joined = (
        requests.join(known.crop, F.upper(requests["crop"]) == F.col("_crop_key"), "left")
        .join(known.season, F.upper(requests["season"]) == F.col("_season_key"), "left")
        .join(known.state, F.lower(requests["state"]) == F.col("_state_key"), "left")
        .withColumn("area", F.coalesce(F.col("area"), F.lit(fv.DEFAULT_AREA)))
    )
    errors = F.array(
        _unknown("crop"),
        _unknown("season"),
        _unknown("state"),
        _outside("crop_year", fv.YEAR_RANGE, optional=False),
        _outside("area", fv.AREA_RANGE, optional=False),
        _outside("irrigation_pct", fv.IRRIGATION_RANGE, optional=True),
        _outside("npk_kg_per_ha", fv.FERTILIZER_RANGE, optional=True),
    )
    checked = joined.withColumn("errors", F.filter(errors, lambda e: e.isNotNull()))
    spelled = [
        F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in ("crop", "season", "state") else F.col(c)
        for c in requests.columns
    ]
    return checked.select(*spelled, "errors", (F.size("errors") == 0).alias("valid"))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where("valid").drop("errors", "valid")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where("not valid").select("request_id", F.array_join("errors", " | ").alias("errors"))
