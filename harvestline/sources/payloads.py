"""Raw service payloads, landed as text, to long tables."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harvestline import fixed_values as fv
from harvestline.functions.numbers import nan_to_null
from harvestline.functions.text import wall_clock

DAILY_PAYLOAD = "properties struct<parameter: map<string, map<string, double>>>"
_SERIES = "struct<time: array<string>, " + ", ".join(f"{v}: array<double>" for v in fv.FORECAST_VARIABLES) + ">"
FORECAST_PAYLOAD = f"six_hourly {_SERIES}, hourly {_SERIES}"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed files with one JSON record `{state, payload}` per line."""
    return spark.read.schema("state string, payload string").json(path)


def daily_observations(payloads: DataFrame) -> DataFrame:
    """`(state, obs_date, param, val)`, one row per parameter and day of the nested maps."""
    parsed = payloads.select("state", F.from_json("payload", DAILY_PAYLOAD).alias("p"))
    by_param = parsed.select("state", F.explode("p.properties.parameter").alias("param", "days"))
    return by_param.select("state", "param", F.explode("days").alias("day", "val")).select(
        "state",
        F.to_date("day", "yyyyMMdd").alias("obs_date"),
        "param",
        nan_to_null(F.col("val")).alias("val"),
    )


def _empty_if_missing(array: Column, of: str) -> Column:
    return F.coalesce(array, F.array().cast(f"array<{of}>"))


def forecast_points(payloads: DataFrame) -> DataFrame:
    """`(state, pos, ts, variables…)` from the parallel arrays, `six_hourly` before `hourly`.

    Short or missing arrays are padded with NULL; a payload with neither series fails the job.
    """
    parsed = payloads.select("state", F.from_json("payload", FORECAST_PAYLOAD).alias("p"))
    series = F.coalesce(
        F.col("p.six_hourly"),
        F.col("p.hourly"),
        F.raise_error(F.lit("payload has neither a six_hourly nor an hourly series")).cast(_SERIES),
    )
    rows = parsed.select("state", series.alias("s"))
    zipped = F.arrays_zip(
        _empty_if_missing(F.col("s.time"), "string").alias("time"),
        *[_empty_if_missing(F.col(f"s.{v}"), "double").alias(v) for v in fv.FORECAST_VARIABLES],
    )
    # The time axis decides how many points there are.
    zipped = F.slice(zipped, F.lit(1), F.size(_empty_if_missing(F.col("s.time"), "string")))
    points = rows.select("state", F.posexplode(zipped).alias("pos", "e"))
    return points.select(
        "state",
        "pos",
        wall_clock(F.col("e.time")).alias("ts"),
        *[nan_to_null(F.col(f"e.{v}")).alias(v) for v in fv.FORECAST_VARIABLES],
    )
