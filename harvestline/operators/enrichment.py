"""Weather, irrigation and fertilizer columns for production rows and requests."""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harvestline import fixed_values as fv
from harvestline.functions.labels import fertilizer_band, input_source, irrigation_band
from harvestline.functions.text import period_label
from harvestline.operators.matching import tiered_match
from harvestline.sources.stored import stored


def centroid_dimension(spark: SparkSession) -> DataFrame:
    rows = [(name, lat, lon, i) for i, (name, lat, lon) in enumerate(fv.CENTROIDS)]
    return spark.createDataFrame(rows, "state string, lat double, lon double, ord bigint")


# --- dimensions ----------------------------------------------------------------------------------
def match_inputs(keys: DataFrame, irrigation: DataFrame | None, fertilizer: DataFrame | None, key: str = "state") -> DataFrame:
    """Irrigation and fertilizer values of every distinct key, matched once and stored.

    Large tables join the stored result; the match itself never sees more than the distinct keys.
    """
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct()
    matched = distinct
    for dimension, column, default in (
        (irrigation, fv.IRRIGATION, fv.DEFAULT_IRRIGATION),
        (fertilizer, fv.FERTILIZER, fv.DEFAULT_FERTILIZER),
    ):
        if dimension is None:
            matched = matched.withColumn(column, F.lit(default))
        else:
            found = tiered_match(distinct, key, dimension, [column], [default], fv.STATE_ALIASES)
            matched = matched.join(found.drop("match_tier"), key)
    return stored(matched, "inputs")


def enrich_inputs(
    df: DataFrame,
    irrigation: DataFrame | None,
    fertilizer: DataFrame | None,
    state: str = "state",
    states: DataFrame | None = None,
) -> DataFrame:
    """Add both input columns. A NULL state, an unknown state or no state column gives the defaults.

    `states` may name a table that holds every state of `df`; it saves the pass that finds them.
    """
    defaults = {fv.IRRIGATION: fv.DEFAULT_IRRIGATION, fv.FERTILIZER: fv.DEFAULT_FERTILIZER}
    wanted = [c for c in defaults if c not in df.columns]
    if state not in df.columns:
        return df.withColumns({c: F.lit(defaults[c]) for c in wanted})
    matched = match_inputs(df if states is None else states, irrigation, fertilizer, state).select(state, *wanted)
    joined = df.join(matched, state, "left")
    return joined.select(*df.columns, *[F.coalesce(c, F.lit(defaults[c])).alias(c) for c in wanted])


def enrich_dimension(df: DataFrame, dimension: DataFrame | None, column: str, default: float, state: str = "state") -> DataFrame:
    """One input column; see `enrich_inputs`."""
    if dimension is None or state not in df.columns:
        return df.withColumn(column, F.lit(default))
    matched = stored(tiered_match(df, state, dimension, [column], [default], fv.STATE_ALIASES).drop("match_tier"))
    joined = df.join(matched, state, "left")
    return joined.select(*df.columns, F.coalesce(column, F.lit(default)).alias(column))


def dimension_report(keys: DataFrame | None, dimension: DataFrame, column: str, default: float) -> DataFrame:
    """Value and band per asked state, or for the whole dimension, by state."""
    band = irrigation_band if column == fv.IRRIGATION else fertilizer_band
    if keys is None:
        rows = dimension.select("state", column)
    else:
        rows = tiered_match(keys, "state", dimension, [column], [default], fv.STATE_ALIASES).select("state", column)
    label = band(F.col(column))
    return rows.select(
        "state", column, label["category"].alias("category"), label["description"].alias("description")
    ).orderBy("state")


def coordinates(keys: DataFrame, key: str = "state", centroids: DataFrame | None = None) -> DataFrame:
    """`(key, lat, lon)` by the same tiers, without aliases; an empty name gets the fallback point."""
    centroids = centroid_dimension(keys.sparkSession) if centroids is None else centroids
    found = tiered_match(
        keys, key, centroids, ["lat", "lon"], fv.FALLBACK_CENTROID, aliases=None, empty_key="default"
    )
    return found.drop("match_tier")


# --- weather -------------------------------------------------------------------------------------
def enrich_weather(df: DataFrame, snapshot: DataFrame, state: str = "state", year: str = "crop_year") -> DataFrame:
    """Left join of the four weather columns on (state, year), or on the state's latest period when the
    table has no year column.  Row count is kept: the snapshot has one row per key."""
    if state not in df.columns:
        return df.withColumns({c: F.lit(None).cast("double") for c in fv.WEATHER})
    latest = year not in df.columns
    side = snapshot.where(F.col("mode") == ("LATEST" if latest else "YEAR")).select(
        F.col("state").alias("_wx_state"), F.col("crop_year").alias("_wx_year"), *fv.WEATHER
    )
    match = F.trim(df[state]) == side["_wx_state"]
    if not latest:
        match = match & (df[year].cast("int") == side["_wx_year"])
    return df.join(side, match, "left").select(*[df[c] for c in df.columns], *fv.WEATHER)


def incomplete_weather(df: DataFrame) -> DataFrame:
    """Rows and rows with a NULL weather feature."""
    missing = F.lit(False)
    for c in fv.WEATHER:
        missing = missing | F.col(c).isNull()
    return df.agg(F.count("*").alias("rows"), F.count_if(missing).alias("rows_without_weather"))


def needed_keys(df: DataFrame, state: str = "state", year: str = "crop_year") -> DataFrame:
    """Distinct (state, year) combinations."""
    return df.select(F.trim(state).alias("state"), F.col(year).cast("int").alias("crop_year")).distinct()


def missing_keys(df: DataFrame, snapshot: DataFrame, state: str = "state", year: str = "crop_year") -> DataFrame:
    have = snapshot.where(F.col("mode") == "YEAR")
    return needed_keys(df, state, year).join(have, ["state", "crop_year"], "left_anti")


def used_snapshot(df: DataFrame, snapshot: DataFrame, state: str = "state", year: str = "crop_year") -> DataFrame:
    """Snapshot rows that the table needs."""
    return snapshot.where(F.col("mode") == "YEAR").join(
        needed_keys(df, state, year), ["state", "crop_year"], "left_semi"
    )


def key_coverage(
    df: DataFrame, snapshot: DataFrame, arrived: DataFrame | None = None, state: str = "state", year: str = "crop_year"
) -> DataFrame:
    """Needed, already present and missing keys; with `arrived`, how many of the missing ones came or failed."""
    have = snapshot.where(F.col("mode") == "YEAR").select("state", "crop_year", F.lit(True).alias("_have"))
    keys = needed_keys(df, state, year).join(have, ["state", "crop_year"], "left")
    present = F.col("_have").isNotNull()
    counts = [F.count("*").alias("needed"), F.count_if(present).alias("present"), F.count_if(~present).alias("missing")]
    if arrived is not None:
        came = arrived.select("state", "crop_year", F.lit(True).alias("_came")).distinct()
        keys = keys.join(came, ["state", "crop_year"], "left")
        counts += [
            F.count_if(~present & F.col("_came").isNotNull()).alias("fetched"),
            F.count_if(~present & F.col("_came").isNull()).alias("failed"),
        ]
    return keys.agg(*counts)


def weather_report(keys: DataFrame, snapshot: DataFrame, as_of: date | str | None = None) -> DataFrame:
    """Weather of the asked `(state, crop_year)` keys, NULL year meaning the trailing period, with
    coordinates and a period label."""
    label = F.concat(F.lit("Year "), F.col("crop_year").cast("string"))
    latest = period_label(as_of) if as_of is not None else F.lit(None).cast("string")
    places = coordinates(keys)
    wanted = keys.join(snapshot.select("state", "crop_year", *fv.WEATHER), _same_key(keys, snapshot), "left").select(
        keys["state"], keys["crop_year"], *fv.WEATHER
    )
    return wanted.join(places, "state", "left").select(
        "state",
        "crop_year",
        F.coalesce("lat", F.lit(fv.FALLBACK_CENTROID[0])).alias("latitude"),
        F.coalesce("lon", F.lit(fv.FALLBACK_CENTROID[1])).alias("longitude"),
        F.coalesce(label, latest).alias("period"),
        *fv.WEATHER,
    )


def _same_key(left: DataFrame, right: DataFrame) -> Column:
    return (left["state"] == right["state"]) & left["crop_year"].eqNullSafe(right["crop_year"])


# --- all together --------------------------------------------------------------------------------
def enrich_all(
    df: DataFrame,
    snapshot: DataFrame | None = None,
    irrigation: DataFrame | None = None,
    fertilizer: DataFrame | None = None,
    state: str = "state",
    states: DataFrame | None = None,
) -> DataFrame:
    """Add whichever of the six columns are absent. A missing snapshot gives NULL weather."""
    if any(c not in df.columns for c in fv.WEATHER):
        bare = df.drop(*fv.WEATHER)
        if snapshot is None:
            df = bare.withColumns({c: F.lit(None).cast("double") for c in fv.WEATHER})
        else:
            df = enrich_weather(bare, snapshot, state)
    if fv.IRRIGATION not in df.columns or fv.FERTILIZER not in df.columns:
        df = enrich_inputs(df, irrigation, fertilizer, state, states)
    return df


def override_inputs(requests: DataFrame, inputs: DataFrame) -> DataFrame:
    """The user's value where given, else the state's, with the source of each."""
    joined = requests.join(inputs, "state", "left")
    return joined.select(
        *requests.columns,
        F.coalesce("irrigation_pct", fv.IRRIGATION, F.lit(fv.DEFAULT_IRRIGATION)).alias(fv.IRRIGATION),
        input_source(F.col("irrigation_pct")).alias("irrigation_source"),
        F.coalesce("npk_kg_per_ha", fv.FERTILIZER, F.lit(fv.DEFAULT_FERTILIZER)).alias(fv.FERTILIZER),
        input_source(F.col("npk_kg_per_ha")).alias("npk_source"),
    )


_FORECAST_FACTS = ["forecast_confidence", "forecast_spread", "warning"]


def route_weather(requests: DataFrame, snapshot: DataFrame, forecast: DataFrame) -> DataFrame:
    """Forecast weather where the request asks for it, else the request year's weather.

    Both stay available: `hist_…` columns carry the year's weather for the comparison score.
    """
    hist = snapshot.where(F.col("mode") == "YEAR").select(
        "state", "crop_year", F.lit(True).alias("_has_history"), *[F.col(c).alias(f"hist_{c}") for c in fv.WEATHER]
    )
    ahead = forecast.select(
        "state",
        "season",
        F.lit(True).alias("_has_forecast"),
        *[F.col(c).alias(f"fc_{c}") for c in fv.WEATHER],
        *_present(forecast, _FORECAST_FACTS),
    )
    joined = requests.join(hist, ["state", "crop_year"], "left").join(ahead, ["state", "season"], "left")
    use = F.col("use_forecast")
    extra = [F.when(use, F.col(c)).alias(c) for c in _present(forecast, _FORECAST_FACTS)]
    return joined.select(
        *requests.columns,
        *[F.when(use, F.col(f"fc_{c}")).otherwise(F.col(f"hist_{c}")).alias(c) for c in fv.WEATHER],
        *[f"hist_{c}" for c in fv.WEATHER],
        # A weather row of the year exists, whatever values it has.
        F.col("_has_history").isNotNull().alias("has_history"),
        # The label says "forecast" only when the forecast lookup succeeded.
        F.when(use & F.col("_has_forecast").isNotNull(), "forecast").otherwise("historical").alias("weather_source"),
        *extra,
    )


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]
