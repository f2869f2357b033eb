
from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import date
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

import oracles
from harvestline import fixed_values as fv
from harvestline.functions.labels import fertilizer_band, gauge, irrigation_band
from harvestline.functions.numbers import half_even
from harvestline.functions.text import forecast_key, season_months
from harvestline.operators import (
    contributions as ctr,
    encoding,
    enrichment as en,
    forecast as fc,
    insights as ins,
    metrics as mt,
    modeling as md,
    requests as rq,
    risk,
    shaping,
    splitting,
    trees,
    weather as wx,
)
from harvestline.plans import answer_checks as checks, evaluation, forecast_report, insight_report, risk_report, schema_document, scoring, snapshot_fill, training
from harvestline.session import scratch_path
from harvestline.sources import documents, files, payloads, snapshots, tables as t, versions
from harvestline.sources.stored import stored
from harvestline.streaming import jobs

AS_OF = date.fromisoformat(oracles.AS_OF)
FORECAST_AS_OF = oracles.FORECAST_AS_OF
SNAPSHOT_AS_OF = oracles.SNAPSHOT_AS_OF

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_shared: dict[tuple, object] = {}


def query(function: Query) -> Query:
    _queries[function.__name__] = function
    return function


def shared(function):
    """Compute once per application and folder: the stored tables that several queries start from."""

    def cached(spark: SparkSession, folder: str):
        key = (function.__name__, spark.sparkContext.applicationId, folder)
        if key not in _shared:
            _shared[key] = function(spark, folder)
        return _shared[key]

    return cached


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Aggregates add doubles in any order; the last digits are cut before a comparison."""
    return df.withColumns({c: half_even(F.col(c), digits) for c in columns})


def states(spark, folder):
    return t.table(spark, folder, "nation").select(F.col("n_name").alias("state"))


# --- shared tables -------------------------------------------------------------------------------
@shared
def yearly(spark, folder):
    return stored(wx.period_weather(t.observations(spark, folder)), "yearly")


@shared
def trailing(spark, folder):
    observations = t.observations(spark, folder, risk_report.trailing_start(AS_OF), AS_OF)
    return stored(wx.trailing_weather(observations, AS_OF), "trailing")


@shared
def partial(spark, folder):
    """Year weather with some (state, year) keys left out, for the queries that look for missing keys and values."""
    nation = t.table(spark, folder, "nation")
    rows = yearly(spark, folder)
    kept = rows.join(nation, rows.state == nation.n_name).where("(n_nationkey + crop_year) % 10 <> 0")
    return stored(kept.select(*rows.columns), "partial")


@shared
def snapshot(spark, folder):
    return stored(wx.weather_snapshot(yearly(spark, folder), trailing(spark, folder), AS_OF), "snapshot")


@shared
def snapshot_with_gaps(spark, folder):
    return stored(wx.weather_snapshot(partial(spark, folder), trailing(spark, folder), AS_OF), "snapshot-with-gaps")


@shared
def known(spark, folder):
    return rq.request_domains(t.production(spark, folder))


@shared
def inputs(spark, folder):
    states = known(spark, folder).state.select(F.col("_state").alias("state"))
    return en.match_inputs(states, t.irrigation(spark, folder), t.fertilizer(spark, folder))


@shared
def forecast(spark, folder):
    return stored(fc.season_forecast(t.forecast_series(spark, folder), FORECAST_AS_OF), "forecast")


def _enriched(spark, folder, weather):
    return en.enrich_all(
        t.production(spark, folder),
        weather,
        t.irrigation(spark, folder),
        t.fertilizer(spark, folder),
        states=states(spark, folder),
    )


@shared
def enriched(spark, folder):
    """Production rows with all features: a lazy plan whose small sides are stored."""
    return _enriched(spark, folder, snapshot(spark, folder))


@shared
def enriched_with_gaps(spark, folder):
    return _enriched(spark, folder, snapshot_with_gaps(spark, folder))


@shared
def labelled(spark, folder):
    return splitting.split(stored(enriched(spark, folder), "rows"), "row_key", ["crop"])


@shared
def scored(spark, folder):
    """Test rows with the mean of their crop in the train rows as prediction."""
    rows = labelled(spark, folder)
    means = rows.where("split = 'train'").groupBy("crop").agg(half_even(F.avg(fv.TARGET), 6).alias("y_pred"))
    test = rows.where("split = 'test'").select("row_key", "crop", F.col(fv.TARGET).alias("y_true"))
    return stored(test.join(stored(means, "crop-means"), "crop"), "scored")


@shared
def filled(spark, folder):
    rows = labelled(spark, folder).where("split = 'train'")
    medians = {r["feature"]: r["median"] for r in encoding.medians(rows).collect()}
    return stored(encoding.imputed(rows, medians, {}), "filled")


@shared
def trained(spark, folder):
    return training.train_job(
        spark,
        t.production(spark, folder),
        snapshot(spark, folder),
        t.irrigation(spark, folder),
        t.fertilizer(spark, folder),
        created_at=oracles.AS_OF,
    )


@shared
def valid_features(spark, folder):
    valid = rq.accepted(rq.validate_requests(t.requests(spark, folder), known(spark, folder)))
    rows = scoring.build_features(valid, snapshot(spark, folder), forecast(spark, folder), inputs(spark, folder))
    return stored(rows, "request-features")


# --- weather and risk ----------------------------------------------------------------------------
@query
def period_weather(spark, folder):
    return rounded(wx.period_weather(t.observations(spark, folder)), 6, *fv.WEATHER)


@query
def trailing_weather(spark, folder):
    return rounded(
        wx.trailing_weather(t.observations(spark, folder, risk_report.trailing_start(AS_OF), AS_OF), AS_OF), 6, *fv.WEATHER
    )


@query
def valid_observations(spark, folder):
    rows = wx.valid_observations(t.observations(spark, folder)).groupBy("state", "param")
    return rounded(
        rows.agg(
            F.count("*").alias("n"),
            F.sum("val").alias("total"),
            F.min("obs_date").alias("first_day"),
            F.max("obs_date").alias("last_day"),
        ),
        4,
        "total",
    )


@query
def weather_norms(spark, folder):
    return wx.weather_norms(yearly(spark, folder))


@query
def snapshot_norms(spark, folder):
    """Norms over the year rows and the latest rows of the snapshot together."""
    return wx.weather_norms(snapshot(spark, folder))


@query
def risk_fired_rules(spark, folder):
    weather = yearly(spark, folder)
    return rounded(risk.fired_rules(weather, wx.weather_norms(weather)), 6, "current_value")


@query
def risk_rules_from_table(spark, folder):
    fired = risk.fired_by_table(yearly(spark, folder), risk.rule_table(spark))
    return rounded(fired.select("state", "crop_year", "rule_ord", "metric", "value", "level", "category"), 6, "value")


def _report(spark, folder):
    weather = yearly(spark, folder)
    return risk_report.risk_report(weather, wx.weather_norms(weather))


@query
def risk_best_alert(spark, folder):
    return risk.best_alerts(_report(spark, folder).assessments).select(
        "state", "crop_year", "alert_pos", "rule_ord", "level", "category", "title", "message", "deviation_pct"
    )


@query
def risk_assessments(spark, folder):
    rows = _report(spark, folder).assessments.withColumn("n_alerts", F.size("alerts")).drop("alerts")
    return rounded(rows, 6, *fv.WEATHER)


@query
def risk_table(spark, folder):
    return _report(spark, folder).table


@query
def risk_compact_table(spark, folder):
    return _report(spark, folder).compact


@query
def risk_level_counts(spark, folder):
    return _report(spark, folder).counts


@query
def current_risk(spark, folder):
    """Risk table of every state over the trailing period, against the norms of the whole snapshot."""
    observations = t.observations(spark, folder, risk_report.trailing_start(AS_OF), AS_OF)
    return risk_report.current_risk(observations, AS_OF, wx.weather_norms(yearly(spark, folder))).table


@query
def risk_responses(spark, folder):
    """Assessments over the trailing period as JSON records."""
    weather = trailing(spark, folder)
    return risk.response_records(risk.assess(weather, wx.weather_norms(snapshot(spark, folder))))


# --- joins and lookups ---------------------------------------------------------------------------
@query
def year_weather_join(spark, folder):
    joined = en.enrich_weather(t.production(spark, folder), snapshot(spark, folder))
    return rounded(joined.select("row_key", "state", "crop_year", *fv.WEATHER), 6, *fv.WEATHER)


@query
def incomplete_weather(spark, folder):
    counts = en.incomplete_weather(en.enrich_weather(t.production(spark, folder), snapshot_with_gaps(spark, folder)))
    return counts.withColumnRenamed("rows", "n_rows")


@query
def trailing_weather_join(spark, folder):
    rows = t.production(spark, folder).drop("crop_year")
    joined = en.enrich_weather(rows, snapshot(spark, folder))
    return rounded(joined.select("row_key", "state", *fv.WEATHER), 6, *fv.WEATHER)


@query
def tiered_match(spark, folder):
    keys = t.lookup_keys(spark, folder)
    matched = stored(
        en.tiered_match(
            keys, "state_key", t.irrigation(spark, folder), [fv.IRRIGATION], [fv.DEFAULT_IRRIGATION], fv.STATE_ALIASES
        )
    )
    return keys.join(matched, "state_key", "left").select(
        "key_id", "state_key", F.coalesce(fv.IRRIGATION, F.lit(fv.DEFAULT_IRRIGATION)).alias(fv.IRRIGATION), "match_tier"
    )


@query
def centroid_lookup(spark, folder):
    keys = t.lookup_keys(spark, folder)
    joined = keys.join(stored(en.coordinates(keys, "state_key")), "state_key", "left")
    lat, lon = fv.FALLBACK_CENTROID
    return joined.select("key_id", F.coalesce("lat", F.lit(lat)).alias("lat"), F.coalesce("lon", F.lit(lon)).alias("lon"))


@query
def input_enrichment(spark, folder):
    dimensions = t.irrigation(spark, folder), t.fertilizer(spark, folder)
    rows = en.enrich_inputs(t.production(spark, folder), *dimensions, states=states(spark, folder))
    return rows.select("row_key", "state", fv.IRRIGATION, fv.FERTILIZER)


@query
def irrigation_report(spark, folder):
    states = t.production(spark, folder).select("state")
    return en.dimension_report(states, t.irrigation(spark, folder), fv.IRRIGATION, fv.DEFAULT_IRRIGATION)


@query
def whole_irrigation_report(spark, folder):
    """All states, those included that are left out of `irrigation_report` to match by substring."""
    return en.dimension_report(None, t.irrigation(spark, folder, whole=True), fv.IRRIGATION, fv.DEFAULT_IRRIGATION)


@query
def whole_fertilizer_report(spark, folder):
    return en.dimension_report(None, t.fertilizer(spark, folder, whole=True), fv.FERTILIZER, fv.DEFAULT_FERTILIZER)


@query
def whole_input_enrichment(spark, folder):
    """Production rows with the irrigation and fertilizer values of all states."""
    rows = t.production(spark, folder).select("row_key", "state")
    whole = en.enrich_inputs(rows, t.irrigation(spark, folder, whole=True), t.fertilizer(spark, folder, whole=True))
    return whole.select("row_key", "state", fv.IRRIGATION, fv.FERTILIZER)


@query
def absent_dimensions(spark, folder):
    """Without snapshot and dimensions: weather NULL, inputs at their defaults."""
    rows = en.enrich_all(t.production(spark, folder), None, None, None)
    missing = [F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in fv.WEATHER]
    return rows.groupBy("state").agg(F.count("*").alias("n"), *missing, F.min(fv.IRRIGATION).alias("irrigation"), F.max(fv.FERTILIZER).alias("npk"))


@query
def fertilizer_report(spark, folder):
    return en.dimension_report(None, t.fertilizer(spark, folder), fv.FERTILIZER, fv.DEFAULT_FERTILIZER)


@query
def input_bands(spark, folder):
    return (
        enriched(spark, folder)
        .groupBy("state")
        .agg(
            F.count("*").alias("n"),
            F.max(irrigation_band(F.col(fv.IRRIGATION))["category"]).alias("irrigation_band"),
            F.max(fertilizer_band(F.col(fv.FERTILIZER))["category"]).alias("fertilizer_band"),
        )
    )


@query
def needed_keys(spark, folder):
    return en.needed_keys(t.production(spark, folder)).orderBy("state", "crop_year")


@query
def missing_keys(spark, folder):
    return en.missing_keys(t.production(spark, folder), snapshot_with_gaps(spark, folder))


@query
def used_snapshot(spark, folder):
    rows = en.used_snapshot(t.production(spark, folder), snapshot_with_gaps(spark, folder))
    return rounded(rows.select("state", "crop_year", *fv.WEATHER), 6, *fv.WEATHER)


@query
def key_coverage(spark, folder):
    return en.key_coverage(t.production(spark, folder), snapshot_with_gaps(spark, folder))


@query
def weather_report(spark, folder):
    keys = en.needed_keys(t.production(spark, folder))
    return rounded(en.weather_report(keys, snapshot(spark, folder), AS_OF), 6, *fv.WEATHER)


@query
def snapshot_stats(spark, folder):
    return wx.snapshot_stats(snapshot(spark, folder))


@query
def snapshot_keys(spark, folder):
    return wx.snapshot_keys(snapshot(spark, folder))


@shared
def _fill(spark, folder):
    base = scratch_path(spark, "weather-snapshot")
    snapshots.save_snapshot(wx.weather_snapshot(partial(spark, folder), None, "2000-01-01"), base)
    return snapshot_fill.fill_snapshot(spark, base, t.production(spark, folder), t.observations(spark, folder), oracles.AS_OF)


@query
def snapshot_fill_job(spark, folder):
    after, _, _ = _fill(spark, folder)
    return rounded(after.select("state", "crop_year", *fv.WEATHER), 6, *fv.WEATHER)


@query
def snapshot_fill_coverage(spark, folder):
    return _fill(spark, folder)[2]


# --- payloads ------------------------------------------------------------------------------------
def _land(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.json(path)
    return payloads.read_payloads(df.sparkSession, path)


@query
def daily_payloads(spark, folder):
    """Observations written as service payloads, one per state and month, and read back."""
    daily = t.observations(spark, folder).groupBy("state", "obs_date", "param").agg(half_even(F.avg("val"), 6).alias("val"))
    # At most 31 days and four parameters per document.
    month = F.date_format("obs_date", "yyyyMM").alias("month")
    day = F.struct(F.date_format("obs_date", "yyyyMMdd").alias("d"), "val")
    by_param = daily.groupBy("state", month, "param").agg(F.map_from_entries(F.collect_list(day)).alias("days"))
    by_month = by_param.groupBy("state", "month").agg(
        F.map_from_entries(F.collect_list(F.struct("param", "days"))).alias("parameter")
    )
    text = F.to_json(F.struct(F.struct("parameter").alias("properties")))
    return payloads.daily_observations(_land(by_month.select("state", text.alias("payload")), "daily-payloads"))


@query
def forecast_payloads(spark, folder):
    """Forecast points written as parallel arrays, one document per state and month, and read back."""
    points = t.forecast_series(spark, folder).groupBy("state", "ts").agg(
        *[half_even(F.avg(v), 6).alias(v) for v in fv.FORECAST_VARIABLES]
    )
    # One row per time stamp, so a document holds the time stamps of one month.
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time")
    rows = points.groupBy("state", F.date_format("ts", "yyyyMM").alias("month")).agg(
        F.sort_array(F.collect_list(F.struct(time, *fv.FORECAST_VARIABLES))).alias("r")
    )
    arrays = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("time", *fv.FORECAST_VARIABLES)])
    text = F.to_json(F.struct(arrays.alias("six_hourly")), {"ignoreNullFields": "false"})
    landed = _land(rows.select("state", text.alias("payload")), "forecast-payloads")
    return payloads.forecast_points(landed).drop("pos")


@query
def dimension_files(spark, folder):
    """A dimension landed as several CSV files with names that occur twice, read back in file order."""
    rows = t.irrigation(spark, folder)
    again = rows.where("ord % 3 = 0").withColumns({fv.IRRIGATION: F.col(fv.IRRIGATION) + 1, "ord": F.col("ord") + 1000})
    landed = scratch_path(spark, "dimension")
    files.write_table(rows.union(again).repartitionByRange(3, "ord").sortWithinPartitions("ord").drop("ord"), landed)
    position = F.row_number().over(Window.orderBy("ord")).alias("position")
    return files.read_dimension(spark, landed, fv.IRRIGATION).select("state", fv.IRRIGATION, position)


@query
def first_usable_table(spark, folder):
    """The first path that exists, after one that does not."""
    landed = scratch_path(spark, "requests")
    files.write_table(t.fertilizer(spark, folder), f"{landed}.parquet", "parquet")
    return files.first_source(spark, [scratch_path(spark, "missing"), f"{landed}.parquet"])


@query
def first_suitable_table(spark, folder):
    """The first table with all features: one path is missing, the next table lacks the weather."""
    lacking, good = (f"{scratch_path(spark, name)}.parquet" for name in ("lacking", "good"))
    files.write_table(t.production(spark, folder), lacking, "parquet")
    files.write_table(enriched(spark, folder), good, "parquet")
    found, _ = files.first_suitable_source(spark, [scratch_path(spark, "missing"), lacking, good])
    return rounded(found.groupBy("crop").agg(F.count("*").alias("n"), F.avg(fv.TARGET).alias("mean_yield")), 4, "mean_yield")


# --- forecast ------------------------------------------------------------------------------------
@query
def season_forecast(spark, folder):
    rows = fc.season_forecast(t.forecast_series(spark, folder), FORECAST_AS_OF)
    spread = [F.col(f"forecast_spread.{c}").alias(f"spread_{c}") for c in fv.WEATHER]
    return rows.select("*", *spread).drop("forecast_spread")


@query
def forecast_rejects(spark, folder):
    return fc.forecast_rejects(t.requests(spark, folder), forecast(spark, folder))


@query
def forecast_delta(spark, folder):
    rows = fc.forecast_delta(forecast(spark, folder).select("state", "season", *fv.WEATHER), trailing(spark, folder))
    return rounded(rows, 6, *[f"hist_{c}" for c in fv.WEATHER])


@query
def asked_forecasts(spark, folder):
    """The forecast report of the states and seasons that requests ask for."""
    report, _ = forecast_report.forecast_report(
        t.forecast_series(spark, folder), trailing(spark, folder), FORECAST_AS_OF, t.requests(spark, folder)
    )
    return report.select("state", "season", *fv.WEATHER, *[f"delta_{c}" for c in fv.WEATHER])


@query
def cached_forecasts(spark, folder):
    """Asked forecasts, those of every tenth request asked for first; the second run reads these and saves the others."""
    base, asked = scratch_path(spark, "forecast-snapshot"), t.requests(spark, folder)
    points = t.forecast_series(spark, folder)
    forecast_report.cached_forecast(spark, base, points, f"{FORECAST_AS_OF} 00:00:00", asked.where("request_id % 10 = 1"))
    rows = forecast_report.cached_forecast(spark, base, points, f"{FORECAST_AS_OF} 12:00:00", asked)
    spread = [F.col(f"forecast_spread.{c}").alias(f"spread_{c}") for c in fv.WEATHER]
    return rows.select("*", *spread, F.hour("cached_at").alias("saved_hour")).drop("forecast_spread", "cached_at")


@query
def latest_valid_forecast(spark, folder):
    rows = fc.latest_valid(t.forecast_snapshot(spark, folder), SNAPSHOT_AS_OF)
    return rows.select("state", "season", "snap_id", F.to_date("cached_at").alias("cached_on"))


@query
def forecast_snapshot_stats(spark, folder):
    return fc.forecast_snapshot_stats(t.forecast_snapshot(spark, folder), SNAPSHOT_AS_OF)


@query
def forecast_keys(spark, folder):
    months = F.transform(season_months(F.col("season")), lambda m: m.cast("string"))
    return t.forecast_snapshot(spark, folder).select(
        "snap_id",
        forecast_key(F.col("state"), F.col("season"), F.col("cached_at")).alias("forecast_key"),
        F.array_join(months, ",").alias("months"),
    )


# --- shaping -------------------------------------------------------------------------------------
@query
def clean_columns(spark, folder):
    raw = t.production(spark, folder).select(
        F.col("row_key").alias(" Row-Key "),
        F.col("crop").alias("Crop"),
        F.col("state").alias("State Name"),
        F.col("district").alias("DISTRICT"),
        F.col("season").alias("Season "),
        F.col("crop_year").alias("Crop_Year"),
        F.col("area").alias("CostOf Area"),
        F.col("production").alias("Production"),
        F.col("yield").alias("Yield (q/ha)"),
    )
    return shaping.clean_columns(raw)


@query
def feature_projection(spark, folder):
    return shaping.project_features(t.production(spark, folder), keep=["row_key"])


@query
def completeness(spark, folder):
    return shaping.completeness(enriched_with_gaps(spark, folder), [*fv.FEATURES, fv.TARGET])


@query
def feature_catalog(spark, folder):
    return shaping.feature_catalog(enriched(spark, folder))


@query
def features_with_values(spark, folder):
    return ins.features_with_values(enriched(spark, folder))


# --- insights ------------------------------------------------------------------------------------
@query
def yield_by_crop(spark, folder):
    return rounded(ins.mean_target_ascending(t.production(spark, folder)), 4, "mean_yield")


@query
def yield_of_first_crops(spark, folder):
    return rounded(ins.mean_target_ascending(ins.filter_crops(t.production(spark, folder))), 4, "mean_yield")


@query
def top_states(spark, folder):
    return rounded(ins.top_groups(t.production(spark, folder)), 4, "mean_yield")


@query
def yield_trend(spark, folder):
    return rounded(ins.trend(t.production(spark, folder)), 4, "mean_yield")


@query
def first_by_state(spark, folder):
    return ins.first_value(enriched(spark, folder), "state", fv.IRRIGATION, "row_key")


@query
def yield_histogram(spark, folder):
    return rounded(ins.histogram(t.production(spark, folder), fv.TARGET), 4, "bin_start", "bin_end")


@query
def yield_histogram_by_crop(spark, folder):
    return rounded(ins.histogram(t.production(spark, folder), fv.TARGET, by=["crop"]), 4, "bin_start", "bin_end")


@query
def corr_matrix(spark, folder):
    return rounded(ins.correlations(enriched(spark, folder), oracles.CORR_COLUMNS), 6, "corr")


@query
def profile(spark, folder):
    return ins.profile(t.production(spark, folder))


@query
def area_stats(spark, folder):
    return ins.area_stats(t.production(spark, folder))


@query
def domains(spark, folder):
    return ins.domains(t.production(spark, folder))


@query
def box_stats(spark, folder):
    rows = ins.five_numbers(t.production(spark, folder))
    return rounded(rows, 4, "lowest", "q25", "q50", "q75", "highest")


@query
def describe(spark, folder):
    rows = ins.describe(enriched(spark, folder), oracles.CORR_COLUMNS)
    return rounded(rows, 4, "mean", "std", "min", "q25", "q50", "q75", "max")


@shared
def _insights(spark, folder) -> insight_report.InsightReport:
    """The report set over its default crops."""
    dimensions = t.irrigation(spark, folder), t.fertilizer(spark, folder)
    return insight_report.insight_report(t.production(spark, folder), snapshot(spark, folder), *dimensions)


@query
def insight_by_crop(spark, folder):
    return rounded(_insights(spark, folder).by_crop, 4, "mean_yield")


@query
def insight_top_states(spark, folder):
    return rounded(_insights(spark, folder).top_states, 4, "mean_yield")


@query
def insight_trend(spark, folder):
    return rounded(_insights(spark, folder).by_year, 4, "mean_yield")


@query
def insight_distribution(spark, folder):
    return rounded(_insights(spark, folder).distribution, 4, "bin_start", "bin_end")


@query
def insight_scatter(spark, folder):
    """Slope and correlation of yield with every weather column, by crop."""
    parts = [rows.withColumn("feature", F.lit(name)) for name, rows in _insights(spark, folder).weather_scatter.items()]
    return rounded(rounded(reduce(DataFrame.unionByName, parts), 6, "corr"), 4, "slope")


@query
def insight_irrigation(spark, folder):
    return _insights(spark, folder).irrigation


@query
def insight_fertilizer(spark, folder):
    return _insights(spark, folder).fertilizer


@query
def insight_correlation(spark, folder):
    return rounded(_insights(spark, folder).correlation, 6, "corr")


@query
def insight_preview(spark, folder):
    rows = _insights(spark, folder).preview
    return rows.select("row_key", "crop", "state", "season", "crop_year", "area", "yield", "total_rows")


@query
def scatter_points(spark, folder):
    return rounded(ins.scatter_points(enriched(spark, folder), "mean_temperature"), 6, "mean_temperature")


@query
def scatter_summary(spark, folder):
    rows = ins.scatter_summary(enriched(spark, folder), "mean_temperature")
    return rounded(rounded(rows, 6, "corr"), 4, "slope")


@query
def preview(spark, folder):
    rows = t.production(spark, folder).select("row_key", "crop", "state", "season", "crop_year", "area", "yield")
    return ins.preview(rows, ["row_key"])


@query
def yield_gauge(spark, folder):
    means = t.production(spark, folder).groupBy("crop", "state").agg(F.avg(fv.TARGET).alias("mean_yield"))
    return rounded(means.select("*", gauge(F.col("crop"), F.col("mean_yield")).alias("g")), 4, "mean_yield").select(
        "crop", "state", "mean_yield", "g.gauge_max", "g.gauge_band"
    )


# --- split and feature statistics ----------------------------------------------------------------
@query
def stratified_split(spark, folder):
    return splitting.split(t.production(spark, folder), "row_key", ["crop"]).select("row_key", "crop", "split")


@query
def plain_split(spark, folder):
    return splitting.split(t.production(spark, folder), "row_key").select("row_key", "split")


@query
def split_sizes(spark, folder):
    return splitting.split_sizes(labelled(spark, folder))


@query
def split_files(spark, folder):
    """Train and test written as CSV folders and read back with a schema."""
    path = scratch_path(spark, "splits")
    columns = [c.split()[0] for c in files.PRODUCTION_SCHEMA.split(", ")]
    files.write_splits(labelled(spark, folder).select(*columns, "split"), path)
    parts = [files.read_split(spark, path, s, files.PRODUCTION_SCHEMA).withColumn("split", F.lit(s)) for s in ("train", "test")]
    both = parts[0].unionByName(parts[1])
    return rounded(both.groupBy("split", "crop").agg(F.count("*").alias("n"), F.sum("area").alias("area")), 4, "area")


@query
def impute_medians(spark, folder):
    rows = splitting.split(stored(enriched_with_gaps(spark, folder), "rows-with-gaps"), "row_key", ["crop"])
    return rounded(encoding.medians(rows.where("split = 'train'")), 6, "median")


@query
def impute_modes(spark, folder):
    return encoding.modes(encoding.category_counts(labelled(spark, folder).where("split = 'train'")))


@query
def scale_stats(spark, folder):
    return rounded(encoding.scales(filled(spark, folder)), 6, "mean", "scale")


@query
def onehot_labels(spark, folder):
    return encoding.categories(encoding.category_counts(labelled(spark, folder).where("split = 'train'")))


@shared
def fitted_features(spark, folder):
    return encoding.fit_features(labelled(spark, folder).where("split = 'train'"))


@query
def encoded_features(spark, folder):
    """The encoded vector of every train row, its set categories as text and its numbers as columns."""
    model = fitted_features(spark, folder)
    rows = model.transform(labelled(spark, folder).where("split = 'train'"))
    vector = rows.select("row_key", vector_to_array("features").alias("v"))
    hot = [n for n in model.names if n.startswith("cat__")]
    names = F.array(*[F.lit(n) for n in hot])
    pairs = F.zip_with(names, F.slice("v", 1, len(hot)), lambda n, v: F.when(v == 1, n))
    numbers = [half_even(F.get("v", F.lit(len(hot) + i)), 6).alias(f"num__{c}") for i, c in enumerate(fv.NUMERICAL)]
    return vector.select("row_key", F.array_join(pairs, ",").alias("hot"), *numbers)


@query
def feature_names(spark, folder):
    return encoding.feature_names(labelled(spark, folder), fitted_features(spark, folder))


def _schema_columns(document):
    years = F.transform("unique_crop_year", lambda y: y.cast("string"))
    return document.select(
        "n_training_samples",
        *[F.array_join(f"unique_{c}", ",").alias(f"unique_{c}") for c in fv.CATEGORICAL],
        F.array_join(years, ",").alias("unique_crop_year"),
        "n_output_features",
        *[F.col(f"stats_area.{s}").alias(f"area_{s}") for s in ("min", "max", "mean", "median", "std")],
    )


@query
def feature_schema(spark, folder):
    _, document = schema_document.fit_schema(enriched(spark, folder))
    return _schema_columns(document)


# --- metrics -------------------------------------------------------------------------------------
@query
def regression_metrics(spark, folder):
    return mt.regression_metrics(scored(spark, folder))


@query
def per_crop_metrics(spark, folder):
    return mt.regression_metrics(scored(spark, folder), ["crop"])


@query
def residuals(spark, folder):
    return rounded(mt.residuals(scored(spark, folder)).select("row_key", "residual"), 6, "residual")


@query
def residual_histogram(spark, folder):
    return rounded(mt.residual_histogram(scored(spark, folder)), 4, "bin_start", "bin_end")


@query
def prediction_range(spark, folder):
    return rounded(mt.prediction_range(scored(spark, folder)), 4, "lowest", "highest", "axis_low", "axis_high")


# --- requests ------------------------------------------------------------------------------------
def _flat(validated: DataFrame) -> DataFrame:
    return validated.withColumn("errors", F.array_join("errors", " | "))


@query
def validate_requests(spark, folder):
    return _flat(rq.validate_requests(t.requests(spark, folder), known(spark, folder)))


@query
def rejected_requests(spark, folder):
    return rq.rejected(rq.validate_requests(t.requests(spark, folder), known(spark, folder)))


@query
def override_inputs(spark, folder):
    valid = rq.accepted(rq.validate_requests(t.requests(spark, folder), known(spark, folder)))
    return en.override_inputs(valid, inputs(spark, folder)).select(
        "request_id", "state", fv.IRRIGATION, "irrigation_source", fv.FERTILIZER, "npk_source"
    )


@query
def route_weather(spark, folder):
    rows = valid_features(spark, folder)
    past = [f"hist_{c}" for c in fv.WEATHER]
    chosen = rows.select(
        "request_id", "state", "season", "crop_year", *fv.WEATHER, *past, "weather_source", "forecast_confidence"
    )
    return rounded(chosen, 6, *fv.WEATHER, *past)


@query
def input_summary(spark, folder):
    return shaping.input_summary(valid_features(spark, folder)).drop("badge")


# --- model ---------------------------------------------------------------------------------------
@query
def model_scores(spark, folder):
    """Test rows scored by the trained model."""
    return trained(spark, folder).test


@query
def model_metrics(spark, folder):
    return trained(spark, folder).metrics


@query
def training_record(spark, folder):
    return trained(spark, folder).metadata


@query
def search_results(spark, folder):
    return md.cv_table(spark, trained(spark, folder).model.cv_scores)


@query
def importance_top10(spark, folder):
    return md.top_importances(spark, trained(spark, folder).model)


@query
def feature_counts(spark, folder):
    return md.feature_counts(valid_features(spark, folder), trained(spark, folder).model)


@shared
def _evaluated(spark, folder):
    return evaluation.evaluate_job(
        spark,
        trained(spark, folder).model,
        t.production(spark, folder),
        snapshot(spark, folder),
        t.irrigation(spark, folder),
        t.fertilizer(spark, folder),
        oracles.AS_OF,
    )


@query
def evaluation_per_crop(spark, folder):
    return _evaluated(spark, folder).per_crop


@query
def evaluation_record(spark, folder):
    return _evaluated(spark, folder).record.select("evaluation.*")


@query
def scored_requests(spark, folder):
    return scoring.score_requests(
        t.requests(spark, folder),
        trained(spark, folder).model,
        known(spark, folder),
        snapshot(spark, folder),
        forecast(spark, folder),
        inputs(spark, folder),
    )


@query
def forecast_yield_delta(spark, folder):
    rows = scored_requests(spark, folder).where("historical_yield is not null")
    return rows.select("request_id", "predicted_yield", "historical_yield", "yield_delta", "shown_yield_delta")


@shared
def background(spark, folder):
    model = trained(spark, folder).model
    rows = labelled(spark, folder).where("split = 'train'")
    return ctr.background(stored(model.features.transform(rows).select("features"), "background-rows"))


@query
def background_summary(spark, folder):
    return ctr.background_table(spark, background(spark, folder), trained(spark, folder).model.features.names)


@query
def contributions(spark, folder):
    return ctr.contributions(valid_features(spark, folder), trained(spark, folder).model, background(spark, folder))


@query
def contribution_report(spark, folder):
    return ctr.contribution_report(stored(contributions(spark, folder), "contributions"))


# --- the model's trees as a table -----------------------------------------------------------------
@shared
def tree_nodes(spark, folder):
    return trees.node_table(spark, trained(spark, folder).model.trees)


@query
def tree_predictions(spark, folder):
    """Test rows scored level by level from the node table, against the model's own scores."""
    model = trained(spark, folder).model
    rows = model.features.transform(labelled(spark, folder).where("split = 'test'"))
    found = trees.evaluate(rows, tree_nodes(spark, folder), trees.depth(model.trees), model.trees.getNumTrees)
    both = found.join(trained(spark, folder).test, "row_key", "full")
    return both.select("row_key", F.coalesce(checks.close(F.col("prediction"), F.col("y_pred")), F.lit(False)).alias("same"))


@query
def tree_importances(spark, folder):
    """Importances from the node table, against the model's own."""
    model = trained(spark, folder).model
    found = trees.node_importances(tree_nodes(spark, folder), model.features.names)
    both = md.importances(spark, model).join(found.withColumnRenamed("importance", "found"), "feature", "full")
    return both.select("feature", F.coalesce(checks.close(F.col("found"), F.col("importance")), F.lit(False)).alias("same"))


@shared
def tree_shares(spark, folder):
    found = trees.contributions(valid_features(spark, folder), trained(spark, folder).model, tree_nodes(spark, folder))
    return stored(found, "tree-contributions")


@query
def tree_contribution_report(spark, folder):
    """The 25 encoded features that matter most to each request, by exact Shapley values."""
    return ctr.contribution_report(tree_shares(spark, folder))


def _request_scores(spark, folder):
    return md.score(valid_features(spark, folder), trained(spark, folder).model).select("request_id", "prediction")


@query
def tree_contribution_checks(spark, folder):
    rows = tree_shares(spark, folder)
    report = ctr.contribution_report(rows)
    return checks.contribution_rules(report, ctr.breakdown(rows), _request_scores(spark, folder), 25)


@query
def raw_feature_contribution_checks(spark, folder):
    """Exact Shapley values of the eleven raw features."""
    model = trained(spark, folder).model
    rows = stored(trees.contributions(valid_features(spark, folder), model, tree_nodes(spark, folder), encoded=False), "raw-contributions")
    return checks.contribution_rules(ctr.contribution_report(rows), ctr.breakdown(rows), _request_scores(spark, folder), len(fv.FEATURES))


# --- checks beside the model's answers -------------------------------------------------------------
@query
def model_scores_checks(spark, folder):
    rows = trained(spark, folder).test
    finite = F.col("y_pred").isNotNull() & (F.abs("y_pred") < float("inf"))
    return rounded(rows, 6, "y_true").select("row_key", "crop", "y_true", F.coalesce(finite, F.lit(False)).alias("scored"))


@query
def training_record_checks(spark, folder):
    return checks.record_summary(trained(spark, folder))


@query
def search_checks(spark, folder):
    return checks.search_rules(md.cv_table(spark, trained(spark, folder).model.cv_scores))


@query
def evaluation_per_crop_checks(spark, folder):
    sound = F.when(F.col("n") >= 2, (F.col("rmse") >= F.col("mae")) & (F.col("r2") <= 1)).otherwise(F.col("rmse").isNull())
    return _evaluated(spark, folder).per_crop.select("crop", "n", F.coalesce(sound, F.lit(False)).alias("sound"))


@query
def evaluation_record_checks(spark, folder):
    record = _evaluated(spark, folder).record.select("evaluation.*")
    crops = F.array_join(F.transform("per_crop", lambda c: F.concat(c["crop"], F.lit(":"), c["n"])), ",")
    sound = (F.col("rmse") >= F.col("mae")) & (F.col("r2") <= 1) & (F.col("mape") >= 0)
    return record.select("n_samples", "n_train", "n_test", "seed", "weather_period", "features.total_input", "features.total_encoded", crops.alias("crops"), sound.alias("sound"))


@query
def scored_request_checks(spark, folder):
    answers = stored(scored_requests(spark, folder), "answers")
    return checks.response_rules(answers, valid_features(spark, folder), trained(spark, folder).model)


@query
def stream_answers_agree(spark, folder):
    return checks.agreement(stream_scored_requests(spark, folder), scored_requests(spark, folder), "request_id")


@query
def background_checks(spark, folder):
    return checks.background_rules(background_summary(spark, folder))


@query
def contribution_checks(spark, folder):
    rows = stored(contributions(spark, folder), "contributions")
    return checks.contribution_rules(ctr.contribution_report(rows), ctr.breakdown(rows), _request_scores(spark, folder), len(fv.FEATURES))


@query
def risk_response_checks(spark, folder):
    """Each JSON record, read back, against the assessment it tells of."""
    told = risk_responses(spark, folder)
    read = F.from_json("record", "state string, overall_risk string, alerts array<struct<level:string,category:string,message:string>>, summary string")
    assessed = risk.assess(trailing(spark, folder), wx.weather_norms(snapshot(spark, folder)))
    keys = F.transform("alerts", lambda a: F.struct(a["level"].alias("level"), a["category"].alias("category"), a["message"].alias("message")))
    left = told.select("state", read.alias("r")).select("state", "r.overall_risk", "r.summary", "r.alerts")
    return checks.agreement(left, assessed.select("state", "overall_risk", "summary", keys.alias("alerts")), "state")


# --- streams -------------------------------------------------------------------------------------
def _request_stream(spark, folder):
    schema = t.table(spark, folder, "customer").schema
    return t.requests(spark, folder, jobs.table_stream(spark, folder, "customer", schema))


def _drained(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    jobs.drain(stream, path, scratch_path(spark, f"{name}-progress"))
    return spark.read.schema(stream.schema).parquet(path)


@query
def stream_validated_requests(spark, folder):
    return _flat(_drained(jobs.validated_stream(_request_stream(spark, folder), known(spark, folder)), "validated"))


@query
def stream_rejected_requests(spark, folder):
    """The other side of the validated stream, with the reasons."""
    checked = jobs.validated_stream(_request_stream(spark, folder), known(spark, folder))
    return _drained(rq.rejected(checked), "rejected-requests")


@query
def stream_scored_requests(spark, folder):
    good, _ = jobs.scored_stream(
        _request_stream(spark, folder),
        trained(spark, folder).model,
        known(spark, folder),
        snapshot(spark, folder),
        forecast(spark, folder),
        inputs(spark, folder),
    )
    return _drained(good, "scored-requests")


@query
def stream_trailing_weather(spark, folder):
    """Daily readings as a stream, summed per day with a watermark, then the trailing period."""
    lines = jobs.table_stream(spark, folder, "lineitem", t.table(spark, folder, "lineitem").schema)
    base = scratch_path(spark, "weather-days")
    jobs.collect_days(t.observations(spark, folder, lineitem=lines), base, scratch_path(spark, "weather-days-progress"))
    return rounded(jobs.collected_weather(spark, base, str(AS_OF)), 6, *fv.WEATHER)


# --- documents and guards --------------------------------------------------------------------------
@query
def stored_schema_document(spark, folder):
    """The schema document, published as JSON and read back."""
    base = scratch_path(spark, "schema-document")
    _, document = schema_document.fit_schema(enriched(spark, folder))
    path = versions.publish(spark, base, lambda _: document, "json")
    return _schema_columns(documents.read_document(spark, path, document.schema))


@query
def merged_record(spark, folder):
    """The training record with the evaluation merged in, as the newest version of the record's document."""
    base = scratch_path(spark, "record")
    versions.publish(spark, base, lambda _: trained(spark, folder).metadata, "json")
    evaluation.merge_record(spark, base, _evaluated(spark, folder).record)
    merged = documents.read_document(spark, documents.latest_version(spark, base))
    return merged.select("model_type", "training_data.n_train", F.col("evaluation.n_test").alias("n_evaluated"), F.size("evaluation.per_crop").cast("long").alias("n_crops"))


@query
def reloaded_model(spark, folder):
    """Test rows scored by the model after it is saved and loaded."""
    model, path = trained(spark, folder).model, scratch_path(spark, "model")
    model.save(path)
    loaded = md.YieldModel.load(path, model.features, model.version)
    rows = md.score(labelled(spark, folder).where("split = 'test'"), loaded).select("row_key", "prediction")
    both = rows.join(trained(spark, folder).test, "row_key", "full")
    return both.select("row_key", F.coalesce(F.col("prediction") == F.col("y_pred"), F.lit(False)).alias("same"))


@query
def numeric_columns(spark, folder):
    """Columns of the raw production table that hold numbers, with how many rows have a value."""
    rows = t.production(spark, folder)
    names = shaping.numeric_columns(rows)
    counted = rows.agg(*[F.count(c).alias(c) for c in names])
    return counted.unpivot([], names, "name", "n")


@query
def missing_features(spark, folder):
    """Features that the raw production table does not bring, and how many rows lack them."""
    rows = t.production(spark, folder)
    missing = F.array(*[F.lit(c) for c in shaping.missing_columns(rows)])
    return rows.agg(F.count("*").alias("n")).select(F.explode(missing).alias("feature"), "n")


@query
def leakage_guard(spark, folder):
    """Which form of the production table passes the guard, per state: raw, cleaned, cleaned without the target."""
    raw = t.production(spark, folder)
    forms = {"raw": raw, "cleaned": shaping.clean_columns(raw), "no target": shaping.clean_columns(raw).drop(fv.TARGET)}

    def passes(df):
        try:
            shaping.check_no_leakage(df)
        except ValueError:
            return False
        return True

    verdicts = [df.groupBy("state").agg(F.count("*").alias("n")).select(F.lit(name).alias("form"), "state", "n", F.lit(passes(df)).alias("passes")) for name, df in forms.items()]
    return reduce(DataFrame.unionByName, verdicts)


@query
def forced_refresh(spark, folder):
    """Year weather upserted by force with older rows: the forced rows stay, whatever their age."""
    base = scratch_path(spark, "forced")
    snapshots.upsert_snapshot(spark, base, wx.weather_snapshot(yearly(spark, folder), None, oracles.AS_OF))
    older = yearly(spark, folder).where("crop_year < 1995").withColumn("mean_temperature", F.lit(-1.0))
    after = snapshots.upsert_snapshot(spark, base, wx.weather_snapshot(older, None, "1990-01-01"), force=True)
    return rounded(after.select("state", "crop_year", "mean_temperature"), 6, "mean_temperature")


# --- contract ------------------------------------------------------------------------------------
def entry(spark: SparkSession, folder: str = "/root/testdata/sf0.001") -> DataFrame:
    """Daily observations to the ranked risk table of every state and year."""
    return risk_report.yearly_risk(t.observations(spark, folder)).table


def queries() -> dict[str, Query]:
    return _queries | _corpus()[0]


def oracle_sql() -> dict[str, str]:
    statements = oracles.all_statements()
    return {name: statements[name] for name in _queries if name in statements} | _corpus()[1]


def _corpus() -> tuple[dict[str, Query], dict[str, str]]:
    """The operators on training text and their pipeline, where that subpackage is there."""
    try:
        import corpus_pipeline
        from harvestline.llm import queries as corpus
    except ModuleNotFoundError as error:
        if error.name and (error.name == "corpus_pipeline" or error.name.startswith("harvestline.llm")):
            return {}, {}
        raise
    pipeline = {"pipeline": lambda spark, folder: corpus_pipeline.run(spark, folder)}
    written = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return corpus.queries() | pipeline, corpus.oracle_sql() | written
