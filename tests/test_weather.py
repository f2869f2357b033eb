from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from harvestline import fixed_values as fv
from harvestline.operators import enrichment as en, weather as wx
from harvestline.plans.snapshot_fill import fill_snapshot

OBSERVATIONS = "state string, obs_date date, param string, val double"


def observations(spark, *rows):
    return spark.createDataFrame(list(rows), OBSERVATIONS)


def test_period_weather(spark):
    day = date(2005, 3, 1)
    rows = observations(
        spark,
        ("Goa", day, "T2M", 20.0), ("Goa", day, "T2M", 22.0), ("Goa", day, "T2M", -999.0), ("Goa", day, "T2M", float("nan")),
        ("Goa", day, "PRECTOTCORR", 2.0), ("Goa", day, "PRECTOTCORR", None),
        ("Goa", day, "RH2M", -999.0),
        ("Goa", date(2006, 1, 1), "T2M", 30.0),
    )
    found = {r["crop_year"]: r for r in wx.period_weather(rows).collect()}
    assert found[2005]["mean_temperature"] == 21.0
    assert found[2005]["total_precipitation"] == pytest.approx(2 * 365.25)
    assert found[2005]["mean_relative_humidity"] is None and found[2005]["mean_solar_radiation"] is None
    assert found[2006]["mean_temperature"] == 30.0
    assert wx.valid_observations(rows).count() == 4


def test_trailing_window_includes_both_ends(spark):
    as_of = date(2005, 3, 1)
    days = [as_of - timedelta(days=d) for d in (-1, 0, 365, 366)]
    rows = observations(spark, *[("Goa", d, "T2M", float(i)) for i, d in enumerate(days)])
    assert wx.trailing_weather(rows, as_of).first()["mean_temperature"] == 1.5


def test_norms(spark):
    schema = "state string, " + ", ".join(f"{c} double" for c in fv.WEATHER)
    rows = spark.createDataFrame(
        [("a", 20.0, 100.0, None, -1.0), ("b", 21.14, float("nan"), None, 0.0), ("c", 0.0, 300.0, None, None)], schema
    )
    assert tuple(wx.weather_norms(rows).first()) == (20.6, 200.0, 62.0, 17.5)
    assert tuple(wx.weather_norms(rows.limit(0)).first()) == (25.5, 1100.0, 62.0, 17.5)


def snapshot(spark, *keys):
    schema = "state string, crop_year int, mode string, " + ", ".join(f"{c} double" for c in fv.WEATHER)
    rows = [(s, y, "LATEST" if y is None else "YEAR", float(y or 1), 2.0, 3.0, None) for s, y in keys]
    return spark.createDataFrame(rows, schema)


def test_year_join_keeps_rows(spark):
    df = spark.createDataFrame([(" Goa", 2000), ("Goa", 2001), (None, 2000), ("Goa", 2000)], "state string, crop_year int")
    out = en.enrich_weather(df, snapshot(spark, ("Goa", 2000), ("Goa", None)))
    found = sorted((r["state"] or "", r["crop_year"], r["mean_temperature"]) for r in out.collect())
    assert [f[2] for f in found] == [None, 2000.0, 2000.0, None]
    counts = en.incomplete_weather(out).first()
    assert (counts["rows"], counts["rows_without_weather"]) == (4, 4)


def test_trailing_join_without_year(spark):
    df = spark.createDataFrame([("Goa ",), ("Bihar",)], "state string")
    out = en.enrich_weather(df, snapshot(spark, ("Goa", 2000), ("Goa", None))).collect()
    assert {r["state"]: r["mean_temperature"] for r in out} == {"Goa ": 1.0, "Bihar": None}


def test_keys(spark):
    df = spark.createDataFrame([("Goa", 2000), ("Goa", 2001), (" Goa", 2000)], "state string, crop_year int")
    snap = snapshot(spark, ("Goa", 2000), ("Bihar", 2000), ("Goa", None))
    assert [tuple(r) for r in en.missing_keys(df, snap).collect()] == [("Goa", 2001)]
    assert [(r["state"], r["crop_year"]) for r in en.used_snapshot(df, snap).collect()] == [("Goa", 2000)]
    assert tuple(en.key_coverage(df, snap).first()) == (2, 1, 1)
    came = spark.createDataFrame([], "state string, crop_year int")
    assert tuple(en.key_coverage(df, snap, came).first()) == (2, 1, 1, 0, 1)
    stats = wx.snapshot_stats(snap).first()
    assert tuple(stats) == (3, 2, 1, "Bihar,Goa", "2000")


def test_fill_snapshot(spark, fresh):
    base = fresh()
    df = spark.createDataFrame([("Goa", 2000), ("Goa", 2001), ("Bihar", 2000)], "state string, crop_year int")
    seen = observations(spark, ("Goa", date(2000, 1, 1), "T2M", 1.0), ("Goa", date(1999, 1, 1), "T2M", 1.0))
    after, stats, coverage = fill_snapshot(spark, base, df, seen, "2002-01-01")
    assert [(r["state"], r["crop_year"], r["lat"]) for r in after.collect()] == [("Goa", 2000, 15.2993)]
    assert tuple(coverage.first()) == (3, 0, 3, 1, 2)
    after, stats, coverage = fill_snapshot(spark, base, df, seen, "2002-01-01")
    assert stats.first()["total_entries"] == 1 and tuple(coverage.first()) == (3, 1, 2, 0, 2)


def dimension(spark, column, *rows):
    return spark.createDataFrame([(s, v, i) for i, (s, v) in enumerate(rows)], f"state string, {column} double, ord bigint")


def test_inputs_and_defaults(spark):
    irrigation = dimension(spark, fv.IRRIGATION, ("Goa", 10.0), ("Punjab", 98.0))
    df = spark.createDataFrame([("GOA", 1), (None, 2), ("Mars", 3)], "state string, i int")
    found = {r["i"]: (r[fv.IRRIGATION], r[fv.FERTILIZER]) for r in en.enrich_inputs(df, irrigation, None).collect()}
    assert found == {1: (10.0, 120.0), 2: (40.0, 120.0), 3: (40.0, 120.0)}
    assert en.enrich_inputs(df.drop("state"), irrigation, None).first()[fv.IRRIGATION] == 40.0
    one = en.enrich_dimension(df, irrigation, fv.IRRIGATION, 40.0)
    assert {r["i"]: r[fv.IRRIGATION] for r in one.collect()} == {1: 10.0, 2: 40.0, 3: 40.0}
    report = en.dimension_report(None, irrigation, fv.IRRIGATION, 40.0).collect()
    assert [(r["state"], r["category"]) for r in report] == [("Goa", "Very Low"), ("Punjab", "Very High")]


def test_enrich_all_only_adds_what_is_missing(spark):
    df = spark.createDataFrame([("Goa", 2000, 7.0)], f"state string, crop_year int, {fv.IRRIGATION} double")
    out = en.enrich_all(df).first()
    assert out[fv.IRRIGATION] == 7.0 and out[fv.FERTILIZER] == 120.0 and out["mean_temperature"] is None


def test_coordinates(spark):
    keys = spark.createDataFrame([("punjab",), ("",), (" ",), ("Atlantis",), ("North Goa",)], "state string")
    found = {r["state"]: (r["lat"], r["lon"]) for r in en.coordinates(keys).collect()}
    assert found == {
        "punjab": (31.1471, 75.3412),
        "": fv.FALLBACK_CENTROID,
        " ": (15.9129, 79.7400),
        "Atlantis": fv.FALLBACK_CENTROID,
        "North Goa": (15.2993, 74.1240),
    }


def test_weather_report(spark):
    keys = spark.createDataFrame([("Goa", 2000), ("Goa", None)], "state string, crop_year int")
    out = en.weather_report(keys, snapshot(spark, ("Goa", 2000), ("Goa", None)), "2001-01-01")
    found = {r["crop_year"]: (r["period"], r["latitude"], r["mean_temperature"]) for r in out.collect()}
    assert found == {2000: ("Year 2000", 15.2993, 2000.0), None: ("2000-01-02 to 2001-01-01", 15.2993, 1.0)}


def test_overrides_and_routing(spark):
    requests = spark.createDataFrame(
        [(1, "Goa", "RABI", 2000, None, 0.0, False), (2, "Goa", "RABI", 2000, 5.0, None, True), (3, "Goa", "KHARIF", 1999, None, None, True)],
        "request_id int, state string, season string, crop_year int, irrigation_pct double, npk_kg_per_ha double, use_forecast boolean",
    )
    inputs = spark.createDataFrame([("Goa", 33.0, 44.0)], f"state string, {fv.IRRIGATION} double, {fv.FERTILIZER} double")
    rows = {r["request_id"]: r for r in en.override_inputs(requests, inputs).collect()}
    assert (rows[1][fv.IRRIGATION], rows[1]["irrigation_source"], rows[1][fv.FERTILIZER], rows[1]["npk_source"]) == (33.0, "state-avg", 0.0, "user")
    assert (rows[2][fv.IRRIGATION], rows[2]["irrigation_source"]) == (5.0, "user")
    ahead = spark.createDataFrame([("Goa", "RABI", 9.0, 9.0, 9.0, 9.0)], "state string, season string, " + ", ".join(f"{c} double" for c in fv.WEATHER))
    routed = {r["request_id"]: r for r in en.route_weather(requests, snapshot(spark, ("Goa", 2000)), ahead).collect()}
    assert (routed[1]["mean_temperature"], routed[1]["weather_source"]) == (2000.0, "historical")
    assert (routed[2]["mean_temperature"], routed[2]["hist_mean_temperature"], routed[2]["weather_source"]) == (9.0, 2000.0, "forecast")
    assert (routed[3]["mean_temperature"], routed[3]["weather_source"]) == (None, "historical")


def test_days_collected_from_a_stream(spark, fresh):
    """Files in any order, readings of a day over several batches, and a batch that runs again: the same as in batch."""
    import random

    from harvestline.streaming import jobs

    rng = random.Random(2)
    days = [f"200{y}-{m:02d}-{d:02d}" for y in (3, 4) for m in range(1, 13) for d in (1, 9, 28)]
    rows = [("Goa" if rng.random() < 0.6 else "Bihar", rng.choice(days), rng.choice(list(fv.DAILY_PARAMETERS)), rng.choice([1.5, 20.25, -999.0, None, 7.0])) for _ in range(900)]
    schema = "state string, obs_date string, param string, val double"
    landed, base, progress = fresh("landed"), fresh("days"), fresh("progress")

    def run(part):
        spark.createDataFrame(part, schema).selectExpr("state", "cast(obs_date as date) AS obs_date", "param", "val").coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema("state string, obs_date date, param string, val double").option("maxFilesPerTrigger", 1).parquet(landed)
        jobs.collect_days(stream, base, progress)

    for low in range(0, 900, 300):
        run(rows[low : low + 300])
    whole = spark.createDataFrame(rows, schema).selectExpr("state", "cast(obs_date as date) AS obs_date", "param", "val")
    want = {r["state"]: tuple(r)[1:] for r in wx.trailing_weather(whole, "2004-12-28").collect()}
    got = {r["state"]: tuple(r)[1:] for r in jobs.collected_weather(spark, base, "2004-12-28").collect()}
    assert got.keys() == want.keys() and len(got) == 2
    for state in want:
        assert got[state] == pytest.approx(want[state])
    last = max(p.name for p in __import__("pathlib").Path(base).iterdir())
    days = spark.read.parquet(f"{base}/{last}")
    spark.createDataFrame(days.collect(), days.schema).write.mode("overwrite").parquet(f"{base}/{last}")  # the batch is repeated
    assert {r["state"]: tuple(r)[1:] for r in jobs.collected_weather(spark, base, "2004-12-28").collect()} == got
