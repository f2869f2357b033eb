import statistics
from datetime import datetime, timedelta

import pytest

from harvestline import fixed_values as fv
from harvestline.operators import forecast as fc
from harvestline.plans.forecast_report import forecast_report

POINTS = "state string, ts timestamp_ntz, temperature_2m double, precipitation double, relative_humidity_2m double, shortwave_radiation double"


def points(spark, rows):
    return spark.createDataFrame(rows, POINTS)


def series():
    start = datetime(2005, 5, 20)
    out = []
    for i in range(100):
        ts = start + timedelta(hours=6 * i)
        out.append(("Goa", ts, 20 + i * 0.1, None if i % 7 == 0 else i * 0.05, 50.0 + i % 9, None if i % 11 == 0 else 200.0 + i))
    return out


def test_against_plain_python(spark):
    rows = series() + [("Goa", None, 1.0, 1.0, 1.0, 1.0)]
    found = {r["season"]: r for r in fc.season_forecast(points(spark, rows), "2005-05-25").collect()}
    assert set(found) == {"SUMMER", "KHARIF", "WHOLE YEAR"}
    for season, row in found.items():
        own = [r for r in series() if r[1].month in fv.SEASON_MONTHS[season]]
        days = len(own) / 4

        def values(i):
            return [r[i] for r in own if r[i] is not None]

        ahead = [(r[1].date() - datetime(2005, 5, 25).date()).days for r in own]
        rain = sum(values(3))
        assert row["data_points"] == len(own)
        assert row["mean_temperature"] == round(statistics.fmean(values(2)), 2)
        assert row["total_precipitation"] == round(rain / days * 365.25, 1)
        assert row["mean_relative_humidity"] == round(statistics.fmean(values(4)), 1)
        assert row["mean_solar_radiation"] == round(statistics.fmean(values(5)) * 0.0864, 2)
        assert row["season_total_precipitation_mm"] == round(rain, 1)
        assert row["coverage_pct"] == round(len(own) / 101 * 100, 1)
        assert row["forecast_horizon_days"] == max(0, int(statistics.median(ahead)))
        spread = row["forecast_spread"]
        assert spread["mean_temperature"] == round(statistics.pstdev(values(2)), 2)
        assert spread["total_precipitation"] == round(statistics.pstdev(values(3)) * 365.25 / max(days, 1) * 2, 1)
        assert spread["mean_solar_radiation"] == round(statistics.pstdev(values(5)) * 0.0864, 2)


def test_no_rain_values_and_past_dates(spark):
    rows = [("Goa", datetime(2005, 7, 1), 20.0, None, None, None)]
    row = {r["season"]: r for r in fc.season_forecast(points(spark, rows), "2006-01-01").collect()}["KHARIF"]
    assert (row["total_precipitation"], row["season_total_precipitation_mm"]) == (0.0, 0.0)
    assert row["mean_relative_humidity"] is None and row["forecast_spread"]["total_precipitation"] is None
    assert (row["forecast_horizon_days"], row["forecast_confidence"]) == (0, "high")


def test_delta(spark):
    weather = ", ".join(f"{c} double" for c in fv.WEATHER)
    ahead = spark.createDataFrame([("Goa", "RABI", 20.5, 800.0, None, 15.0), ("Bihar", "RABI", 1.0, 1.0, 1.0, 1.0)], f"state string, season string, {weather}")
    past = spark.createDataFrame([("Goa", 20.0, 900.0, 0.01, None)], f"state string, {weather}")
    rows = {r["state"]: r for r in fc.forecast_delta(ahead, past).collect()}
    goa = rows["Goa"]
    assert (goa["delta_mean_temperature"], goa["delta_pct_mean_temperature"], goa["shown_mean_temperature"]) == (0.5, 2.5, 0.5)
    assert (goa["delta_total_precipitation"], goa["delta_pct_total_precipitation"]) == (-100.0, -11.1)
    assert (goa["delta_mean_relative_humidity"], goa["delta_pct_mean_relative_humidity"]) == (-0.01, 0.0)
    assert (goa["delta_mean_solar_radiation"], goa["delta_pct_mean_solar_radiation"], goa["direction"]) == (15.0, 0.0, "flat")
    assert rows["Bihar"]["delta_mean_temperature"] is None and rows["Bihar"]["delta_pct_mean_temperature"] is None


def test_report_with_rejects(spark):
    weather = ", ".join(f"{c} double" for c in fv.WEATHER)
    asked = spark.createDataFrame([("Goa", "kharif"), ("Goa", "winter"), ("Goa", "monsoon")], "state string, season string")
    report, rejects = forecast_report(points(spark, series()), spark.createDataFrame([], f"state string, {weather}"), "2005-05-25", asked)
    assert [r["season"] for r in report.collect()] == ["KHARIF"]
    assert {r["season"]: r["reason"] for r in rejects.collect()} == {
        "WINTER": "no forecast points in the season's months", "MONSOON": "unknown season",
    }


@pytest.fixture
def cached(spark):
    times = ["2001-07-15 00:00:00", "2001-07-01 00:00:00", "2001-06-30 23:00:00", "2001-06-15 00:00:00", None]
    rows = [(i, "Goa", "RABI", t and datetime.fromisoformat(t)) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "snap_id int, state string, season string, cached_at timestamp_ntz")


def test_freshness(cached):
    fresh = cached.where(fc.is_fresh(cached["cached_at"], "2001-07-15")).select("snap_id").orderBy("snap_id")
    assert [r[0] for r in fresh.collect()] == [0, 1]
    assert [r["snap_id"] for r in fc.latest_valid(cached, "2001-07-15").collect()] == [0]
    # Exactly 30 days old has expired.
    assert tuple(fc.forecast_snapshot_stats(cached, "2001-07-15").first()) == (5, 3, 2, 30)
