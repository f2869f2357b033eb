from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from harvestline.functions import labels, numbers, text

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
FLOATS = st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=20, max_size=60)


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    rows = df.select("i", expression(F.col("x")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


@FEW
@given(values=FLOATS, digits=st.integers(0, 4))
def test_half_even_is_correct_rounding(spark, values, digits):
    values = values + [2.675, 0.125, 2.5, -0.04, 0.5, 1.5, -2.5]
    assert column(spark, values, "double", lambda x: numbers.half_even(x, digits)) == [round(v, digits) + 0.0 for v in values]


@FEW
@given(values=FLOATS)
def test_texts(spark, values):
    values = values + [2.5, 3.5, -0.3, 0.0, 1.96, 4.04, -1.5]
    assert column(spark, values, "double", lambda x: numbers.fixed_text(x, 1)) == [f"{v:.1f}" for v in values]
    assert column(spark, values, "double", numbers.signed_text) == [f"{v:+.0f}" for v in values]
    expected = [str(int(round(v))) if abs(v - round(v)) < 0.05 else f"{v:.1f}" for v in values]
    assert column(spark, values, "double", numbers.compact_text) == expected


def test_nan_and_percent(spark):
    assert column(spark, [1.0, float("nan"), None], "double", numbers.nan_to_null) == [1.0, None, None]
    assert column(spark, [0.0, -1.0, 4.0], "double", lambda x: numbers.percent_of(F.lit(2.0), x)) == [0.0, 0.0, 50.0]


def test_compare(spark):
    df = spark.createDataFrame([("<",), (">",), ("<=",), (">=",), ("==",), (None,)], "op string")
    found = [r[0] for r in df.select(numbers.compare(F.lit(4.0), F.col("op"), F.lit(4.0))).collect()]
    assert found == [False, False, True, True, False, False]
    missing = df.select(numbers.compare(F.lit(None).cast("double"), F.col("op"), F.lit(4.0))).collect()
    assert [r[0] for r in missing] == [False] * 6


def test_seasons(spark):
    given_names = [" kharif ", "whole_year", "ANNUAL", "WholeYear", "monsoon"]
    assert column(spark, given_names, "string", text.canonical_season) == [
        "KHARIF", "WHOLE YEAR", "WHOLE YEAR", "WHOLE YEAR", "MONSOON",
    ]
    assert column(spark, ["rabi", "monsoon"], "string", text.season_months) == [[11, 12, 1, 2, 3], list(range(1, 13))]
    assert column(spark, [3, 7], "int", text.seasons_of_month) == [["RABI", "SUMMER", "WHOLE YEAR"], ["KHARIF", "WHOLE YEAR"]]


def test_names_and_keys(spark):
    names = ["crop", "soil_ph", "npk2_total", "area"]
    assert column(spark, names, "string", text.display_name) == ["Crop", "Soil Ph", "Npk2 Total", "Area (Ha)"]
    aliases = {"orissa": "Odisha"}
    assert column(spark, [" ORISSA ", "Goa "], "string", lambda c: text.canonical_name(c, aliases)) == ["Odisha", "Goa"]
    keys = ["West_Bengal_2005", "Goa_LATEST", "nokey"]
    assert column(spark, keys, "string", text.key_state) == ["West_Bengal", "Goa", ""]
    assert column(spark, keys, "string", text.key_year) == [2005, None, None]
    assert column(spark, [2005, None], "int", lambda y: text.state_year_key(F.lit(" Goa "), y)) == ["Goa_2005", "Goa_LATEST"]
    assert column(spark, ["annual"], "string", lambda s: text.forecast_key(F.lit("Goa"), s, F.lit(date(2001, 7, 15)))) == [
        "Goa_WHOLE YEAR_2001-07"
    ]


def test_times(spark):
    stamps = ["2005-01-01T06:00:00Z", "2005-01-01T06:00:00+05:30", "2005-01-01T06:00", "soon", None]
    found = column(spark, stamps, "string", lambda c: text.wall_clock(c).cast("string"))
    assert found == ["2005-01-01 06:00:00"] * 3 + [None, None]
    one = spark.range(1).select(
        text.period_label("2001-03-01"), text.year_start(F.lit(2004)), text.year_end(F.lit(2004))
    ).first()
    assert tuple(one) == ("2000-03-01 to 2001-03-01", date(2004, 1, 1), date(2004, 12, 31))


@pytest.mark.parametrize(
    "band,values,expected",
    [
        (labels.irrigation_band, [80.0, 79.9, 60.0, 40.0, 20.0, 19.9], ["Very High", "High", "High", "Moderate", "Low", "Very Low"]),
        (labels.fertilizer_band, [200.0, 199.9, 150.0, 100.0, 50.0, 49.9], ["Very High", "High", "High", "Moderate", "Low", "Very Low"]),
    ],
)
def test_bands(spark, band, values, expected):
    assert column(spark, values, "double", lambda x: band(x)["category"]) == expected
    assert column(spark, [None], "double", lambda x: band(x)["category"]) == [None]


def test_forecast_labels(spark):
    days = [0, 45, 46, 120, 121]
    assert column(spark, days, "int", labels.forecast_confidence) == ["high", "high", "medium", "medium", "low"]
    low = column(spark, [12.4], "double", lambda c: labels.forecast_warning(c, F.lit(200)))
    assert low == ["Low forecast coverage (12%). Season extends beyond the 180-day forecast horizon."]
    texts = column(spark, days, "int", lambda d: labels.forecast_warning(F.lit(90.0), d))
    assert texts[:2] == [None, None] and "indicative trend" in texts[2] and "drops significantly" in texts[4]


def test_report_labels(spark):
    assert column(spark, [0.6, 0.5, -0.5, -0.6], "double", labels.delta_direction) == ["up", "flat", "flat", "down"]
    assert column(spark, [0.3, 0.31, -0.4], "double", lambda d: labels.shown_delta("mean_temperature", d)) == [None, 0.31, -0.4]
    assert column(spark, [1.0, -1.1], "double", labels.shown_yield_delta) == [None, -1.1]
    assert column(spark, [0.1, 0.0, -1.0], "double", labels.contribution_direction) == ["Increases", "Decreases", "Decreases"]
    rice = column(spark, [65.0, 60.0, 30.0, 10.0], "double", lambda p: labels.gauge(F.lit("rice"), p))
    assert [tuple(r) for r in rice] == [(90.0, "high"), (60.0, "high"), (60.0, "middle"), (60.0, "low")]
    assert column(spark, [5.0], "double", lambda p: labels.gauge(F.lit("other"), p)["gauge_max"]) == [100.0]
    assert column(spark, ["user", "nobody"], "string", labels.source_badge)[1] == "—"


def test_numbers_that_are_not_finite_or_huge(spark):
    values = [float("inf"), float("-inf"), float("nan"), 1e20, -0.04, None]
    half = column(spark, values, "double", lambda x: numbers.half_even(x, 2))
    assert half[:2] == values[:2] and half[2] != half[2] and half[3:] == [1e20, -0.04, None]
    shown = column(spark, values, "double", numbers.compact_text)
    assert shown[3:] == ["1" + "0" * 20, "0", None]
