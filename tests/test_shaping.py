import pytest
from pyspark.sql import functions as F

from harvestline import fixed_values as fv
from harvestline.operators import shaping


def empty(spark, *names):
    return spark.createDataFrame([], ", ".join(f"`{n}` double" for n in names))


def test_clean_columns(spark):
    raw = empty(spark, " Crop Name ", "CostOf Seed", "Yield (q/ha)", "yield_old", "Production", "DISTRICT", "N--P__K!")
    assert shaping.clean_columns(raw).columns == ["crop_name", "cost_of_seed", "yield", "yield_old", "n_p_k"]


def test_clean_columns_needs_a_target(spark):
    with pytest.raises(KeyError):
        shaping.clean_columns(empty(spark, "Crop"))
    assert shaping.clean_columns(empty(spark, "Crop"), strict=False).columns == ["crop"]
    with pytest.raises(ValueError, match="same name"):
        shaping.clean_columns(empty(spark, "A b", "a_b", "yield"))


def test_guards(spark):
    with pytest.raises(ValueError, match="missing"):
        shaping.check_no_leakage(empty(spark, "crop"))
    with pytest.raises(ValueError, match="production"):
        shaping.check_no_leakage(empty(spark, "yield", "production"))
    assert shaping.missing_columns(empty(spark, *fv.FEATURES[1:])) == ["crop"]
    with pytest.raises(ValueError, match="crop"):
        shaping.require_columns(empty(spark, *fv.FEATURES[1:]))


def test_projection_fills_absent_columns(spark):
    df = spark.createDataFrame([("RICE", 2.0)], "crop string, area double")
    out = shaping.project_features(df)
    assert out.columns == fv.FEATURES
    assert out.first().asDict() == {**dict.fromkeys(fv.FEATURES), "crop": "RICE", "area": 2.0}


def test_numeric_columns(spark):
    df = spark.createDataFrame([], "a string, b int, c double, d date")
    assert shaping.numeric_columns(df) == ["b", "c"]


def test_complete_rows(spark):
    df = spark.range(12).select(F.when(F.col("id") > 1, F.col("id")).alias("a"), F.lit(1).alias("b"))
    rows, counts = shaping.complete_rows(df, ["a", "b", "absent"])
    assert rows.count() == 10 and counts == {"n_rows": 12, "kept": 10, "dropped": 2}
    with pytest.raises(ValueError, match="complete rows"):
        shaping.complete_rows(df.limit(5), ["a"])


def test_input_summary(spark):
    values = {**{c: "x" for c in fv.CATEGORICAL}, "crop_year": 2010, **{c: 2.04 for c in fv.NUMERICAL[1:]}}
    df = spark.createDataFrame([values]).select(
        F.lit(1).alias("request_id"), *fv.FEATURES, F.lit("user").alias("irrigation_source"),
        F.lit("state-avg").alias("npk_source"), F.lit("forecast").alias("weather_source"),
    )
    rows = {r["feature"]: (r["value"], r["source"]) for r in shaping.input_summary(df).collect()}
    assert len(rows) == 11 and rows["crop_year"] == ("2010", "user") and rows["area"] == ("2", "user")
    assert rows[fv.IRRIGATION][1] == "user" and rows[fv.FERTILIZER][1] == "state-avg"
    assert rows["mean_temperature"][1] == "forecast"
