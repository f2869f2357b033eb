import random
import threading

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from harvestline import fixed_values as fv
from harvestline.operators import contributions as ctr, encoding, enrichment as en, modeling as md, requests as rq
from harvestline.plans import evaluation, schema_document, scoring, training
from harvestline.sources import documents

GRID = {"maxIter": [3], "stepSize": [0.3], "maxDepth": [2, 3], "subsamplingRate": [1.0]}


@pytest.fixture(scope="module")
def production(spark):
    pick = random.Random(11)
    rows = []
    for i in range(600):
        crop = ["RICE", "GRAM", "ONION"][i % 3]
        area = float(pick.randint(1, 40))
        made = {"RICE": 20, "GRAM": 5, "ONION": 90}[crop] + area * 0.3 + pick.random()
        rows.append((f"k{i}", crop, ["Goa", "Bihar"][i % 2], "d", ["KHARIF", "RABI"][i % 2], 2000 + i // 200, area, made * area, made))
    return spark.createDataFrame(
        rows,
        "row_key string, crop string, state string, district string, season string, crop_year int, area double, "
        "production double, yield double",
    )


@pytest.fixture(scope="module")
def snapshot(spark):
    rows = [(s, y, "YEAR", 20.0 + y % 5, 900.0, 60.0, None) for s in ("Goa", "Bihar") for y in (2000, 2001)]
    return spark.createDataFrame(rows, "state string, crop_year int, mode string, " + ", ".join(f"{c} double" for c in fv.WEATHER))


@pytest.fixture(scope="module")
def trained(spark, production, snapshot):
    return training.train_job(spark, production, snapshot, None, None, GRID, folds=2)


def test_encoding_by_hand(spark):
    rows = [("b", 1.0), ("a", 3.0), ("b", None), (None, 100.0), ("c", 5.0)]
    df = spark.createDataFrame(rows, "crop string, area double")
    model = encoding.fit_features(df, ["crop"], ["area"])
    # median 4, mode b, mean and deviation of 1, 3, 4, 100, 5
    assert model.names == ["cat__crop_b", "cat__crop_c", "num__area"] and model.width == 3
    filled = [1.0, 3.0, 4.0, 100.0, 5.0]
    mean = sum(filled) / 5
    scale = (sum((v - mean) ** 2 for v in filled) / 5) ** 0.5
    new = spark.createDataFrame([("a", 3.0), ("b", None), (None, 1.0), ("unseen", 5.0), ("c", 5.0)], "crop string, area double")
    out = [r[0] for r in model.transform(new).select(vector_to_array("features")).collect()]
    expected = [(0, 0, 3.0), (1, 0, 4.0), (1, 0, 1.0), (0, 0, 5.0), (0, 1, 5.0)]
    for got, (b, c, value) in zip(out, expected):
        assert got == pytest.approx([b, c, (value - mean) / scale])
    assert model.transform(new).columns == ["crop", "area", "features"]


def test_constant_columns_and_ties(spark):
    df = spark.createDataFrame([("y", 2.0), ("x", 2.0)], "crop string, area double")
    assert encoding.modes(encoding.category_counts(df, ["crop"])).first()["mode"] == "x"
    model = encoding.fit_features(df, ["crop"], ["area"], drop_first=False)
    assert model.names == ["cat__crop_x", "cat__crop_y", "num__area"]
    assert [r[0] for r in model.transform(df).select(vector_to_array("features")).collect()] == [[0.0, 1.0, 0.0], [1.0, 0.0, 0.0]]
    single = encoding.fit_features(df.withColumn("crop", F.lit("x")), ["crop"], ["area"])
    assert single.names == ["num__area"]


def test_quoted_labels(spark):
    df = spark.createDataFrame([("it's", 1.0), ("it's", 2.0), ("back\\slash", 3.0), (None, 4.0)], "crop string, area double")
    model = encoding.fit_features(df, ["crop"], ["area"])
    assert [r[0][0] for r in model.transform(df).select(vector_to_array("features")).collect()] == [1.0, 1.0, 0.0, 1.0]


def test_training(trained, production):
    assert trained.metrics.first()["r2"] > 0.9
    record = trained.metadata.first()
    assert record["training_data"]["n_train"] == 480 and record["training_data"]["n_test"] == 120
    # 2 + 1 + 1 categories after the dropped first ones, and 8 numbers.
    assert record["training_data"]["n_features"] == trained.model.features.width == 12
    assert record["evaluation"]["grid_search_best_score"] == round(max(s for _, s in trained.model.cv_scores), 4)
    assert len(trained.model.cv_scores) == 2 and record["hyperparameters"]["maxIter"] == 3


def test_quality_gate(spark, production, snapshot):
    with pytest.raises(ValueError, match="below the minimum"):
        training.train_job(spark, production, snapshot, None, None, {**GRID, "maxDepth": [1]}, minimum_r2=0.99999)


def test_search_sample_is_bounded_for_copies(spark):
    rows = [(f"k{i}", 1.0 if i % 3 == 0 else float(i)) for i in range(3000)]  # a third of the rows are copies of one row
    matrix = spark.createDataFrame(rows, "_key string, yield double").repartition(3)
    sample = md.search_sample(matrix, 3, 42, 600)
    found = sample.collect()
    assert 560 <= len(found) <= 600 and sample.rdd.getNumPartitions() > 1
    assert 150 < sum(r["yield"] == 1.0 for r in found) < 250
    assert {r["_fold"] for r in found if r["yield"] == 1.0} == {0, 1, 2}
    same = spark.createDataFrame([("k", 1.0)] * 3000, "_key string, yield double")
    assert md.search_sample(same, 3, 42, 600).count() <= 600


def test_all_fits_of_the_search_run_side_by_side(spark, monkeypatch):
    rows = spark.createDataFrame([(f"k{i}", [float(i % 7)], float(i)) for i in range(60)], "row_key string, v array<double>, yield double")
    together = threading.Barrier(24)  # 3 folds, 8 shapes

    class Fitted:
        def evaluateEachIteration(self, held, loss):
            return [1.0] * 100

    def fit(self, df):
        if "_fold" in df.columns:
            together.wait(60)
        return Fitted()

    monkeypatch.setattr(md.GBTRegressor, "fit", fit)
    _, ranked, searched = md.search(rows.select("row_key", array_to_vector("v").alias("features"), "yield"), key="row_key")
    assert len(ranked) == 16 and searched == 60


def test_each_fit_of_the_search_has_its_rows_in_one_partition(spark, monkeypatch):
    rows = spark.createDataFrame([(f"k{i}", [float(i % 7), float(i % 11)], float(i % 7 * 3 + i % 5)) for i in range(300)], "row_key string, v array<double>, yield double")
    matrix = rows.select("row_key", array_to_vector("v").alias("features"), "yield")
    fit, parts = md.GBTRegressor.fit, []

    def counted(self, df):
        if "_fold" in df.columns:
            parts.append(df.rdd.getNumPartitions())
        return fit(self, df)

    monkeypatch.setattr(md.GBTRegressor, "fit", counted)
    grid = {**GRID, "maxIter": [2], "maxDepth": [1, 2]}
    _, ranked, _ = md.search(matrix, grid, 2, key="row_key")
    assert parts == [1] * 4

    # Without a draw of rows the scores are those of a fit over several partitions.
    sample = md.search_sample(matrix.withColumnRenamed("row_key", "_key"), 2, fv.SEED, md.SEARCH_ROWS)
    for settings, found in ranked:
        expected = 0.0
        for fold in range(2):
            held, taught = sample.where(F.col("_fold") == fold), sample.where(F.col("_fold") != fold)
            assert taught.rdd.getNumPartitions() > 1
            trees = md.GBTRegressor(featuresCol="features", labelCol="yield", seed=fv.SEED, **settings)
            error = fit(trees, taught).evaluateEachIteration(held, "squared")[-1]
            expected += (1 - error / held.agg(F.var_pop("yield")).first()[0]) / 2
        assert found == pytest.approx(expected)


def test_search_reads_every_row(spark, monkeypatch):
    n = 12_000
    rows = spark.range(n, numPartitions=6).select(F.concat(F.lit("k"), "id").alias("row_key"), F.array(F.col("id").cast("double")).alias("v"), F.rand(1).alias("yield"))
    taught, held, parts = [], [], []

    class Fitted:
        def evaluateEachIteration(self, df, loss):
            held.append({r["_key"] for r in df.select("_key").collect()})
            return [1.0] * 3

    def fit(self, df):
        if "_fold" in df.columns:
            taught.append({r["_key"] for r in df.select("_key").collect()})
            parts.append(df.rdd.getNumPartitions())
        return Fitted()

    monkeypatch.setattr(md.GBTRegressor, "fit", fit)
    monkeypatch.setattr(md, "FIT_PART_ROWS", 5000)
    monkeypatch.setattr(md, "HELD_ROWS", n)  # one fit at a time
    _, ranked, searched = md.search(rows.select("row_key", array_to_vector("v").alias("features"), "yield"), GRID, 3, key="row_key")
    assert searched == n and len(ranked) == 2 and len(taught) == len(held) == 6
    for t, h in zip(taught, held):
        assert len(t) + len(h) == n and not t & h
    # Each shape has every row held out once, in one of three folds of much the same size.
    assert sorted(len(h) for h in held)[0] > n / 4 and all(sum(k in h for h in held) == 2 for k in ("k0", "k77", "k11999"))
    assert set(parts) <= {2, 3} and max(parts) > 1


def test_record_names_the_search_rows(trained):
    record = trained.metadata.first()
    assert record["evaluation"]["grid_search_rows"] == trained.model.search_rows == record["training_data"]["n_train"]


def test_search_table_and_importance(spark, trained):
    table = md.cv_table(spark, trained.model.cv_scores).orderBy("rank").collect()
    assert [r["rank"] for r in table] == [1, 2] and table[0]["mean_r2"] >= table[1]["mean_r2"]
    top = md.top_importances(spark, trained.model, 3).collect()
    assert len(top) == 3 and top[0]["feature"].startswith("cat__crop_")
    assert sum(r["importance"] for r in md.importances(spark, trained.model).collect()) == pytest.approx(1.0)


def test_save_and_load(trained, production, snapshot, fresh):
    path = fresh()
    trained.model.save(path)
    loaded = md.YieldModel.load(path, trained.model.features)
    rows = en.enrich_all(production, snapshot)
    before = {r["row_key"]: r["prediction"] for r in md.score(rows, trained.model).collect()}
    after = {r["row_key"]: r["prediction"] for r in md.score(rows, loaded).collect()}
    assert before == after and len(before) == 600


def test_feature_counts(trained, production, snapshot):
    counts = md.feature_counts(en.enrich_all(production, snapshot), trained.model).first()
    assert counts["all_match"] and counts["model_features"] == 12


def test_evaluation_record(spark, trained, production, snapshot, fresh):
    result = evaluation.evaluate_job(spark, trained.model, production, snapshot, None, None, "2005-01-01")
    assert result.overall.first()["n"] == 120
    assert [r["crop"] for r in result.per_crop.collect()] == ["GRAM", "ONION", "RICE"]
    base = fresh()
    documents.write_document(trained.metadata, documents.next_version(spark, base))
    merged = documents.read_document(spark, evaluation.merge_record(spark, base, result.record)).first()
    assert merged["model_type"] == "GBTRegressor" and merged["evaluation"]["n_test"] == 120
    assert [c["crop"] for c in merged["evaluation"]["per_crop"]] == ["GRAM", "ONION", "RICE"]
    assert merged["evaluation"]["weather_period"] == "2004-01-02 to 2005-01-01"
    alone = documents.read_document(spark, evaluation.merge_record(spark, fresh(), result.record)).first()
    assert alone["evaluation"]["features"]["total_input"] == 11


def test_schema_document(spark, production, snapshot):
    rows = en.enrich_all(production, snapshot).fillna({"mean_solar_radiation": 15.0})
    model, document = schema_document.fit_schema(rows)
    found = document.first()
    assert found["n_training_samples"] == 400 and found["unique_crop"] == ["GRAM", "ONION", "RICE"]
    assert found["unique_crop_year"] == [2000, 2001] and found["n_output_features"] == 3 + 2 + 2 + 8 == model.width
    assert found["output_feature_names"][0] == "cat__crop_GRAM" and found["feature_columns"] == fv.FEATURES
    assert found["stats_area"]["min"] >= 1.0 and found["crop_column"] == "crop"


def test_contributions_add_up(spark, trained, production, snapshot):
    rows = en.enrich_all(production, snapshot)
    asked = rows.limit(6).withColumnRenamed("row_key", "request_id")
    points = ctr.background(trained.model.features.transform(rows), k=3)
    assert sum(w for _, w in points) == pytest.approx(1.0) and len(points) == 3
    found = ctr.contributions(asked, trained.model, points, orders=3)
    scores = {r["request_id"]: r["prediction"] for r in md.score(asked, trained.model).collect()}
    sums = {r["request_id"]: r for r in ctr.breakdown(found).collect()}
    assert set(sums) == set(scores)
    for key, row in sums.items():
        assert row["prediction"] == pytest.approx(scores[key])
    assert len({round(r["baseline"], 9) for r in sums.values()}) == 1
    report = ctr.contribution_report(found, n=4).collect()
    assert len(report) == 24 and {r["rank"] for r in report} == {1, 2, 3, 4}
    table = ctr.background_table(spark, points, trained.model.features.names)
    assert table.count() == 36


def test_contributions_come_with_their_spread(spark, trained, production, snapshot):
    rows = en.enrich_all(production, snapshot)
    asked = rows.limit(4).withColumnRenamed("row_key", "request_id")
    points = ctr.background(trained.model.features.transform(rows), k=2)
    found = ctr.contributions(asked, trained.model, points).collect()
    assert ctr.ORDERS >= 16 and all(r["spread"] is not None and r["spread"] >= 0 for r in found)
    two = ctr.contributions(asked, trained.model, points, orders=2).collect()
    exact = {(r["request_id"], r["feature"]): r for r in found}
    assert any(r["spread"] > 0 for r in two)
    far = lambda r: abs(r["contribution"] - exact[r["request_id"], r["feature"]]["contribution"])
    assert all(far(r) < 1e-9 for r in two if r["spread"] == 0 and exact[r["request_id"], r["feature"]]["spread"] == 0)
    report = ctr.contribution_report(ctr.contributions(asked, trained.model, points), n=3).collect()
    assert all(r["spread"] is not None for r in report)


REQUESTS = (
    "request_id int, crop string, state string, season string, crop_year int, area double, irrigation_pct double, "
    "npk_kg_per_ha double, use_forecast boolean"
)
ASKED = [
    (1, "rice", "GOA", "rabi", 2000, 2.0, None, None, False),
    (2, "RICE", "Goa", "RABI", 2000, None, 50.0, 100.0, True),
    (3, "KALE", "Mars", "MONSOON", 1996, 0.05, 101.0, -1.0, False),
    (4, None, "Goa", "RABI", 2000, float("nan"), None, None, False),
]


@pytest.fixture
def world(spark, production, snapshot):
    known = rq.request_domains(production)
    inputs = en.match_inputs(known.state.select(F.col("_state").alias("state")), None, None)
    ahead = spark.createDataFrame(
        [("Goa", "RABI", 35.0, 100.0, 10.0, 10.0, "low", "careful")],
        "state string, season string, " + ", ".join(f"{c} double" for c in fv.WEATHER) + ", forecast_confidence string, warning string",
    )
    return known, snapshot, ahead, inputs


def test_validation(spark, world):
    checked = {r["request_id"]: r for r in rq.validate_requests(spark.createDataFrame(ASKED, REQUESTS), world[0]).collect()}
    assert (checked[1]["crop"], checked[1]["state"], checked[1]["season"], checked[1]["valid"]) == ("RICE", "Goa", "RABI", True)
    assert checked[2]["area"] == 1.0 and checked[2]["valid"]
    assert len(checked[3]["errors"]) == 7 and checked[3]["errors"][0] == "Unknown crop 'KALE'."
    assert checked[4]["errors"] == ["Unknown crop ''.", "area must be between 0.1 and 10000.0"]


def test_scoring(spark, trained, world):
    known, snapshot, ahead, inputs = world
    out = {r["request_id"]: r for r in scoring.score_requests(spark.createDataFrame(ASKED, REQUESTS), trained.model, known, snapshot, ahead, inputs).collect()}
    assert set(out) == {1, 2}
    plain, forecast = out[1], out[2]
    assert (plain["weather_source"], plain["historical_yield"], plain["irrigation_source"], plain["irrigation_pct"]) == ("historical", None, "state-avg", 40.0)
    assert (forecast["weather_source"], forecast["mean_temperature"], forecast["forecast_confidence"]) == ("forecast", 35.0, "low")
    assert (forecast["irrigation_pct"], forecast["npk_source"], forecast["forecast_warning"]) == (50.0, "user", "careful")
    assert forecast["yield_delta"] == pytest.approx(forecast["predicted_yield"] - forecast["historical_yield"], abs=2e-4)
    assert plain["gauge_max"] == 60.0 and plain["unit"] == "Quintal/Hectare"


def test_negative_predictions_become_zero(spark):
    columns = {
        "request_id": 1, "crop": "RICE", "state": "Goa", "season": "RABI", "crop_year": 2000, "area": 1.0, "weather_source": "forecast",
        **{c: 1.0 for c in fv.WEATHER}, fv.IRRIGATION: 1.0, "irrigation_source": "user", fv.FERTILIZER: 1.0, "npk_source": "user",
        "use_forecast": True, "has_history": True, "predicted": -3.0, "predicted_hist": -1.0,
    }
    row = scoring.responses(spark.createDataFrame([columns])).first()
    assert (row["predicted_yield"], row["historical_yield"], row["yield_delta"]) == (0.0, 0.0, 0.0)
    assert row["model_version"] == fv.MODEL_VERSION
    missing = scoring.responses(spark.createDataFrame([columns | {"has_history": False}]), "7.1").first()
    assert (missing["predicted_yield"], missing["historical_yield"], missing["yield_delta"], missing["model_version"]) == (0.0, None, None, "7.1")


def test_stream_gives_the_batch_result(spark, trained, world, fresh):
    from harvestline.streaming import jobs

    known, snapshot, ahead, inputs = world
    landed = fresh("landed")
    requests = spark.createDataFrame(ASKED, REQUESTS)
    requests.repartition(3).write.parquet(landed)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    good, bad = jobs.scored_stream(stream, trained.model, known, snapshot, ahead, inputs)
    out, rejected = fresh("out"), fresh("rejected")
    jobs.drain(good, out, fresh("progress"))
    jobs.drain(bad, rejected, fresh("progress"))
    batch = scoring.score_requests(requests, trained.model, known, snapshot, ahead, inputs)
    assert sorted(spark.read.schema(good.schema).parquet(out).collect()) == sorted(batch.collect())
    assert {r["request_id"] for r in spark.read.parquet(rejected).collect()} == {3, 4}


def test_latest_weather_stream(spark, fresh):
    import json
    import os

    from harvestline.sources import snapshots
    from harvestline.streaming import jobs

    base, landed, progress = fresh("snapshot"), fresh("landed"), fresh("progress")
    os.makedirs(landed)

    def land(name, temperature):
        payload = {"properties": {"parameter": {"T2M": {"20050101": temperature, "20040101": 99.0, "20030101": 5.0}}}}
        with open(f"{landed}/{name}.json", "w") as f:
            f.write(json.dumps({"state": "Goa", "payload": json.dumps(payload)}))

    def run():
        stream = spark.readStream.schema("state string, payload string").json(landed)
        jobs.refresh_latest(stream, base, "2005-01-01", progress)
        return [(r["state"], r["mode"], r["mean_temperature"]) for r in snapshots.load_snapshot(spark, base).collect()]

    land("a", 21.0)
    # 2004 is a leap year, so its first day is 366 days before the end of the period.
    assert run() == [("Goa", "LATEST", 21.0)]
    land("b", 25.0)
    assert run() == [("Goa", "LATEST", 25.0)]
