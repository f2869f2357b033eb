import json
import os

import pytest
from pyspark.sql import functions as F

from harvestline import fixed_values as fv
from harvestline.operators.weather import weather_snapshot
from harvestline.sources import documents, files, payloads, snapshots, versions


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_dimension_csv(spark, fresh):
    path = write(fresh() + "/d.csv", " State , Irrigation_Coverage_Pct\n Goa ,10\nPunjab,98.5\nGoa,12\n")
    rows = files.read_dimension(spark, path, fv.IRRIGATION).orderBy("ord").collect()
    assert [(r["state"], r[fv.IRRIGATION]) for r in rows] == [("Goa", 12.0), ("Punjab", 98.5)]


def test_dimension_of_several_files_keeps_their_order(spark, fresh):
    folder = fresh()
    for name, size in (("a", 1), ("b", 4000), ("c", 400)):  # larger files are read first
        write(f"{folder}/{name}.csv", "state,irrigation_coverage_pct\n" + "".join(f"{name}{i},{i}\n" for i in range(size)) + f"Goa,{size}\n")
    rows = files.read_dimension(spark, folder, fv.IRRIGATION).orderBy("ord").collect()
    assert [r["state"] for r in rows] == ["a0", "Goa", *[f"b{i}" for i in range(4000)], *[f"c{i}" for i in range(400)]]
    assert rows[1][fv.IRRIGATION] == 400


@pytest.mark.parametrize("content", [None, "state,other\nGoa,1\n", "state,irrigation_coverage_pct\nGoa,many\n"])
def test_unusable_dimension_is_empty(spark, fresh, content):
    path = fresh() + "/d.csv"
    if content:
        write(path, content)
    empty = files.read_dimension(spark, path, fv.IRRIGATION)
    assert empty.columns == ["state", fv.IRRIGATION, "ord"] and empty.isEmpty()


def test_first_source(spark, fresh):
    path = write(fresh() + "/a.csv", "Crop,Yield\nRICE,2\n")
    assert files.first_source(spark, [fresh(), path]).collect()[0]["Crop"] == "RICE"
    with pytest.raises(FileNotFoundError):
        files.first_source(spark, [fresh()])


def test_first_suitable_source(spark, fresh):
    from harvestline.operators.shaping import clean_columns

    short = write(fresh() + "/short.csv", "a,yield\n" + "1,2\n" * 5)
    lacking = write(fresh() + "/lacking.csv", "b,yield\n" + "1,2\n" * 9)
    good = write(fresh() + "/good.csv", "A,Yield (q)\n" + "1,2\n" * 6)
    found, path = files.first_suitable_source(spark, [fresh(), short, lacking, good], clean_columns, ["a", "yield"])
    assert path == good and found.count() == 6
    assert files.first_suitable_source(spark, [short], clean_columns, ["a", "yield"]) is None


def test_splits_round_trip(spark, fresh):
    df = spark.createDataFrame([("RICE", 1.5, "train"), ("GRAM", 2.5, "test")], "crop string, yield double, split string")
    path = fresh()
    files.write_splits(df, path)
    assert files.read_split(spark, path, "test", "crop string, yield double").collect() == [("GRAM", 2.5)]
    stored = fresh() + "/t.parquet"
    files.write_table(df, stored, "parquet")
    assert files.read_table(spark, stored).count() == 2


def test_documents_keep_versions(spark, fresh):
    base = fresh()
    assert documents.latest_version(spark, base) is None
    for n in (1, 2):
        documents.write_document(spark.range(1).select(F.lit(n).alias("n")), documents.next_version(spark, base))
    latest = documents.latest_version(spark, base)
    assert latest.endswith("version=2") and documents.read_document(spark, latest).first()["n"] == 2
    os.makedirs(f"{base}/version=3")  # not finished
    assert documents.latest_version(spark, base) == latest


def row(spark, state, year, temperature, at):
    values = [(state, year, temperature, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(values, "state string, crop_year int, " + ", ".join(f"{c} double" for c in fv.WEATHER))
    return weather_snapshot(df, None, at)


def test_snapshot_upsert(spark, fresh):
    base = fresh()
    assert snapshots.load_snapshot(spark, base).isEmpty()
    snapshots.upsert_snapshot(spark, base, row(spark, "Goa", 2000, 20.0, "2001-01-01").unionByName(row(spark, "Goa", 2001, 21.0, "2001-01-01")))
    newer = snapshots.upsert_snapshot(spark, base, row(spark, "Goa", 2000, 22.0, "2001-02-01"))
    found = {r["crop_year"]: r["mean_temperature"] for r in newer.collect()}
    assert found == {2000: 22.0, 2001: 21.0}
    older = snapshots.upsert_snapshot(spark, base, row(spark, "Goa", 2000, 5.0, "1999-01-01"))
    assert {r["crop_year"]: r["mean_temperature"] for r in older.collect()} == found
    forced = snapshots.upsert_snapshot(spark, base, row(spark, "Goa", 2000, 5.0, "1999-01-01"), force=True)
    assert {r["crop_year"]: r["mean_temperature"] for r in forced.collect()}[2000] == 5.0


def land(spark, fresh, documents_):
    path = write(fresh() + "/p.json", "\n".join(json.dumps({"state": s, "payload": json.dumps(p)}) for s, p in documents_))
    return payloads.read_payloads(spark, path)


def test_daily_payload(spark, fresh):
    parameter = {"T2M": {"20050101": 21.4, "20050102": None}, "RH2M": {"20050101": -999}}
    rows = payloads.daily_observations(land(spark, fresh, [("Goa", {"properties": {"parameter": parameter}}), ("Bihar", {})]))
    found = {(r["state"], str(r["obs_date"]), r["param"]): r["val"] for r in rows.collect()}
    assert found == {
        ("Goa", "2005-01-01", "T2M"): 21.4,
        ("Goa", "2005-01-02", "T2M"): None,
        ("Goa", "2005-01-01", "RH2M"): -999.0,
    }


def test_forecast_payload(spark, fresh):
    six = {"time": ["2005-01-01T00:00Z", "bad", "2005-01-01T12:00"], "temperature_2m": [1.0, 2.0], "precipitation": [0.1, None, 0.3]}
    hourly = {"time": ["2005-01-01T00:00"], "temperature_2m": [9.0, 8.0]}
    rows = payloads.forecast_points(land(spark, fresh, [("A", {"six_hourly": six, "hourly": hourly}), ("B", {"hourly": hourly})]))
    found = sorted((r["state"], r["pos"], r["ts"] is not None, r["temperature_2m"], r["precipitation"], r["relative_humidity_2m"]) for r in rows.collect())
    assert found == [
        ("A", 0, True, 1.0, 0.1, None), ("A", 1, False, 2.0, None, None), ("A", 2, True, None, 0.3, None), ("B", 0, True, 9.0, None, None),
    ]
    with pytest.raises(Exception, match="neither"):
        payloads.forecast_points(land(spark, fresh, [("C", {"daily": {}})])).collect()


def test_saves_go_on_after_an_interrupted_one(spark, fresh):
    import os

    base = fresh("snapshots")
    rows = spark.createDataFrame([("a", 2000, "YEAR", 1.0)], "state string, crop_year int, mode string, mean_temperature double")
    rows = rows.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' AS cached_at")
    full = snapshots.load_snapshot(spark, base).unionByName(rows, allowMissingColumns=True)
    os.makedirs(f"{base}/version=1")  # no _SUCCESS: a write that was cut off
    assert snapshots.load_snapshot(spark, base).count() == 0
    assert snapshots.save_snapshot(full, base).endswith("version=2")
    os.makedirs(f"{base}/version=3")
    assert snapshots.upsert_snapshot(spark, base, full).count() == 1
    assert os.path.exists(f"{base}/version=4/_SUCCESS")


def test_two_writers_that_interleave_keep_both_rows(spark, fresh, monkeypatch):
    """The slower writer has read its base when the faster publishes; its rename fails and it merges again."""
    base, merges = fresh("raced"), []
    snapshots.upsert_snapshot(spark, base, row(spark, "Goa", 2000, 20.0, "2001-01-01"))
    merge = snapshots.merge_snapshot

    def interrupted(current, *args, **kwargs):
        merges.append(current.count())
        if len(merges) == 1:
            snapshots.upsert_snapshot(spark, base, row(spark, "Bihar", 2000, 21.0, "2001-01-01"))
        return merge(current, *args, **kwargs)

    monkeypatch.setattr(snapshots, "merge_snapshot", interrupted)
    after = snapshots.upsert_snapshot(spark, base, row(spark, "Kerala", 2000, 22.0, "2001-01-01"))
    assert sorted(r["state"] for r in after.collect()) == ["Bihar", "Goa", "Kerala"]
    assert merges == [1, 1, 2]  # the slow one on the old base, the fast one, the slow one on the new base
    assert sorted(os.listdir(base)) == ["version=1", "version=2", "version=3"]


def test_many_writers_lose_no_row(spark, fresh):
    from concurrent.futures import ThreadPoolExecutor

    base = fresh("crowd")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: snapshots.upsert_snapshot(spark, base, row(spark, f"S{i}", 2000, 1.0 * i, "2001-01-01")), range(6)))
    assert sorted(r["state"] for r in snapshots.load_snapshot(spark, base).collect()) == [f"S{i}" for i in range(6)]
    assert sorted(os.listdir(base)) == [f"version={i}" for i in range(1, 7)]


def test_a_rename_never_replaces(spark, fresh):
    base = fresh("rename")
    for name in ("a", "b"):
        spark.range(1).write.parquet(f"{base}/{name}")
    assert versions.rename_new(spark, f"{base}/a", f"{base}/c") and not versions.rename_new(spark, f"{base}/b", f"{base}/c")
    assert sorted(os.listdir(base)) == ["b", "c"] and "b" not in os.listdir(f"{base}/c")
    with pytest.raises(versions.LostRace):
        versions.publish(spark, base, lambda _: spark.range(1), attempts=0)
