import hashlib
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harvestline.operators import insights as ins, metrics as mt
from harvestline.operators.quantiles import exact_quantiles
from harvestline.operators.splitting import split, split_sizes

PROBABILITIES = {"lo": 0.0, "a": 0.1, "b": 0.25, "c": 0.5, "d": 0.999, "hi": 1.0}


def numbers(seed, n):
    pick = random.Random(seed)
    # A third of the rows in one group and many repeated values.
    return [("hot" if i % 3 == 0 else f"g{i % 5}", float(pick.choice([pick.randint(0, 50), pick.lognormvariate(3, 2)]))) for i in range(n)]


@pytest.mark.parametrize("accuracy", [10_000, 100, 250])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_are_exact(spark, accuracy, by):
    rows = numbers(3, 9000) + [("tiny", 5.0), ("tiny", None), ("pair", 1.0), ("pair", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = exact_quantiles(df, "v", PROBABILITIES, by, accuracy).collect()
    frame = pd.DataFrame(rows, columns=["g", "v"]).dropna()
    groups = dict(list(frame.groupby("g")["v"])) if by else {None: frame["v"]}
    assert len(found) == len(groups)
    for row in found:
        values = groups[row["g"] if by else None].to_numpy()
        assert row["n"] == len(values)
        for name, p in PROBABILITIES.items():
            assert row[name] == pytest.approx(np.quantile(values, p), rel=1e-12), (row, name)


@pytest.mark.parametrize("most", [1, 40])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_by_refinement(spark, by, most):
    rows = numbers(8, 4000) + [("tiny", 5.0), ("pair", 1.0), ("pair", 2.0), ("ends", float("inf")), ("ends", float("-inf")), ("ends", 0.0)]
    rows += [("ties", 1.0), ("ties", 3.0)] + [("ties", 2.0)] * 700 + [(None, float(i % 97)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    groups = {}
    for g, v in rows:
        groups.setdefault(g if by else None, []).append(v)
    for row in exact_quantiles(df, "v", PROBABILITIES, by, most=most).collect():
        values = sorted(groups[row["g"] if by else None])
        for name, p in PROBABILITIES.items():
            at = p * (len(values) - 1)
            low, high = values[math.floor(at)], values[math.ceil(at)]
            want = low if low == high else low + (high - low) * (at - math.floor(at))
            assert row[name] == pytest.approx(want, rel=1e-12, nan_ok=True), (row, name)


def test_ten_million_values_are_never_ordered_in_one_task(spark, monkeypatch):
    """Every window of the job sees at most `MOST` rows of a group."""
    from harvestline.operators import quantiles

    n = 10_000_000
    df = spark.range(n, numPartitions=16).select(((F.col("id") * 7_919_003) % n).cast("double").alias("v"), (F.col("id") % 3).alias("g"))
    kept, sizes = quantiles._inside, []

    def watched(data, brackets, by):
        rows = kept(data, brackets, by)
        inside = rows.where("_v >= low").groupBy(*by, "low", "high").agg(F.countDistinct("_v").alias("count"))
        sizes.append(inside.agg(F.max("count")).first()[0] or 0)
        return rows

    monkeypatch.setattr(quantiles, "_inside", watched)
    found = exact_quantiles(df, "v", {"a": 0.25, "b": 0.5}).first()
    assert (found["a"], found["b"], found["n"]) == (0.25 * (n - 1), 0.5 * (n - 1), n)
    # 10 million values in all, then a bracket that is counted, then one that is put in order.
    assert n > sizes[0] > quantiles.MOST >= sizes[-1] and len(sizes) == 2


def test_quantiles_keep_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, v double")
    found = {r["g"]: r["m"] for r in exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert found == {None: 2.0, "a": 2.0}


@pytest.mark.parametrize("digits", [1, 3])
@pytest.mark.parametrize("strata", [[], ["g"]])
def test_split_matches_a_full_sort(spark, strata, digits):
    rows = [(f"k{i}", g) for i, (g, _) in enumerate(numbers(5, 3001))] + [("alone", "single"), ("p1", "pair"), ("p2", "pair"), ("n1", None)]
    df = spark.createDataFrame(rows, "key string, g string").repartition(7)
    found = {r["key"]: r["split"] for r in split(df, "key", strata, prefix_digits=digits).collect()}
    groups = {}
    for key, g in rows:
        groups.setdefault(g if strata else None, []).append((hashlib.md5(f"42:{key}".encode()).hexdigest(), key))
    expected = {}
    for members in groups.values():
        n_test = math.ceil(0.2 * len(members)) if len(members) >= 2 else 0
        for rank, (_, key) in enumerate(sorted(members)):
            expected[key] = "test" if rank < n_test else "train"
    assert found == expected
    sizes = {r["split"]: r["n"] for r in split_sizes(split(df, "key", strata)).collect()}
    assert sizes == Counter(expected.values())


def test_split_depends_on_the_seed_only(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("key"))
    once, again = (sorted(split(df.repartition(n), "key").collect()) for n in (2, 9))
    assert once == again
    assert sorted(split(df, "key", seed=7).collect()) != once


def test_metrics(spark):
    rows = [("a", 1.0, 2.0), ("a", 3.0, 3.0), ("a", 0.0, 1.0), ("b", 1.0, 1.0), ("c", 2.0, 2.0), ("c", 2.0, 2.0), ("d", 2.0, 1.0), ("d", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "crop string, y_true double, y_pred double")
    found = {r["crop"]: r for r in mt.regression_metrics(df, ["crop"]).collect()}
    a = found["a"]
    assert (a["n"], a["rmse"], a["mae"]) == (3, round(math.sqrt(2 / 3), 4), round(2 / 3, 4))
    assert a["r2"] == round(1 - 2 / (14 / 3), 4) and a["mape"] == 50.0
    assert tuple(found["b"])[1:] == (1, None, None, None, None)
    assert found["c"]["r2"] == 1.0 and found["d"]["r2"] == 0.0
    with pytest.raises(ValueError, match="below"):
        mt.check_quality(mt.regression_metrics(df), 0.99)
    assert mt.check_quality(mt.regression_metrics(df), -9) <= 1
    none = mt.regression_metrics(df.where("y_true < 0.01").union(df.where("y_true < 0.01"))).first()
    assert none["mape"] == 0.0


def test_prediction_range(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 2.0)], "y_true double, y_pred double")
    assert tuple(mt.prediction_range(df).first()) == (0.0, 10.0, -0.5, 10.5)
    assert sorted(r["residual"] for r in mt.residuals(df).collect()) == [-8.0, 5.0]
    assert sum(r["n"] for r in mt.residual_histogram(df).collect()) == 2


def test_histogram(spark):
    values = [v for _, v in numbers(9, 500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    rows = {r["bin"]: r["n"] for r in ins.histogram(df, "v", 20).collect()}
    assert sum(rows.values()) == 500 and max(rows) == 19
    low, high = min(values), max(values)
    assert rows == Counter(min(19, math.floor((v - low) / (high - low) * 20)) for v in values)
    constant = ins.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v").collect()
    assert [(r["bin"], r["n"]) for r in constant] == [(0, 2)]


def test_correlations(spark):
    pick = random.Random(1)
    rows = [(pick.random(), None if i % 4 == 0 else pick.random(), float(i), 1.0) for i in range(100)]
    frame = pd.DataFrame(rows, columns=list("abcd"))
    found = {(r["x"], r["y"]): r["corr"] for r in ins.correlations(spark.createDataFrame(rows, "a double, b double, c double, d double")).collect()}
    expected = frame.corr()
    for x in "abcd":
        for y in "abcd":
            want = expected.loc[x, y]
            assert found[x, y] is None or math.isnan(found[x, y]) if math.isnan(want) else found[x, y] == pytest.approx(want)


def test_reports(spark):
    rows = [(c, s, y, v) for i, (c, s, y, v) in enumerate([("B", "x", 2000, 4.0), ("A", "y", 2001, 2.0), ("A", "x", 2000, 4.0), ("C", "z", 2001, 9.0)])]
    df = spark.createDataFrame(rows, "crop string, state string, crop_year int, yield double")
    assert [tuple(r) for r in ins.mean_target_ascending(df).collect()] == [("A", 3.0), ("B", 4.0), ("C", 9.0)]
    assert [tuple(r) for r in ins.top_groups(df, n=2).collect()] == [("x", 4.0), ("z", 9.0)]
    assert [tuple(r) for r in ins.trend(df).collect()] == [(2000, 4.0), (2001, 5.5)]
    assert tuple(ins.profile(df).first()) == (4, 3, 2000, 2001, 3)
    assert ins.filter_crops(df, ["A"]).count() == 2 and ins.filter_crops(df, ins.default_crops(df, n=2)).count() == 3
    assert [r["total_rows"] for r in ins.preview(df, ["yield", "crop"], 2).collect()] == [4, 4]
    assert [r["value"] for r in ins.domains(df, ["crop"]).collect()] == ["A", "B", "C"]
    assert ins.scatter_points(df, "crop_year", fraction=0.5).count() <= 4


def test_first_value(spark):
    rows = [("a", None, 1), ("a", 3.0, 2), ("a", 1.0, 3), ("b", 2.0, 9), ("b", 2.0, 1), ("c", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, o int")
    assert [tuple(r) for r in ins.first_value(df, "g", "v", "o").collect()] == [("b", 2.0), ("a", 3.0)]


def test_describe(spark):
    values = pd.DataFrame({"a": [v for _, v in numbers(2, 200)], "b": [float(i) for i in range(200)]})
    found = {r["feature"]: r for r in ins.describe(spark.createDataFrame(values)).collect()}
    for name, want in values.describe().items():
        got = found[name]
        assert [got[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(list(want))


def test_correlations_of_many_parts_far_from_zero(spark):
    """Sums of parts about different means are merged without loss; constant and empty columns have none."""
    pick = random.Random(9)
    rows = []
    for i in range(3000):
        a = 1e9 + pick.random() + i / 1000
        rows.append((a if i % 7 else None, 1e9 - a + pick.random() if i % 5 else float("nan"), 0.1, None, float(i // 500)))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartitionByRange(9, "e")
    found = {(r["x"], r["y"]): r["corr"] for r in ins.correlations(df).collect()}
    expected = pd.DataFrame(rows, columns=list("abcde")).astype(float).corr()
    assert len(found) == 25
    for (x, y), value in found.items():
        if "c" in (x, y) or "d" in (x, y):
            assert value is None
        else:
            assert value == pytest.approx(expected.loc[x, y], abs=1e-6), (x, y)


@pytest.mark.parametrize("strata", [[], ["g"]])
def test_split_descends_until_few_rows_are_ranked(spark, strata, monkeypatch):
    from harvestline.operators import splitting

    rows = [(f"k{i}", "a" if i % 3 else "b") for i in range(4000)] + [("alone", None)]
    df = spark.createDataFrame(rows, "key string, g string").repartition(5)
    want = sorted(split(df, "key", strata).collect())
    steps, beside = [], splitting._beside
    monkeypatch.setattr(splitting, "_beside", lambda rows, edges, strata, digits: steps.append(digits) or beside(rows, edges, strata, digits))
    assert sorted(split(df, "key", strata, prefix_digits=1, most=1).collect()) == want
    assert steps[:4] == [0, 1, 2, 3] and steps[-1] <= 5


def test_split_counts_few_prefixes_at_first(spark, monkeypatch):
    from harvestline.operators import splitting

    df = spark.range(20_000).selectExpr("cast(id as string) AS key", "cast(id % 2 as string) AS g")
    kept, store = {}, splitting.stored
    monkeypatch.setattr(splitting, "stored", lambda rows, name: kept.setdefault(name, store(rows, name)))
    sizes = {r["split"]: r["n"] for r in split_sizes(split(df, "key", ["g"])).collect()}
    # Far fewer counts than rows, so that tasks shuffle counts and not rows.
    assert sizes == {"train": 16_000, "test": 4_000} and kept["split-prefixes"].count() <= 2 * 4096
