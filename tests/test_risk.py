import random

import pytest
from pyspark.sql import functions as F

from harvestline import fixed_values as fv
from harvestline.operators import risk

SCHEMA = "state string, " + ", ".join(f"{c} double" for c in fv.WEATHER)
NORMS = {"mean_temperature": 25.0, "total_precipitation": 1000.0, "mean_relative_humidity": 60.0, "mean_solar_radiation": 0.0}
OPERATIONS = {"<": lambda a, b: a < b, ">": lambda a, b: a > b}


def plain(weather, rules=fv.RISK_RULES):
    """Level and alert numbers by definition."""
    fired = [(i, r) for i, r in enumerate(rules, 1) if weather[r[0]] is not None and OPERATIONS[r[1]](weather[r[0]], r[2])]
    best = {}
    for i, r in fired:
        kept = best.get(r[4])
        if kept is None or fv.LEVEL_SEVERITY[r[3]] > fv.LEVEL_SEVERITY[kept[1][3]]:
            best[r[4]] = (i, r)
    chosen = sorted(best.values(), key=lambda b: -fv.LEVEL_SEVERITY[b[1][3]])
    return (chosen[0][1][3] if chosen else "OPTIMAL"), [i for i, _ in chosen], [i for i, _ in fired]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def norms(spark):
    return spark.createDataFrame([tuple(NORMS[c] for c in fv.WEATHER)], ", ".join(f"{c} double" for c in fv.WEATHER))


def test_random_weather_against_definition(spark):
    pick = random.Random(7)
    ranges = {"mean_temperature": (12, 34), "total_precipitation": (200, 3000), "mean_relative_humidity": (25, 70), "mean_solar_radiation": (10, 20)}
    rows = []
    for n in range(300):
        rows.append((f"s{n}", *[None if pick.random() < 0.1 else float(pick.randint(*ranges[c])) for c in fv.WEATHER]))
    weather = frame(spark, rows)
    assessed = {r["state"]: r for r in risk.assess(weather, norms(spark)).collect()}
    fired = {}
    for r in risk.fired_rules(weather, norms(spark)).collect():
        fired.setdefault(r["state"], []).append(r["rule_ord"])
    by_table = {}
    for r in risk.fired_by_table(weather, risk.rule_table(spark)).collect():
        by_table.setdefault(r["state"], []).append(r["rule_ord"])
    for row in rows:
        level, chosen, numbers = plain(dict(zip(fv.WEATHER, row[1:])))
        found = assessed[row[0]]
        assert (found["overall_risk"], [a["rule_ord"] for a in found["alerts"]]) == (level, chosen)
        assert sorted(fired.get(row[0], [])) == numbers == sorted(by_table.get(row[0], []))


def one(spark, temperature=None, rain=None, humidity=None, solar=None, with_norms=True):
    weather = frame(spark, [("Goa", temperature, rain, humidity, solar)])
    return risk.assess(weather, norms(spark) if with_norms else None)


def test_thresholds_are_strict(spark):
    assert one(spark, rain=400.0).first()["overall_risk"] == "HIGH"
    assert one(spark, rain=399.9).first()["overall_risk"] == "CRITICAL"
    assert one(spark, rain=800.0).first()["overall_risk"] == "OPTIMAL"
    assert one(spark, temperature=float("nan")).first()["overall_risk"] == "OPTIMAL"


def test_tie_keeps_the_earlier_rule(spark):
    alerts = one(spark, rain=500.0, humidity=30.0).first()["alerts"]
    assert [(a["category"], a["metric_name"], a["level"]) for a in alerts] == [("DROUGHT", "total_precipitation", "HIGH")]


def test_nothing_fires(spark):
    row = one(spark).first()
    assert (row["overall_risk"], row["alerts"], row["summary"]) == ("OPTIMAL", [], "All indicators within normal range for Goa.")
    table = risk.risk_table(one(spark)).first()
    assert table["alerts"].endswith("Optimal") and table["mean_temperature"] == "0.0" and table["total_precipitation"] == "0"
    assert risk.compact_table(one(spark)).first()["alerts"].endswith("All clear")


def test_messages(spark):
    alerts = one(spark, temperature=31.25, rain=320.0, solar=12.0).first()["alerts"]
    texts = {a["category"]: a["message"] for a in alerts}
    assert texts["DROUGHT"] == "Rainfall 320mm/yr vs norm 1000mm/yr (-68%)"
    assert texts["HEAT_STRESS"] == "Temperature 31.2°C vs norm 25.0°C (+25%)"
    assert texts["SOLAR_DEFICIENCY"] == "Solar Radiation 12.0MJ/m²/day vs norm 0.0MJ/m²/day (+0%)"
    assert {a["category"]: a["deviation_pct"] for a in alerts} == {"DROUGHT": -68.0, "HEAT_STRESS": 25.0, "SOLAR_DEFICIENCY": 0.0}
    default = one(spark, rain=320.0, with_norms=False).first()["alerts"][0]
    assert (default["norm_value"], default["deviation_pct"]) == (1100.0, -70.9)


def test_own_rules(spark):
    rules = [
        ("mean_temperature", ">=", 10.0, "LOW", "WARM"),
        ("mean_temperature", "!=", 0.0, "CRITICAL", "BROKEN"),
        ("mean_temperature", "<=", 10.0, "HIGH", "WARM"),
    ]
    weather = frame(spark, [("Goa", 10.0, None, None, None)])
    row = risk.assess(weather, None, rules).first()
    assert (row["overall_risk"], [a["rule_ord"] for a in row["alerts"]]) == ("HIGH", [3])


def test_order_and_counts(spark):
    weather = frame(spark, [("b", 31.0, None, None, None), ("c", None, None, None, None), ("a", 31.0, None, None, None), ("d", 27.0, None, None, None)])
    assessed = risk.assess(weather)
    assert [r["state"] for r in risk.by_severity(assessed).collect()] == ["a", "b", "d", "c"]
    assert tuple(risk.level_counts(assessed).first()) == (2, 1, 1, 4)
    record = risk.response_records(assessed).where(F.col("state") == "d").first()["record"]
    assert '"overall_risk":"MODERATE"' in record and '"current_value":27.0' in record


@pytest.mark.parametrize("level,icon", [("OPTIMAL", "\U0001f7e2"), ("CRITICAL", "\U0001f534")])
def test_icons(spark, level, icon):
    row = one(spark, rain=100.0 if level == "CRITICAL" else None).first()
    assert row["overall_icon"] == icon
