from hypothesis import HealthCheck, given, settings, strategies as st

from harvestline import fixed_values as fv
from harvestline.operators.matching import tiered_match

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
WORDS = st.text(alphabet="abAB ", max_size=4)


def brute_force(key, dimension, aliases, default, empty_key="first"):
    """Tiers by their definition, one key at a time."""
    name = key.strip(" ")
    name = aliases.get(name.lower(), name)
    tests = [
        lambda d: d == name,
        lambda d: d.lower() == name.lower(),
        lambda d: name.lower() in d.lower() or d.lower() in name.lower(),
    ]
    if empty_key == "default" and key == "":
        tests = tests[:2]
    for tier, test in enumerate(tests, 1):
        for d, value in dimension:
            if test(d):
                return value, tier
    return default, 4


def run(spark, keys, dimension, aliases, empty_key="first"):
    dim = spark.createDataFrame([(d, v, i) for i, (d, v) in enumerate(dimension)], "state string, v double, ord bigint")
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    rows = tiered_match(frame, "k", dim, ["v"], [-1.0], aliases, empty_key=empty_key).collect()
    return {r["k"]: (r["v"], r["match_tier"]) for r in rows}


@FEW
@given(keys=st.sets(WORDS, min_size=5, max_size=40), names=st.lists(WORDS.map(lambda w: w.strip(" ")), unique=True, max_size=8))
def test_against_brute_force(spark, keys, names):
    dimension = [(n, float(i)) for i, n in enumerate(names)]
    aliases = {"ab": "BA", "b": "a"}
    for empty_key in ("first", "default"):
        expected = {k: brute_force(k, dimension, aliases, -1.0, empty_key) for k in keys}
        assert run(spark, keys, dimension, aliases, empty_key) == expected


def test_state_names(spark):
    dimension = [("Goa", 1.0), ("Odisha", 2.0), ("Tamil Nadu", 3.0), ("Jammu and Kashmir", 4.0)]
    keys = ["Orissa", "TAMILNADU", "tamil", "state of goa", "Kerala", "", "jammu & kashmir", None]
    assert run(spark, keys, dimension, fv.STATE_ALIASES) == {
        "Orissa": (2.0, 1),
        "TAMILNADU": (3.0, 1),
        "tamil": (3.0, 3),
        "state of goa": (1.0, 3),
        "Kerala": (-1.0, 4),
        "": (1.0, 3),
        "jammu & kashmir": (4.0, 1),
    }


def test_empty_dimension(spark):
    assert run(spark, ["Goa", ""], [], {}) == {"Goa": (-1.0, 4), "": (-1.0, 4)}


def test_plan_has_no_nested_loop(spark):
    dim = spark.createDataFrame([("Goa", 1.0, 0)], "state string, v double, ord bigint")
    plan = tiered_match(spark.createDataFrame([("x",)], "k string"), "k", dim, ["v"], [0.0])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
