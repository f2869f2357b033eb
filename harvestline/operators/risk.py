"""Threshold rules over weather rows.

The rule list is fixed and short, so it becomes a row-wise expression: no join between rows and rules,
no shuffle, and the same code works on a stream.  Within a category the rules are tried from the most
severe to the least, earlier rules first, which is the best alert of that category.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harvestline import fixed_values as fv
from harvestline.functions.numbers import compare, fixed_text, half_even, nan_to_null, percent_of, signed_text
from harvestline.functions.text import lookup


_METRICS = list(fv.METRIC_TEXT)
_OPERATORS = ("<", ">", "<=", ">=")


def _facts(norms: Column) -> Column:
    """Per metric, in fixed order: value, norm, deviation and message."""
    facts = []
    for metric, (label, unit, digits) in fv.METRIC_TEXT.items():
        value = F.col(f"_{metric}")
        norm = F.coalesce(norms.getField(metric), F.lit(fv.DEFAULT_NORMS[metric]))
        deviation = percent_of(value - norm, norm)
        message = F.concat(
            F.lit(f"{label} "),
            fixed_text(value, digits),
            F.lit(f"{unit} vs norm "),
            fixed_text(norm, digits),
            F.lit(f"{unit} ("),
            signed_text(deviation),
            F.lit("%)"),
        )
        facts.append(
            F.struct(
                value.alias("value"),
                norm.alias("norm"),
                half_even(deviation, 1).alias("deviation"),
                message.alias("message"),
            )
        )
    return F.array(*facts)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rule_table(rules) -> Column:
    """The rules as one constant array, addressed by position."""
    entries = [
        f"named_struct('rule_ord', {i}, 'level', {_quoted(level)}, 'category', {_quoted(category)}, "
        f"'icon', {_quoted(fv.LEVEL_ICONS.get(level, fv.UNKNOWN_ICON))}, "
        f"'title', {_quoted(fv.CATEGORY_TITLES.get(category, category))}, 'metric_name', {_quoted(metric)}, "
        f"'threshold', {float(threshold)!r}D, 'slot', {_METRICS.index(metric)})"
        for i, (metric, _, threshold, level, category) in enumerate(rules, 1)
    ]
    return F.expr(f"array({', '.join(entries)})")


def _fires(rule: tuple) -> str:
    """Condition of one rule as SQL text. An unknown operator never fires; nor does a NULL metric."""
    metric, op, threshold = rule[:3]
    return f"`_{metric}` {op} {float(threshold)!r}D" if op in _OPERATORS else "false"


def _with_metrics(weather: DataFrame, norms: DataFrame | None) -> DataFrame:
    """Attach the norms, one row, as a scalar subquery, then the facts of each metric."""
    if norms is None:
        one_row = F.struct(*[F.lit(fv.DEFAULT_NORMS[c]).alias(c) for c in fv.WEATHER])
    else:
        one_row = norms.select(F.struct(*fv.WEATHER)).scalar()
    values = {f"_{m}": nan_to_null(F.col(m)) for m in _METRICS}
    return weather.withColumns({**values, "_norms": one_row}).withColumn("_facts", _facts(F.col("_norms")))


def _alert(rule: Column) -> Column:
    facts = F.get(F.col("_facts"), rule["slot"])
    return F.struct(
        *[rule[n].alias(n) for n in ("rule_ord", "level", "category", "icon", "title")],
        facts["message"].alias("message"),
        rule["metric_name"].alias("metric_name"),
        facts["value"].alias("current_value"),
        rule["threshold"].alias("threshold"),
        facts["norm"].alias("norm_value"),
        facts["deviation"].alias("deviation_pct"),
    )


def fired_rules(weather: DataFrame, norms: DataFrame | None = None, rules=None) -> DataFrame:
    """One row per fired rule, with the identifying columns of its weather row."""
    rules = fv.RISK_RULES if rules is None else rules
    entity = [c for c in weather.columns if c not in fv.WEATHER]
    fired = ", ".join(f"CASE WHEN {_fires(r)} THEN {i} END" for i, r in enumerate(rules, 1))
    numbers = F.filter(F.expr(f"array({fired})"), lambda n: n.isNotNull())
    rows = _with_metrics(weather, norms).select(*entity, "_facts", F.explode(numbers).alias("_n"))
    rows = rows.withColumn("_rule", F.get(_rule_table(rules), F.col("_n") - 1))
    return rows.withColumn("_a", _alert(F.col("_rule"))).select(*entity, "_a.*")


def rule_table(spark: SparkSession, rules=None) -> DataFrame:
    """The rules as data."""
    rows = [(i, *r) for i, r in enumerate(fv.RISK_RULES if rules is None else rules, 1)]
    return spark.createDataFrame(
        rows, "rule_ord int, metric string, op string, threshold double, level string, category string"
    )


def fired_by_table(weather: DataFrame, rules: DataFrame) -> DataFrame:
    """Fired rules of a rule table of any length: an equi-join on the metric, then the comparison."""
    entity = [c for c in weather.columns if c not in fv.WEATHER]
    values = [nan_to_null(F.col(c)).alias(c) for c in fv.WEATHER]
    long = weather.select(*entity, *values).unpivot(entity, fv.WEATHER, "metric", "value").where("value is not null")
    return long.join(rules, "metric").where(compare(F.col("value"), F.col("op"), F.col("threshold")))


def _best_of_category(category: str, rules) -> str:
    """`(rank, first, number)` of the best fired rule of a category, NULL when none fired.

    The most severe rule wins, the earlier one on a tie; `first` is the earliest fired rule, which orders
    categories of equal severity.
    """
    severity = fv.LEVEL_SEVERITY
    own = [(i, r) for i, r in enumerate(rules, 1) if r[4] == category]
    ranked = sorted(own, key=lambda item: (-severity.get(item[1][3], 0), item[0]))
    first = "coalesce(" + ", ".join(f"CASE WHEN {_fires(r)} THEN {i} END" for i, r in own) + ")"
    whens = " ".join(
        f"WHEN {_fires(r)} THEN named_struct('rank', {-severity.get(r[3], 0)}, 'first', {first}, 'number', {i})"
        for i, r in ranked
    )
    return f"CASE {whens} END"


def assess(weather: DataFrame, norms: DataFrame | None = None, rules=None) -> DataFrame:
    """One assessment per weather row: overall level, icon, at most one alert per category by falling
    severity, the weather itself and a one-line summary."""
    rules = fv.RISK_RULES if rules is None else rules
    best = ", ".join(_best_of_category(c, rules) for c in dict.fromkeys(r[4] for r in rules))
    order = F.array_sort(F.filter(F.expr(f"array({best})"), lambda b: b.isNotNull()))
    table = _rule_table(rules)
    chosen = F.transform(order, lambda b: F.get(table, b["number"] - 1))
    entity = [c for c in weather.columns if c not in fv.WEATHER]
    assessed = _with_metrics(weather, norms).withColumn("alerts", F.transform(chosen, _alert))
    state = F.col("state")
    overall = F.coalesce(F.get("alerts", F.lit(0))["level"], F.lit("OPTIMAL"))
    top_two = F.transform(F.slice("alerts", 1, 2), lambda a: F.concat_ws(" ", a["icon"], a["title"]))
    summary = F.when(
        F.size("alerts") == 0, F.concat(F.lit("All indicators within normal range for "), state, F.lit("."))
    ).otherwise(F.concat(state, F.lit(": "), F.array_join(top_two, " | ")))
    return assessed.select(
        *entity,
        overall.alias("overall_risk"),
        lookup(fv.LEVEL_ICONS, overall).alias("overall_icon"),
        lookup(fv.LEVEL_SEVERITY, overall).alias("severity"),
        "alerts",
        *fv.WEATHER,
        summary.alias("summary"),
    )


def by_severity(assessments: DataFrame) -> DataFrame:
    """Most severe first, then by entity."""
    entity = assessments.columns[: assessments.columns.index("overall_risk")]
    return assessments.orderBy(F.desc("severity"), *entity)


def best_alerts(assessments: DataFrame) -> DataFrame:
    """The alerts of the assessments as rows, with their position."""
    entity = assessments.columns[: assessments.columns.index("overall_risk")]
    return assessments.select(*entity, F.posexplode("alerts").alias("alert_pos", "_a")).select(
        *entity, (F.col("alert_pos") + 1).alias("alert_pos"), "_a.*"
    )


def _joined(text, when_empty: str) -> Column:
    return F.when(F.size("alerts") == 0, F.lit(when_empty)).otherwise(F.array_join(F.transform("alerts", text), " | "))


def risk_table(assessments: DataFrame) -> DataFrame:
    """Flat table with formatted weather and the full alert text."""
    entity = assessments.columns[: assessments.columns.index("overall_risk")]

    def shown(feature: str, digits: int) -> Column:
        return fixed_text(F.coalesce(nan_to_null(F.col(feature)), F.lit(0.0)), digits).alias(feature)

    alerts = _joined(lambda a: F.concat(a["icon"], F.lit(" "), a["title"], F.lit(": "), a["message"]),
                     f"{fv.LEVEL_ICONS['OPTIMAL']} Optimal")
    return assessments.select(
        *entity,
        F.col("overall_risk").alias("risk_level"),
        F.col("overall_icon").alias("icon"),
        shown("mean_temperature", 1),
        shown("total_precipitation", 0),
        shown("mean_relative_humidity", 0),
        shown("mean_solar_radiation", 1),
        alerts.alias("alerts"),
        "summary",
    )


def compact_table(assessments: DataFrame) -> DataFrame:
    """Level, temperature, rain and alert titles only."""
    entity = assessments.columns[: assessments.columns.index("overall_risk")]
    titles = _joined(lambda a: F.concat_ws(" ", a["icon"], a["title"]), f"{fv.LEVEL_ICONS['OPTIMAL']} All clear")
    return assessments.select(
        *entity,
        F.concat_ws(" ", "overall_icon", "overall_risk").alias("risk"),
        fixed_text(F.coalesce(nan_to_null(F.col("mean_temperature")), F.lit(0.0)), 1).alias("temp"),
        fixed_text(F.coalesce(nan_to_null(F.col("total_precipitation")), F.lit(0.0)), 0).alias("rain"),
        titles.alias("alerts"),
    )


def level_counts(assessments: DataFrame) -> DataFrame:
    level = F.col("overall_risk")
    return assessments.agg(
        F.count_if(level.isin("CRITICAL", "HIGH")).alias("critical_high"),
        F.count_if(level == "MODERATE").alias("moderate"),
        F.count_if(level.isin("LOW", "OPTIMAL")).alias("low_optimal"),
        F.count("*").alias("assessed"),
    )


def response_records(assessments: DataFrame) -> DataFrame:
    """Assessment as one JSON text per entity."""
    entity = assessments.columns[: assessments.columns.index("overall_risk")]
    alerts = F.transform(
        "alerts",
        lambda a: F.struct(
            *[
                a[n].alias(n)
                for n in (
                    "level", "category", "icon", "title", "message", "metric_name", "current_value", "threshold",
                    "norm_value", "deviation_pct",
                )
            ]
        ),
    )
    record = F.struct(
        "state",
        "overall_risk",
        "overall_icon",
        alerts.alias("alerts"),
        F.struct(*fv.WEATHER).alias("weather"),
        "summary",
    )
    return assessments.select(*entity, F.to_json(record).alias("record"))
