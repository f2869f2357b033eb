"""Reference SQL for the registered queries, over the same parquet tables.

Each statement is written on its own terms (ordinary joins, window ranks, exact quantiles), not as a copy of
the Spark plan it checks.
"""

from math import prod

from harvestline import fixed_values as fv
from harvestline.sources import tables as t

AS_OF = "2000-12-31"
FORECAST_AS_OF = "1998-01-01"
SNAPSHOT_AS_OF = "2001-07-15"


def rnd(x: str, digits: int) -> str:
    text = f"cast(printf('%.{digits}f', cast({x} as double)) as double)"
    return f"(case when {text} = 0 then 0.0e0 else {text} end)"


def _columns(**columns: str) -> str:
    return ", ".join(f'{text} AS "{name}"' for name, text in columns.items())


def _values(rows, columns: str, name: str) -> str:
    def cell(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else str(v)

    body = ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS {name}_({columns})"


LINES = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"
ORDERS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey"

W = fv.WEATHER
MEAN = "avg(val) FILTER (WHERE param = '{}' AND val > -990)"
PERIOD = ", ".join(
    (MEAN.format(p) + (" * 365.25e0" if p == "PRECTOTCORR" else "")) + f" AS {f}" for p, f in fv.DAILY_PARAMETERS.items()
)

RULES = _values([(i, *r) for i, r in enumerate(fv.RISK_RULES, 1)], "rule_ord, metric, op, threshold, level, category", "rules")
LEVELS = _values([(k, v, fv.LEVEL_ICONS[k]) for k, v in fv.LEVEL_SEVERITY.items()], "level, sev, icon", "levels")
METRICS = _values([(m, *v, fv.DEFAULT_NORMS[m]) for m, v in fv.METRIC_TEXT.items()], "metric, label, unit, digits, usual", "metrics")
TITLES = _values(list(fv.CATEGORY_TITLES.items()), "category, title", "titles")


def _signed(x: str) -> str:
    return f"(case when printf('%.0f', {x}) LIKE '-%' then '' else '+' end || printf('%.0f', {x}))"


def _shown(x: str) -> str:
    return f"(case when digits = 0 then printf('%.0f', {x}) else printf('%.1f', {x}) end)"


CTES = {
    "production": f"""SELECT {_columns(row_key=t.ROW_KEY, crop="p_type", state="n_name", district="p_brand", season=t.SEASON,
        crop_year="cast(year(l_shipdate) as int)", area="l_quantity", production="l_extendedprice",
        **{"yield": "l_extendedprice / l_quantity"})}
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey""",
    "observations": f"""SELECT {_columns(state="n_name", obs_date="cast(l_shipdate as date)", param=t.PARAM, val=t.OBSERVED)}
        FROM {LINES}""",
    "irrigation": """SELECT n_name AS state, 20 + (n_nationkey * 13 % 17) * 4.5e0 AS irrigation_coverage_pct,
        n_nationkey AS ord FROM nation WHERE n_nationkey % 12 <> 11""",
    "fertilizer": """SELECT n_name AS state, cast(30 + (n_nationkey * 29 % 23) * 9 as double) AS npk_consumption_kg_per_ha,
        n_nationkey AS ord FROM nation WHERE n_nationkey % 12 <> 11""",
    "lookup_keys": f"SELECT c_custkey AS key_id, {t.LOOKUP_KEY} AS state_key FROM {CUSTOMERS}",
    "points": f"""SELECT n_name AS state, o_orderdate AS ts, 12 + o_totalprice / 25000 AS temperature_2m,
        case when o_orderkey % 17 = 0 then null else o_totalprice / 100000 end AS precipitation,
        cast(30 + o_orderkey % 61 as double) AS relative_humidity_2m,
        cast(100 + o_custkey % 150 as double) AS shortwave_radiation FROM {ORDERS}""",
    "fsnapshot": f"""SELECT o_orderkey AS snap_id, n_name AS state, {t.SNAPSHOT_SEASON} AS season,
        o_orderdate AS cached_at FROM {ORDERS}""",
    "requests": f"""SELECT c_custkey AS request_id, {t.REQUEST_CROP} AS crop,
        case when c_custkey % 5 = 0 then lower(n_name) else n_name end AS state, {t.REQUEST_SEASON} AS season,
        cast(1995 + c_custkey % 9 as int) AS crop_year, c_acctbal / 100 AS area,
        case when c_custkey % 3 = 0 then cast(c_custkey % 121 as double) end AS irrigation_pct,
        case when c_custkey % 4 = 0 then cast(c_custkey % 601 as double) end AS npk_kg_per_ha,
        c_custkey % 2 = 0 AS use_forecast FROM {CUSTOMERS}""",
    "yearly": f"""SELECT state, cast(year(obs_date) as int) AS crop_year, {PERIOD} FROM observations GROUP BY 1, 2""",
    "recent": f"""SELECT state, {PERIOD} FROM observations
        WHERE obs_date BETWEEN DATE '{AS_OF}' - INTERVAL 365 DAY AND DATE '{AS_OF}' GROUP BY 1""",
    "partial": """SELECT yearly.* FROM yearly JOIN nation ON n_name = state WHERE (n_nationkey + crop_year) % 10 <> 0""",
    "norms": "SELECT "
    + ", ".join(f"coalesce({rnd(f'median({f}) FILTER (WHERE {f} > 0)', 1)}, {fv.DEFAULT_NORMS[f]}e0) AS {f}" for f in W)
    + " FROM yearly",
    "rules": RULES,
    "levels": LEVELS,
    "metrics": METRICS,
    "titles": TITLES,
    "long_weather": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT yearly.state, yearly.crop_year, '{f}' AS metric, yearly.{f} AS value, norms.{f} AS norm FROM yearly, norms"
        for f in W) + ")",
    "fired": f"""SELECT w.state, w.crop_year, r.rule_ord, r.level, r.category, l.sev, l.icon, ti.title, r.metric AS metric_name,
        w.value AS current_value, r.threshold, w.norm AS norm_value,
        case when w.norm > 0 then (w.value - w.norm) / w.norm * 100 else 0.0e0 end AS deviation,
        m.label || ' ' || {_shown('w.value')} || m.unit || ' vs norm ' || {_shown('w.norm')} || m.unit || ' (' ||
        {_signed('(case when w.norm > 0 then (w.value - w.norm) / w.norm * 100 else 0.0e0 end)')} || '%)' AS message
        FROM long_weather w JOIN rules r ON r.metric = w.metric JOIN levels l ON l.level = r.level
        JOIN titles ti ON ti.category = r.category JOIN metrics m ON m.metric = r.metric
        WHERE (r.op = '<' AND w.value < r.threshold) OR (r.op = '>' AND w.value > r.threshold)""",
    "best": """SELECT *, row_number() OVER (PARTITION BY state, crop_year ORDER BY sev DESC, first_ord) AS alert_pos FROM (
        SELECT *, row_number() OVER (PARTITION BY state, crop_year, category ORDER BY sev DESC, rule_ord) AS rn,
        min(rule_ord) OVER (PARTITION BY state, crop_year, category) AS first_ord FROM fired) WHERE rn = 1""",
    "assessed": """SELECT y.*, coalesce(b.level, 'OPTIMAL') AS overall_risk, l.icon AS overall_icon, l.sev AS severity,
        coalesce(b.n, 0) AS n_alerts, b.alert_text, b.title_text,
        case when b.n is null then 'All indicators within normal range for ' || y.state || '.'
        else y.state || ': ' || b.top_two end AS summary
        FROM yearly y LEFT JOIN (SELECT state, crop_year, count(*) AS n, max(level) FILTER (WHERE alert_pos = 1) AS level,
        string_agg(icon || ' ' || title || ': ' || message, ' | ' ORDER BY alert_pos) AS alert_text,
        string_agg(icon || ' ' || title, ' | ' ORDER BY alert_pos) AS title_text,
        string_agg(icon || ' ' || title, ' | ' ORDER BY alert_pos) FILTER (WHERE alert_pos <= 2) AS top_two
        FROM best GROUP BY 1, 2) b ON b.state = y.state AND b.crop_year = y.crop_year
        JOIN levels l ON l.level = coalesce(b.level, 'OPTIMAL')""",
}


def _match(name: str, keys: str, key: str, dims: str, values: list[str], defaults: list, aliases: dict, empty_default: bool) -> dict:
    """Tiered match as a nested comparison of every key with every dimension row."""
    alias = "".join(f" when '{a}' then '{b}'" for a, b in aliases.items())
    canonical = f"case lower(trim(k)){alias} else trim(k) end" if aliases else "trim(k)"
    hit3 = "contains(lower(d.state), lower(nk)) OR contains(lower(nk), lower(d.state))"
    if empty_default:
        hit3 = f"k <> '' AND ({hit3})"
    picks = ", ".join(f"coalesce(best.{v}, {d!r}e0) AS {v}" for v, d in zip(values, defaults))
    return {
        f"{name}_keys": f"SELECT k, {canonical} AS nk FROM (SELECT DISTINCT {key} AS k FROM {keys}) WHERE k IS NOT NULL",
        f"{name}_hits": f"""SELECT k, {', '.join(values)}, tier FROM (SELECT k, {', '.join('d.' + v for v in values)}, tier,
            row_number() OVER (PARTITION BY k ORDER BY tier, ord) AS rn FROM (
            SELECT k, nk, d.*, case when nk = d.state then 1 when lower(nk) = lower(d.state) then 2
            when {hit3} then 3 end AS tier FROM {name}_keys, {dims} d) d WHERE tier IS NOT NULL) WHERE rn = 1""",
        name: f"SELECT a.k AS {key}, {picks}, coalesce(best.tier, 4) AS match_tier FROM {name}_keys a LEFT JOIN {name}_hits best ON best.k = a.k",
    }


CTES |= _match("irr", "production", "state", "irrigation", [fv.IRRIGATION], [40.0], fv.STATE_ALIASES, False)
CTES |= _match("npk", "production", "state", "fertilizer", [fv.FERTILIZER], [120.0], fv.STATE_ALIASES, False)
CTES |= _match("lk", "lookup_keys", "state_key", "irrigation", [fv.IRRIGATION], [40.0], fv.STATE_ALIASES, False)
CTES["centroids"] = _values([(n, a, b, i) for i, (n, a, b) in enumerate(fv.CENTROIDS)], "state, lat, lon, ord", "centroids")
CTES |= _match("geo", "lookup_keys", "state_key", "centroids", ["lat", "lon"], list(fv.FALLBACK_CENTROID), {}, True)

for _suffix, _weather in (("", "yearly"), ("_gaps", "partial")):
    CTES[f"enriched{_suffix}"] = f"""SELECT p.*, {', '.join(f'y.{f}' for f in W)}, i.irrigation_coverage_pct, f.npk_consumption_kg_per_ha
        FROM production p LEFT JOIN {_weather} y ON y.state = p.state AND y.crop_year = p.crop_year
        LEFT JOIN irr i ON i.state = p.state LEFT JOIN npk f ON f.state = p.state"""
    CTES[f"labelled{_suffix}"] = f"""SELECT *, case when n >= 2 AND rn <= ceil(0.2e0 * n) then 'test' else 'train' end AS split FROM (
        SELECT *, count(*) OVER (PARTITION BY crop) AS n,
        row_number() OVER (PARTITION BY crop ORDER BY md5('42:' || row_key)) AS rn FROM enriched{_suffix})"""
    CTES[f"med{_suffix}"] = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, cast(median({c}) as double) AS median FROM labelled{_suffix} WHERE split = 'train'" for c in fv.NUMERICAL
    )
CTES["scored"] = f"""SELECT t.row_key, t.crop, t."yield" AS y_true, m.y_pred FROM labelled t JOIN (
    SELECT crop, {rnd('avg("yield")', 6)} AS y_pred FROM labelled WHERE split = 'train' GROUP BY 1) m ON m.crop = t.crop
    WHERE t.split = 'test'"""
CTES["filled"] = "SELECT row_key, crop, state, season, " + ", ".join(
    f"coalesce(cast({c} as double), (SELECT median FROM med WHERE feature = '{c}')) AS {c}" for c in fv.NUMERICAL
) + " FROM labelled WHERE split = 'train'"
CTES["scale"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, case when stddev_pop({c}) > 0 then stddev_pop({c}) else 1.0e0 end AS scale FROM filled"
    for c in fv.NUMERICAL
)
CTES["season_months"] = _values([(s, m) for s, ms in fv.SEASON_MONTHS.items() for m in ms], "season, m", "season_months")
CTES["fc_stats"] = f"""SELECT p.state, s.season, count(*) AS data_points, avg(temperature_2m) AS temp,
    coalesce(sum(precipitation), 0.0e0) AS rain, avg(relative_humidity_2m) AS hum, avg(shortwave_radiation) AS rad,
    stddev_pop(temperature_2m) AS temp_sd, stddev_pop(precipitation) AS rain_sd, stddev_pop(relative_humidity_2m) AS hum_sd,
    stddev_pop(shortwave_radiation) AS rad_sd,
    greatest(0, cast(trunc(median(date_diff('day', DATE '{FORECAST_AS_OF}', cast(ts as date)))) as int)) AS horizon
    FROM points p JOIN season_months s ON month(p.ts) = s.m GROUP BY 1, 2"""
CTES["fc_total"] = "SELECT state, count(*) AS n FROM points GROUP BY 1"
CTES["forecast"] = f"""SELECT s.state, s.season, {rnd('temp', 2)} AS mean_temperature,
    {rnd('rain / (data_points / 4.0e0) * 365.25e0', 1)} AS total_precipitation, {rnd('hum', 1)} AS mean_relative_humidity,
    {rnd('rad * 0.0864e0', 2)} AS mean_solar_radiation, {rnd('temp_sd', 2)} AS spread_mean_temperature,
    {rnd('rain_sd * 365.25e0 / greatest(data_points / 4.0e0, 1.0e0) * 2', 1)} AS spread_total_precipitation,
    {rnd('hum_sd', 1)} AS spread_mean_relative_humidity, {rnd('rad_sd * 0.0864e0', 2)} AS spread_mean_solar_radiation,
    case when horizon <= 45 then 'high' when horizon <= 120 then 'medium' else 'low' end AS forecast_confidence,
    {rnd('data_points / n * 100', 1)} AS coverage_pct, horizon AS forecast_horizon_days, data_points,
    {rnd('rain', 1)} AS season_total_precipitation_mm,
    case when data_points / n * 100 < 30 then 'Low forecast coverage (' || printf('%.0f', data_points / n * 100) ||
    '%). Season extends beyond the 180-day forecast horizon.'
    when horizon > 120 then 'Forecast horizon is ' || horizon || ' days — accuracy drops significantly beyond 120 days.'
    when horizon > 45 then 'Forecast horizon is ' || horizon || ' days — treat as indicative trend, not precise prediction.' end AS warning
    FROM fc_stats s JOIN fc_total USING (state)"""
CTES["crop_dom"] = "SELECT upper(crop) AS k, min(crop) AS v FROM production GROUP BY 1"
CTES["season_dom"] = "SELECT upper(season) AS k, min(season) AS v FROM production GROUP BY 1"
CTES["state_dom"] = "SELECT lower(state) AS k, min(state) AS v FROM production GROUP BY 1"
CTES["validated"] = """SELECT r.request_id, coalesce(c.v, r.crop) AS crop, coalesce(st.v, r.state) AS state,
    coalesce(s.v, r.season) AS season, r.crop_year, coalesce(r.area, 1.0e0) AS area, r.irrigation_pct, r.npk_kg_per_ha,
    r.use_forecast, concat_ws(' | ',
    case when c.v is null then 'Unknown crop ''' || r.crop || '''.' end,
    case when s.v is null then 'Unknown season ''' || r.season || '''.' end,
    case when st.v is null then 'Unknown state ''' || r.state || '''.' end,
    case when r.crop_year < 1997 or r.crop_year > 2015 then 'crop_year must be between 1997 and 2015' end,
    case when coalesce(r.area, 1.0e0) < 0.1e0 or coalesce(r.area, 1.0e0) > 10000 then 'area must be between 0.1 and 10000.0' end,
    case when r.irrigation_pct < 0 or r.irrigation_pct > 100 then 'irrigation_pct must be between 0.0 and 100.0' end,
    case when r.npk_kg_per_ha < 0 or r.npk_kg_per_ha > 500 then 'npk_kg_per_ha must be between 0.0 and 500.0' end) AS errors
    FROM requests r LEFT JOIN crop_dom c ON c.k = upper(r.crop) LEFT JOIN season_dom s ON s.k = upper(r.season)
    LEFT JOIN state_dom st ON st.k = lower(r.state)"""
CTES["overridden"] = """SELECT v.* EXCLUDE (errors), coalesce(v.irrigation_pct, i.irrigation_coverage_pct) AS irrigation_coverage_pct,
    case when v.irrigation_pct is null then 'state-avg' else 'user' end AS irrigation_source,
    coalesce(v.npk_kg_per_ha, f.npk_consumption_kg_per_ha) AS npk_consumption_kg_per_ha,
    case when v.npk_kg_per_ha is null then 'state-avg' else 'user' end AS npk_source
    FROM validated v LEFT JOIN irr i ON i.state = v.state LEFT JOIN npk f ON f.state = v.state WHERE v.errors = ''"""
CTES["routed"] = f"""SELECT o.*, {', '.join(f'case when o.use_forecast then f.{c} else y.{c} end AS {c}, y.{c} AS hist_{c}' for c in W)},
    case when o.use_forecast and f.state is not null then 'forecast' else 'historical' end AS weather_source,
    case when o.use_forecast then f.forecast_confidence end AS forecast_confidence
    FROM overridden o LEFT JOIN yearly y ON y.state = o.state AND y.crop_year = o.crop_year
    LEFT JOIN forecast f ON f.state = o.state AND f.season = o.season"""

CTES["picked"] = "SELECT * FROM enriched WHERE crop IN (SELECT DISTINCT crop FROM production ORDER BY crop LIMIT 5)"


def statement(body: str, extra: dict | None = None) -> str:
    """The body with the named tables it uses, directly or through each other."""
    import re

    known = {**CTES, **(extra or {})}
    order = list(known)
    used, queue = set(), [body]
    while queue:
        text = queue.pop()
        for name in order:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                queue.append(known[name])
    # A table may only use earlier ones; CTES is written in that order.
    head = ",\n".join(f"{name} AS ({known[name]})" for name in order if name in used)
    return f"WITH {head}\n{body}" if head else body


ROUNDED_WEATHER = ", ".join(f"{rnd(f, 6)} AS {f}" for f in W)
CORR_COLUMNS = [*fv.NUMERICAL, fv.TARGET]
SPREADS = ", ".join(f"spread_{c}" for c in W)
FORECAST_COLUMNS = f"""state, season, {', '.join(W)}, {SPREADS}, forecast_confidence, coverage_pct, forecast_horizon_days,
    data_points, season_total_precipitation_mm, warning"""


def _histogram(source: str, value: str, by: str = "") -> str:
    group = f"{by}, " if by else ""
    return f"""SELECT {group}bin, {rnd('lo + bin * (hi - lo) / 50', 4)} AS bin_start, {rnd('lo + (bin + 1) * (hi - lo) / 50', 4)} AS bin_end,
        count(*) AS n FROM (SELECT {group}lo, hi, cast(case when hi > lo then least(floor(({value} - lo) / (hi - lo) * 50), 49) else 0 end as int) AS bin
        FROM {source}, (SELECT min({value}) AS lo, max({value}) AS hi FROM {source})) GROUP BY {group}bin, lo, hi"""


_QUANT = ", ".join(f"{rnd(f'quantile_cont(value, {q}e0)', 4)} AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75))


def _correlations(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {rnd(f'corr(\"{a}\", \"{b}\")', 6)} AS corr FROM {source}"
        if a != b
        else f"SELECT '{a}' AS x, '{a}' AS y, case when count(\"{a}\") > 1 and max(\"{a}\") > min(\"{a}\") then 1.0e0 end AS corr FROM {source}"
        for a in CORR_COLUMNS for b in CORR_COLUMNS
    )


def _long(columns, source: str, extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, cast(\"{c}\" as double) AS value{extra} FROM {source}" for c in columns)


def _band(x: str, bands: list, field: int) -> str:
    whens = " ".join(f"when {x} >= {b[0]} then '{b[field]}'" for b in bands[:-1])
    return f"case {whens} else '{bands[-1][field]}' end"


def _delta(c: str) -> str:
    past, now = f"coalesce(h.{c}, 0.0e0)", f"coalesce(f.{c}, 0.0e0)"
    has = "h.state is not null"
    d = rnd(f"{now} - {past}", 2)
    return f"""case when {has} then {rnd(f'h.{c}', 6)} end AS hist_{c}, case when {has} then {d} end AS delta_{c},
        case when {has} then (case when abs({past}) > 0.01e0 then {rnd(f'({now} - {past}) / abs({past}) * 100', 1)} else 0.0e0 end) end AS delta_pct_{c},
        case when {has} and abs({d}) > {fv.DELTA_CUTOFFS[c]}e0 then {d} end AS shown_{c}"""


_METRICS = f"""count(*) AS n, case when count(*) >= 2 then {rnd('sqrt(avg((y_true - y_pred) * (y_true - y_pred)))', 4)} end AS rmse,
    case when count(*) >= 2 then {rnd('avg(abs(y_true - y_pred))', 4)} end AS mae,
    case when count(*) >= 2 then (case when var_pop(y_true) > 0 then {rnd('1 - avg((y_true - y_pred) * (y_true - y_pred)) / var_pop(y_true)', 4)}
    when sum(abs(y_true - y_pred)) = 0 then 1.0e0 else 0.0e0 end) end AS r2,
    case when count(*) >= 2 then {rnd('coalesce(avg(abs((y_true - y_pred) / y_true)) FILTER (WHERE y_true > 0.01e0) * 100, 0.0e0)', 2)} end AS mape"""

_DISPLAY = "case feature " + " ".join(f"when '{k}' then '{v}'" for k, v in fv.DISPLAY_NAMES.items()) + " end"


def _summary_value(c: str) -> str:
    if c in (*fv.CATEGORICAL, "crop_year"):
        return f"cast({c} as varchar)"
    return f"case when abs({c} - round_even({c}, 0)) < 0.05e0 then cast(cast(round_even({c}, 0) as bigint) as varchar) else printf('%.1f', {c}) end"


def _summary_source(c: str) -> str:
    return {fv.IRRIGATION: "irrigation_source", fv.FERTILIZER: "npk_source"}.get(
        c, "weather_source" if c in W else "'user'"
    )


def _summaries() -> str:
    return " UNION ALL ".join(
        f"SELECT request_id, '{c}' AS feature, {_summary_value(c)} AS value, {_summary_source(c)} AS source FROM routed" for c in fv.FEATURES
    )


def _current_risk() -> str:
    """The yearly risk table with the trailing weather in the place of the year weather."""
    import re

    tables = {n: CTES[n] for n in ("long_weather", "fired", "best", "assessed")}
    names = {"yearly": "recent_period", **{n: f"{n}_now" for n in tables}}
    now = {"recent_period": "SELECT state, 0 AS crop_year, " + ", ".join(W) + " FROM recent"}
    for name, text in tables.items():
        for old, new in names.items():
            text = re.sub(rf"\b{old}\b", new, text)
        now[names[name]] = text
    CTES.update(now)
    return """SELECT state, overall_risk AS risk_level, overall_icon AS icon,
        printf('%.1f', coalesce(mean_temperature, 0.0e0)) AS mean_temperature,
        printf('%.0f', coalesce(total_precipitation, 0.0e0)) AS total_precipitation,
        printf('%.0f', coalesce(mean_relative_humidity, 0.0e0)) AS mean_relative_humidity,
        printf('%.1f', coalesce(mean_solar_radiation, 0.0e0)) AS mean_solar_radiation,
        coalesce(alert_text, '\U0001f7e2 Optimal') AS alerts, summary FROM assessed_now"""


BODIES: dict[str, str] = {
    # --- weather and risk
    "period_weather": f"SELECT state, crop_year, {ROUNDED_WEATHER} FROM yearly",
    "trailing_weather": f"SELECT state, {ROUNDED_WEATHER} FROM recent",
    "valid_observations": f"""SELECT state, param, count(*) AS n, {rnd('sum(val)', 4)} AS total, min(obs_date) AS first_day,
        max(obs_date) AS last_day FROM observations WHERE val IS NOT NULL AND val > -990 GROUP BY 1, 2""",
    "weather_norms": f"SELECT {', '.join(W)} FROM norms",
    "snapshot_norms": "SELECT "
    + ", ".join(f"coalesce({rnd(f'median({f}) FILTER (WHERE {f} > 0)', 1)}, {fv.DEFAULT_NORMS[f]}e0) AS {f}" for f in W)
    + f" FROM (SELECT {', '.join(W)} FROM yearly UNION ALL SELECT {', '.join(W)} FROM recent)",
    "risk_fired_rules": f"""SELECT state, crop_year, cast(rule_ord as int) AS rule_ord, level, category, icon, title, message, metric_name,
        {rnd('current_value', 6)} AS current_value, threshold, norm_value, {rnd('deviation', 1)} AS deviation_pct FROM fired""",
    "risk_rules_from_table": f"""SELECT state, crop_year, cast(rule_ord as int) AS rule_ord, metric_name AS metric,
        {rnd('current_value', 6)} AS value, level, category FROM fired""",
    "risk_best_alert": f"""SELECT state, crop_year, cast(alert_pos as int) AS alert_pos, cast(rule_ord as int) AS rule_ord, level, category,
        title, message, {rnd('deviation', 1)} AS deviation_pct FROM best""",
    "risk_assessments": f"""SELECT state, crop_year, overall_risk, overall_icon, cast(severity as int) AS severity,
        cast(n_alerts as int) AS n_alerts, summary, {ROUNDED_WEATHER} FROM assessed""",
    "risk_table": f"""SELECT state, crop_year, overall_risk AS risk_level, overall_icon AS icon,
        printf('%.1f', coalesce(mean_temperature, 0.0e0)) AS mean_temperature,
        printf('%.0f', coalesce(total_precipitation, 0.0e0)) AS total_precipitation,
        printf('%.0f', coalesce(mean_relative_humidity, 0.0e0)) AS mean_relative_humidity,
        printf('%.1f', coalesce(mean_solar_radiation, 0.0e0)) AS mean_solar_radiation,
        coalesce(alert_text, '\U0001f7e2 Optimal') AS alerts, summary FROM assessed""",
    "risk_compact_table": """SELECT state, crop_year, overall_icon || ' ' || overall_risk AS risk,
        printf('%.1f', coalesce(mean_temperature, 0.0e0)) AS temp, printf('%.0f', coalesce(total_precipitation, 0.0e0)) AS rain,
        coalesce(title_text, '\U0001f7e2 All clear') AS alerts FROM assessed""",
    "risk_level_counts": """SELECT count(*) FILTER (WHERE overall_risk IN ('CRITICAL', 'HIGH')) AS critical_high,
        count(*) FILTER (WHERE overall_risk = 'MODERATE') AS moderate,
        count(*) FILTER (WHERE overall_risk IN ('LOW', 'OPTIMAL')) AS low_optimal, count(*) AS assessed FROM assessed""",
    # --- joins and lookups
    "year_weather_join": f"""SELECT p.row_key, p.state, p.crop_year, {', '.join(f'{rnd(f"y.{f}", 6)} AS {f}' for f in W)}
        FROM production p LEFT JOIN yearly y ON y.state = p.state AND y.crop_year = p.crop_year""",
    "incomplete_weather": f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE {' OR '.join(f'{f} IS NULL' for f in W)}) AS rows_without_weather
        FROM enriched_gaps""",
    "trailing_weather_join": f"""SELECT p.row_key, p.state, {', '.join(f'{rnd(f"y.{f}", 6)} AS {f}' for f in W)}
        FROM production p LEFT JOIN recent y ON y.state = p.state""",
    "tiered_match": """SELECT l.key_id, l.state_key, coalesce(lk.irrigation_coverage_pct, 40.0e0) AS irrigation_coverage_pct,
        cast(lk.match_tier as int) AS match_tier FROM lookup_keys l LEFT JOIN lk ON lk.state_key = l.state_key""",
    "centroid_lookup": """SELECT l.key_id, coalesce(geo.lat, 20.5937e0) AS lat, coalesce(geo.lon, 78.9629e0) AS lon
        FROM lookup_keys l LEFT JOIN geo ON geo.state_key = l.state_key""",
    "input_enrichment": """SELECT row_key, state, irrigation_coverage_pct, npk_consumption_kg_per_ha FROM enriched""",
    "irrigation_report": f"""SELECT state, irrigation_coverage_pct, {_band('irrigation_coverage_pct', fv.IRRIGATION_BANDS, 1)} AS category,
        {_band('irrigation_coverage_pct', fv.IRRIGATION_BANDS, 2)} AS description FROM irr""",
    "fertilizer_report": f"""SELECT state, npk_consumption_kg_per_ha, {_band('npk_consumption_kg_per_ha', fv.FERTILIZER_BANDS, 1)} AS category,
        {_band('npk_consumption_kg_per_ha', fv.FERTILIZER_BANDS, 2)} AS description FROM fertilizer""",
    "input_bands": f"""SELECT state, count(*) AS n, max({_band('irrigation_coverage_pct', fv.IRRIGATION_BANDS, 1)}) AS irrigation_band,
        max({_band('npk_consumption_kg_per_ha', fv.FERTILIZER_BANDS, 1)}) AS fertilizer_band FROM enriched GROUP BY 1""",
    "needed_keys": "SELECT DISTINCT state, crop_year FROM production",
    "missing_keys": """SELECT DISTINCT p.state, p.crop_year FROM production p WHERE NOT EXISTS (
        SELECT 1 FROM partial y WHERE y.state = p.state AND y.crop_year = p.crop_year)""",
    "used_snapshot": f"""SELECT y.state, y.crop_year, {', '.join(f'{rnd(f"y.{f}", 6)} AS {f}' for f in W)} FROM partial y
        WHERE EXISTS (SELECT 1 FROM production p WHERE y.state = p.state AND y.crop_year = p.crop_year)""",
    "key_coverage": """SELECT count(*) AS needed, count(y.state) AS present, count(*) - count(y.state) AS missing FROM (
        SELECT DISTINCT state, crop_year FROM production) p LEFT JOIN partial y ON y.state = p.state AND y.crop_year = p.crop_year""",
    "weather_report": f"""SELECT k.state, k.crop_year, 20.5937e0 AS latitude, 78.9629e0 AS longitude,
        'Year ' || k.crop_year AS period, {', '.join(f'{rnd(f"y.{f}", 6)} AS {f}' for f in W)}
        FROM (SELECT DISTINCT state, crop_year FROM production) k LEFT JOIN yearly y ON y.state = k.state AND y.crop_year = k.crop_year""",
    "snapshot_stats": """SELECT count(*) AS total_entries, count(crop_year) AS year_specific, count(*) - count(crop_year) AS latest,
        array_to_string(list_sort(list_distinct(list(state))), ',') AS states,
        array_to_string(list_sort(list_distinct(list(crop_year))), ',') AS years
        FROM (SELECT state, crop_year FROM yearly UNION ALL SELECT state, NULL FROM recent)""",
    "snapshot_keys": """SELECT state || '_' || coalesce(cast(crop_year as varchar), 'LATEST') AS snapshot_key, state AS key_state,
        crop_year AS key_year FROM (SELECT state, crop_year FROM yearly UNION ALL SELECT state, NULL FROM recent)""",
    "snapshot_fill_job": f"SELECT state, crop_year, {ROUNDED_WEATHER} FROM yearly",
    "snapshot_fill_coverage": """SELECT count(*) AS needed, count(y.state) AS present, count(*) - count(y.state) AS missing,
        count(*) - count(y.state) AS fetched, cast(0 as bigint) AS failed FROM (
        SELECT DISTINCT state, crop_year FROM production) p LEFT JOIN partial y ON y.state = p.state AND y.crop_year = p.crop_year""",
    # --- payloads
    "daily_payloads": f"""SELECT state, obs_date, param, {rnd('avg(val)', 6)} AS val FROM observations
        GROUP BY 1, 2, 3""",
    "forecast_payloads": f"""SELECT state, ts, {', '.join(f'{rnd(f"avg({v})", 6)} AS {v}' for v in fv.FORECAST_VARIABLES)}
        FROM points GROUP BY 1, 2""",
    "dimension_files": """SELECT state, irrigation_coverage_pct + case when ord % 3 = 0 then 1 else 0 end AS irrigation_coverage_pct,
        cast(row_number() OVER (ORDER BY ord) as int) AS position FROM irrigation""",
    "first_usable_table": "SELECT * FROM fertilizer",
    "first_suitable_table": f"""SELECT crop, count(*) AS n, {rnd('avg("yield")', 4)} AS mean_yield FROM enriched GROUP BY 1""",
    # --- forecast
    "season_forecast": f"SELECT {FORECAST_COLUMNS} FROM forecast",
    "forecast_rejects": """SELECT a.state, a.season, case when a.season IN (SELECT season FROM season_months)
        then 'no forecast points in the season''s months' else 'unknown season' end AS reason
        FROM (SELECT DISTINCT state, upper(trim(season)) AS season FROM requests) a
        WHERE NOT EXISTS (SELECT 1 FROM forecast f WHERE f.state = a.state AND f.season = a.season)""",
    "forecast_delta": f"""SELECT f.state, f.season, {', '.join('f.' + c for c in W)}, {', '.join(_delta(c) for c in W)},
        case when {rnd('f.mean_temperature - h.mean_temperature', 2)} > 0.5e0 then 'up'
        when {rnd('f.mean_temperature - h.mean_temperature', 2)} < -0.5e0 then 'down' else 'flat' end AS direction
        FROM forecast f LEFT JOIN recent h ON h.state = f.state""",
    "asked_forecasts": f"""SELECT f.state, f.season, {', '.join('f.' + c for c in W)}, {', '.join(
        f"case when h.state is not null then {rnd(f'coalesce(f.{c}, 0.0e0) - coalesce(h.{c}, 0.0e0)', 2)} end AS delta_{c}" for c in W)}
        FROM forecast f LEFT JOIN recent h ON h.state = f.state
        WHERE EXISTS (SELECT 1 FROM requests r WHERE r.state = f.state AND upper(r.season) = f.season)""",
    "cached_forecasts": f"""SELECT {FORECAST_COLUMNS}, '{FORECAST_AS_OF[:7]}' AS year_month,
        cast(case when EXISTS (SELECT 1 FROM requests r WHERE r.state = forecast.state AND upper(r.season) = forecast.season
        AND r.request_id % 10 = 1) then 0 else 12 end as int) AS saved_hour FROM forecast
        WHERE EXISTS (SELECT 1 FROM requests r WHERE r.state = forecast.state AND upper(r.season) = forecast.season)""",
    "latest_valid_forecast": f"""SELECT state, season, snap_id, cast(cached_at as date) AS cached_on FROM (
        SELECT *, row_number() OVER (PARTITION BY state, season ORDER BY cached_at DESC, snap_id DESC) AS rn FROM fsnapshot
        WHERE date_diff('second', cached_at, TIMESTAMP '{SNAPSHOT_AS_OF}') < 2592000
        AND strftime(cached_at, '%Y-%m') = '{SNAPSHOT_AS_OF[:7]}') WHERE rn = 1""",
    "forecast_snapshot_stats": f"""SELECT count(*) AS total_entries,
        count(*) FILTER (WHERE date_diff('second', cached_at, TIMESTAMP '{SNAPSHOT_AS_OF}') < 2592000) AS valid_entries,
        count(*) FILTER (WHERE NOT date_diff('second', cached_at, TIMESTAMP '{SNAPSHOT_AS_OF}') < 2592000) AS expired_entries,
        cast(30 as int) AS ttl_days FROM fsnapshot""",
    "forecast_keys": f"""SELECT snap_id, state || '_' || season || '_' || strftime(cached_at, '%Y-%m') AS forecast_key,
        (SELECT string_agg(m, ',' ORDER BY pos) FROM (VALUES {', '.join(f"('{s}', {i}, {m})" for s, ms in fv.SEASON_MONTHS.items() for i, m in enumerate(ms))}) AS sm(season, pos, m)
        WHERE sm.season = fsnapshot.season) AS months FROM fsnapshot""",
    # --- shaping
    "clean_columns": 'SELECT row_key, crop, state AS state_name, season, crop_year, area AS cost_of_area, "yield" FROM production',
    "feature_projection": "SELECT row_key, "
    + ", ".join(c if c in ("crop", "state", "season", "crop_year", "area") else f"cast(NULL as double) AS {c}" for c in fv.FEATURES)
    + " FROM production",
    "completeness": f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE {' AND '.join(f'{f} IS NOT NULL' for f in W)}) AS kept,
        count(*) FILTER (WHERE {' OR '.join(f'{f} IS NULL' for f in W)}) AS dropped FROM enriched_gaps""",
    "feature_catalog": f"""SELECT feature, {_DISPLAY} AS display,
        case when feature IN ('crop', 'state', 'season') then 'categorical' when feature IN ({', '.join(f"'{w}'" for w in W)}) then 'weather'
        when feature = '{fv.IRRIGATION}' then 'irrigation' when feature = '{fv.FERTILIZER}' then 'fertilizer' else 'numerical' end AS kind,
        case when feature IN ({', '.join(f"'{w}'" for w in W)}) then 'daily observations / seasonal forecast'
        when feature = '{fv.IRRIGATION}' then 'irrigation dimension / user' when feature = '{fv.FERTILIZER}' then 'fertilizer dimension / user'
        else 'dataset' end AS origin, n_values FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, count({c}) AS n_values FROM enriched" for c in fv.FEATURES)})""",
    "features_with_values": "SELECT feature, n_values, n_values > 0 AS available FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n_values FROM enriched" for c in W) + ")",
    # --- insights
    "yield_by_crop": f"""SELECT crop, {rnd('avg("yield")', 4)} AS mean_yield FROM production GROUP BY 1""",
    "yield_of_first_crops": f"""SELECT crop, {rnd('avg("yield")', 4)} AS mean_yield FROM production
        WHERE crop IN (SELECT DISTINCT crop FROM production ORDER BY crop LIMIT 5) GROUP BY 1""",
    "top_states": f"""SELECT state, {rnd('avg("yield")', 4)} AS mean_yield FROM production GROUP BY 1
        ORDER BY avg("yield") DESC, state LIMIT 15""",
    "yield_trend": f"""SELECT crop_year, {rnd('avg("yield")', 4)} AS mean_yield FROM production GROUP BY 1""",
    "first_by_state": "SELECT state, arg_min(irrigation_coverage_pct, row_key) AS irrigation_coverage_pct FROM enriched GROUP BY 1",
    "yield_histogram": _histogram("production", '"yield"'),
    "yield_histogram_by_crop": _histogram("production", '"yield"', "crop"),
    "corr_matrix": _correlations("enriched"),
    "profile": """SELECT count(*) AS n_rows, count(DISTINCT state) AS states, min(crop_year) AS first_year, max(crop_year) AS last_year,
        count(DISTINCT (state, crop_year)) AS combos FROM production""",
    "area_stats": "SELECT " + ", ".join(
        f"{rnd(f'{fn}(area)', 1)} AS {name}"
        for name, fn in (("min", "min"), ("max", "max"), ("mean", "avg"), ("median", "median"), ("std", "stddev_samp"))
    ) + " FROM production",
    "domains": " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS domain, cast({c} as varchar) AS value FROM production" for c in (*fv.CATEGORICAL, "crop_year")
    ),
    "box_stats": f"""SELECT crop, count("yield") AS n, {rnd('min("yield")', 4)} AS lowest, {_QUANT.replace("value", '"yield"')},
        {rnd('max("yield")', 4)} AS highest FROM production GROUP BY 1""",
    "describe": f"""SELECT feature, count(value) AS "count", {rnd('avg(value)', 4)} AS mean, {rnd('stddev_samp(value)', 4)} AS std,
        {rnd('min(value)', 4)} AS "min", {_QUANT}, {rnd('max(value)', 4)} AS "max"
        FROM ({_long(CORR_COLUMNS, 'enriched')}) GROUP BY 1""",
    "insight_trend": f"""SELECT crop_year, {rnd('avg("yield")', 4)} AS mean_yield FROM production
        WHERE crop IN (SELECT DISTINCT crop FROM production ORDER BY crop LIMIT 5) GROUP BY 1""",
    "insight_by_crop": f"""SELECT crop, {rnd('avg("yield")', 4)} AS mean_yield FROM picked GROUP BY 1""",
    "insight_top_states": f"""SELECT state, {rnd('avg("yield")', 4)} AS mean_yield FROM picked GROUP BY 1
        ORDER BY avg("yield") DESC, state LIMIT 15""",
    "insight_distribution": _histogram("picked", '"yield"', "crop"),
    "insight_scatter": " UNION ALL ".join(
        f"""SELECT '{w}' AS feature, crop, count(*) FILTER (WHERE {w} IS NOT NULL) AS n, {rnd(f'corr({w}, "yield")', 6)} AS corr,
        {rnd(f'regr_slope("yield", {w})', 4)} AS slope FROM picked GROUP BY 2""" for w in W
    ),
    "insight_irrigation": f"""SELECT state, arg_min({fv.IRRIGATION}, row_key) AS {fv.IRRIGATION} FROM picked
        WHERE {fv.IRRIGATION} IS NOT NULL GROUP BY 1""",
    "insight_fertilizer": f"""SELECT state, arg_min({fv.FERTILIZER}, row_key) AS {fv.FERTILIZER} FROM picked
        WHERE {fv.FERTILIZER} IS NOT NULL GROUP BY 1""",
    "insight_correlation": _correlations("picked"),
    "insight_preview": """SELECT row_key, crop, state, season, crop_year, area, "yield", (SELECT count(*) FROM picked) AS total_rows
        FROM picked ORDER BY row_key LIMIT 200""",
    "feature_counts": f"""SELECT w AS pipeline_features, w AS model_features, w AS schema_features, true AS all_match FROM (
        SELECT cast(count(DISTINCT crop) + count(DISTINCT state) + count(DISTINCT season) - 3 + {len(fv.NUMERICAL)} as int) AS w
        FROM labelled WHERE split = 'train')""",
    "current_risk": _current_risk(),
    "scatter_points": f"""SELECT crop, {rnd('mean_temperature', 6)} AS mean_temperature, "yield" FROM enriched""",
    "scatter_summary": f"""SELECT crop, count(*) FILTER (WHERE mean_temperature IS NOT NULL) AS n,
        {rnd('corr(mean_temperature, "yield")', 6)} AS corr, {rnd('regr_slope("yield", mean_temperature)', 4)} AS slope FROM enriched GROUP BY 1""",
    "preview": """SELECT row_key, crop, state, season, crop_year, area, "yield", (SELECT count(*) FROM production) AS total_rows
        FROM production ORDER BY row_key LIMIT 200""",
    "yield_gauge": f"""SELECT crop, state, {rnd('y', 4)} AS mean_yield,
        case when y > 100 then ceil(y * 1.3e0 / 10) * 10 else 100.0e0 end AS gauge_max,
        case when y < (case when y > 100 then ceil(y * 1.3e0 / 10) * 10 else 100.0e0 end) * 0.33e0 then 'low'
        when y < (case when y > 100 then ceil(y * 1.3e0 / 10) * 10 else 100.0e0 end) * 0.66e0 then 'middle' else 'high' end AS gauge_band
        FROM (SELECT crop, state, avg("yield") AS y FROM production GROUP BY 1, 2)""",
    # --- split and feature statistics
    "stratified_split": "SELECT row_key, crop, split FROM labelled",
    "plain_split": """SELECT row_key, case when rn <= ceil(0.2e0 * n) then 'test' else 'train' end AS split FROM (
        SELECT row_key, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42:' || row_key)) AS rn FROM production)""",
    "split_sizes": "SELECT split, count(*) AS n FROM labelled GROUP BY 1",
    "split_files": f"SELECT split, crop, count(*) AS n, {rnd('sum(area)', 4)} AS area FROM labelled GROUP BY 1, 2",
    "impute_medians": f"SELECT feature, {rnd('median', 6)} AS median FROM med_gaps",
    "impute_modes": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, (SELECT {c} FROM labelled WHERE split = 'train' GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode"
        for c in fv.CATEGORICAL
    ),
    "scale_stats": f"SELECT feature, {rnd('mean', 6)} AS mean, {rnd('scale', 6)} AS scale FROM scale",
    "onehot_labels": " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS value, cast(row_number() OVER (ORDER BY {c}) - 1 as int) AS slot FROM (SELECT DISTINCT {c} FROM labelled WHERE split = 'train')"
        for c in fv.CATEGORICAL
    ),
    "encoded_features": f"""SELECT row_key, concat_ws(',', {', '.join(
        f"case when {c} <> (SELECT min({c}) FROM filled) then 'cat__{c}_' || {c} end" for c in fv.CATEGORICAL)}) AS hot,
        {', '.join(rnd(f"({c} - (SELECT mean FROM scale WHERE feature = '{c}')) / (SELECT scale FROM scale WHERE feature = '{c}')", 6) + f' AS num__{c}' for c in fv.NUMERICAL)}
        FROM filled""",
    "feature_names": "SELECT cast(row_number() OVER (ORDER BY g, v) - 1 as int) AS position, name, feature FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS g, {c} AS v, 'cat__{c}_' || {c} AS name, '{c}' AS feature FROM (SELECT DISTINCT {c} FROM filled) WHERE {c} <> (SELECT min({c}) FROM filled)"
        for i, c in enumerate(fv.CATEGORICAL)
    )
    + "".join(f" UNION ALL SELECT {10 + i}, '', 'num__{c}', '{c}'" for i, c in enumerate(fv.NUMERICAL)) + ")",
    "feature_schema": f"""SELECT count(*) AS n_training_samples, string_agg(DISTINCT crop, ',' ORDER BY crop) AS unique_crop,
        string_agg(DISTINCT state, ',' ORDER BY state) AS unique_state, string_agg(DISTINCT season, ',' ORDER BY season) AS unique_season,
        string_agg(DISTINCT crop_year, ',' ORDER BY crop_year) AS unique_crop_year,
        cast(count(DISTINCT crop) + count(DISTINCT state) + count(DISTINCT season) + {len(fv.NUMERICAL)} as int) AS n_output_features,
        {rnd('min(area)', 1)} AS area_min, {rnd('max(area)', 1)} AS area_max, {rnd('avg(area)', 1)} AS area_mean,
        {rnd('median(area)', 1)} AS area_median, {rnd('stddev_samp(area)', 1)} AS area_std
        FROM enriched WHERE {' AND '.join(f'{f} IS NOT NULL' for f in W)}""",
    # --- metrics
    "regression_metrics": f"SELECT {_METRICS} FROM scored",
    "per_crop_metrics": f"SELECT crop, {_METRICS} FROM scored GROUP BY 1",
    "residuals": f"SELECT row_key, {rnd('y_pred - y_true', 6)} AS residual FROM scored",
    "residual_histogram": _histogram("(SELECT y_pred - y_true AS residual FROM scored)", "residual"),
    "prediction_range": f"""SELECT {rnd('lo', 4)} AS lowest, {rnd('hi', 4)} AS highest, {rnd('lo - (hi - lo) * 0.05e0', 4)} AS axis_low,
        {rnd('hi + (hi - lo) * 0.05e0', 4)} AS axis_high FROM (SELECT min(v) AS lo, max(v) AS hi FROM (
        SELECT y_true AS v FROM scored UNION ALL SELECT y_pred FROM scored))""",
    # --- requests
    "validate_requests": """SELECT request_id, crop, state, season, crop_year, area, irrigation_pct, npk_kg_per_ha, use_forecast, errors,
        errors = '' AS valid FROM validated""",
    "override_inputs": """SELECT request_id, state, irrigation_coverage_pct, irrigation_source, npk_consumption_kg_per_ha, npk_source
        FROM overridden""",
    "route_weather": f"""SELECT request_id, state, season, crop_year, {ROUNDED_WEATHER},
        {', '.join(f'{rnd("hist_" + f, 6)} AS hist_{f}' for f in W)}, weather_source, forecast_confidence FROM routed""",
    "input_summary": f"SELECT request_id, feature, {_DISPLAY} AS display, value, source FROM ({_summaries()})",
}
BODIES["rejected_requests"] = "SELECT request_id, errors FROM validated WHERE errors <> ''"
BODIES["stream_rejected_requests"] = BODIES["rejected_requests"]
BODIES["stream_validated_requests"] = BODIES["validate_requests"]

# --- checks beside the answers of the fitted model: which rows and rules there must be, and the parts that follow from the inputs
_VALID = "(SELECT request_id FROM validated WHERE errors = '')"
_ENCODED = "(SELECT " + " + ".join(f"count(DISTINCT {c}) - 1" for c in fv.CATEGORICAL) + f" + {len(fv.NUMERICAL)} FROM filled)"


def _kept(keys: str, key: str, *rules: str) -> str:
    return f"SELECT {key}, rule, true AS holds FROM {keys}, (VALUES {', '.join(f'($${r}$$)' for r in rules)}) AS r_(rule)"


_WHOLE = """(SELECT n_name AS state, 20 + (n_nationkey * 13 % 17) * 4.5e0 AS irrigation_coverage_pct,
    cast(30 + (n_nationkey * 29 % 23) * 9 as double) AS npk_consumption_kg_per_ha FROM nation)"""
_CONTRIBUTION_RULES = ("as many rows as asked for", "largest first", "direction", "adds up to the score", "breakdown")
_COMBINATIONS = prod(len(v) for v in fv.GRID.values())
BODIES |= {
    "tree_predictions": "SELECT row_key, true AS same FROM labelled WHERE split = 'test'",
    "tree_importances": f"SELECT name AS feature, true AS same FROM ({BODIES['feature_names']})",
    "tree_contribution_checks": _kept(_VALID, "request_id", *_CONTRIBUTION_RULES),
    "raw_feature_contribution_checks": _kept(_VALID, "request_id", *_CONTRIBUTION_RULES),
    "contribution_checks": _kept(_VALID, "request_id", *_CONTRIBUTION_RULES),
    "model_scores_checks": f"""SELECT row_key, crop, {rnd('"yield"', 6)} AS y_true, true AS scored FROM labelled WHERE split = 'test'""",
    "training_record_checks": f"""SELECT '{fv.TRAINED_VERSION}' AS model_version, 'GBTRegressor' AS model_type, {fv.SEED} AS random_seed,
        count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
        cast({_ENCODED} as int) AS n_features, {fv.FOLDS} AS folds, least(10000, count(*) FILTER (WHERE split = 'train')) AS search_rows,
        true AS metrics_agree, true AS from_the_grid, true AS best_of_search, true AS passed_the_gate FROM labelled""",
    "search_checks": f"SELECT cast(i as int) AS rank, true AS of_the_grid, true AS once, true AS descending FROM range(1, {_COMBINATIONS + 1}) AS r_(i)",
    "evaluation_per_crop_checks": f"SELECT crop, count(*) AS n, true AS sound FROM ({BODIES['plain_split']}) JOIN production USING (row_key) WHERE split = 'test' GROUP BY 1",
    "evaluation_record_checks": f"""SELECT sum(n) FILTER (WHERE split = 'test')::BIGINT AS n_samples, sum(n) FILTER (WHERE split = 'train')::BIGINT AS n_train,
        sum(n) FILTER (WHERE split = 'test')::BIGINT AS n_test, {fv.SEED} AS seed, cast(DATE '{AS_OF}' - 365 AS varchar) || ' to {AS_OF}' AS weather_period,
        {len(fv.FEATURES)} AS total_input, cast({_ENCODED} as int) AS total_encoded,
        string_agg(crop || ':' || n, ',' ORDER BY crop) FILTER (WHERE split = 'test') AS crops, true AS sound
        FROM (SELECT crop, split, count(*) AS n FROM ({BODIES['plain_split']}) JOIN production USING (row_key) GROUP BY 1, 2)""",
    "scored_request_checks": _kept(
        _VALID, "request_id", "score of the model, not below 0", "history only beside a forecast", "difference to history",
        "small differences are not shown", "dial", "version and unit",
    ),
    "stream_answers_agree": f"SELECT request_id, true AS same FROM {_VALID}",
    "background_checks": f"SELECT cast(c as int) AS cluster, name AS feature, true AS holds FROM range(10) AS r_(c), ({BODIES['feature_names']})",
    "whole_irrigation_report": f"""SELECT state, irrigation_coverage_pct, {_band('irrigation_coverage_pct', fv.IRRIGATION_BANDS, 1)} AS category,
        {_band('irrigation_coverage_pct', fv.IRRIGATION_BANDS, 2)} AS description FROM {_WHOLE}""",
    "whole_fertilizer_report": f"""SELECT state, npk_consumption_kg_per_ha, {_band('npk_consumption_kg_per_ha', fv.FERTILIZER_BANDS, 1)} AS category,
        {_band('npk_consumption_kg_per_ha', fv.FERTILIZER_BANDS, 2)} AS description FROM {_WHOLE}""",
    "whole_input_enrichment": f"SELECT row_key, state, irrigation_coverage_pct, npk_consumption_kg_per_ha FROM production JOIN {_WHOLE} USING (state)",
    "absent_dimensions": "SELECT state, count(*) AS n, "
    + ", ".join(f"count(*) AS no_{c}" for c in W)
    + f", {fv.DEFAULT_IRRIGATION!r}e0 AS irrigation, {fv.DEFAULT_FERTILIZER!r}e0 AS npk FROM production GROUP BY 1",
    # Exact sums: at six digits a few means lie between two results, and sums of doubles in any order fall on either side.
    "stream_trailing_weather": "SELECT state, " + ", ".join(
        rnd(f"CAST(s_{p}{' * 365.25::DECIMAL(6, 2)' if p == 'PRECTOTCORR' else ''} AS DOUBLE) / n_{p}", 6) + f" AS {f}" for p, f in fv.DAILY_PARAMETERS.items()
    )
    + " FROM (SELECT state, "
    + ", ".join(
        f"CAST(sum(CAST(val AS DECIMAL(28, 10))) FILTER ({w}) AS DECIMAL(28, 10)) AS s_{p}, count(val) FILTER ({w}) AS n_{p}"
        for p in fv.DAILY_PARAMETERS
        for w in [f"WHERE param = '{p}' AND val > -990"]
    )
    + f" FROM observations WHERE obs_date BETWEEN DATE '{AS_OF}' - 365 AND DATE '{AS_OF}' GROUP BY 1)",
    "stored_schema_document": BODIES["feature_schema"],
    "merged_record": f"""SELECT 'GBTRegressor' AS model_type, (SELECT count(*) FROM labelled WHERE split = 'train') AS n_train, count(*) AS n_evaluated,
        count(DISTINCT crop) AS n_crops FROM ({BODIES['plain_split']}) JOIN production USING (row_key) WHERE split = 'test'""",
    "reloaded_model": "SELECT row_key, true AS same FROM labelled WHERE split = 'test'",
    "numeric_columns": " UNION ALL ".join(f"""SELECT '{c}' AS name, count("{c}") AS n FROM production""" for c in ("crop_year", "area", "production", "yield")),
    "missing_features": " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n FROM production" for c in (*W, fv.IRRIGATION, fv.FERTILIZER)),
    "leakage_guard": " UNION ALL ".join(
        f"SELECT '{form}' AS form, state, count(*) AS n, {passes} AS passes FROM production GROUP BY 2"
        for form, passes in (("raw", "false"), ("cleaned", "true"), ("no target", "false"))
    ),
    "forced_refresh": f"""SELECT state, crop_year, case when crop_year < 1995 then -1.0e0 else {rnd('mean_temperature', 6)} end AS mean_temperature
        FROM yearly""",
    "risk_response_checks": "SELECT state, true AS same FROM recent",
}


def all_statements() -> dict[str, str]:
    return {name: statement(body) for name, body in BODIES.items()}
