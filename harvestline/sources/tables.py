"""The order tables seen as production, weather, forecast and request data.

Each view is a projection of given tables; filters and column pruning reach the parquet scans.
No join carries a hint: the planner broadcasts a side when its file size is under the session's limit
and falls back to a shuffle join, split at run time on hot keys, when it is not.
"""

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

ROW_KEY = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint))"
)
SEASON = (
    "case when month(l_shipdate) between 6 and 9 then 'KHARIF' when month(l_shipdate) in (10, 11) then 'AUTUMN' "
    "when month(l_shipdate) in (12, 1, 2) then 'WINTER' else 'SUMMER' end"
)
PARAM = (
    "case l_orderkey % 4 when 0 then 'T2M' when 1 then 'PRECTOTCORR' when 2 then 'RH2M' "
    "else 'ALLSKY_SFC_SW_DWN' end"
)
OBSERVED = (
    "case when l_partkey % 50 = 0 then cast(-999 as double) "
    "when l_orderkey % 4 = 0 then 14 + (n_nationkey % 9) * 2 + l_quantity / 25 "
    "when l_orderkey % 4 = 1 then (n_nationkey * 37 % 11) * 0.7e0 + (year(l_shipdate) % 5) * 0.2e0 + l_discount * 10 "
    "when l_orderkey % 4 = 2 then 28 + (n_nationkey * 7 % 12) * 4 + l_tax * 50 "
    "else 10 + (n_nationkey % 7) * 1.6e0 + l_discount * 5 end"
)
LOOKUP_KEY = (
    "case when c_custkey % 53 = 0 then null when c_custkey % 97 = 0 then 'orissa' when c_custkey % 6 = 0 then n_name "
    "when c_custkey % 6 = 1 then lower(n_name) when c_custkey % 6 = 2 then concat('  ', n_name, ' ') "
    "when c_custkey % 6 = 3 then concat('the ', n_name, ' area') "
    "when c_custkey % 6 = 4 then concat('UNKNOWN_', cast(n_nationkey as string)) else '' end"
)
SNAPSHOT_SEASON = (
    "case o_orderkey % 6 when 0 then 'KHARIF' when 1 then 'RABI' when 2 then 'SUMMER' when 3 then 'AUTUMN' "
    "when 4 then 'WINTER' else 'WHOLE YEAR' end"
)
REQUEST_CROP = (
    "case c_custkey % 7 when 0 then 'ECONOMY' when 1 then 'medium' when 2 then 'STANDARD' when 3 then 'SMALL' "
    "when 4 then 'Large' when 5 then 'PROMO' else 'UNKNOWN' end"
)
REQUEST_SEASON = (
    "case c_custkey % 4 when 0 then 'KHARIF' when 1 then 'autumn' when 2 then 'WINTER' else 'SUMMER' end"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _project(df: DataFrame, **columns: str) -> DataFrame:
    return df.select(*[F.expr(text).alias(name) for name, text in columns.items()])


def _lines_by_nation(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    supplier, nation = (table(spark, folder, t) for t in ("supplier", "nation"))
    lines = table(spark, folder, "lineitem") if lines is None else lines
    return lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).join(
        nation, supplier.s_nationkey == nation.n_nationkey
    )


def _orders_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer, nation = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )


def _customers_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation = (table(spark, folder, t) for t in ("customer", "nation"))
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey)


def production(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    lines = _lines_by_nation(spark, folder)
    return _project(
        lines.join(part, lines.l_partkey == part.p_partkey),
        row_key=ROW_KEY,
        crop="p_type",
        state="n_name",
        district="p_brand",
        season=SEASON,
        crop_year="cast(year(l_shipdate) as int)",
        area="l_quantity",
        production="l_extendedprice",
        **{"yield": "l_extendedprice / l_quantity"},
    )


def observations(
    spark: SparkSession, folder: str, start: date | None = None, end: date | None = None, lineitem: DataFrame | None = None
) -> DataFrame:
    """Daily readings in long form; the optional date range (both ends included) reaches the scan. `lineitem` may be a stream of that table."""
    lines = _lines_by_nation(spark, folder, lineitem)
    if start is not None:
        lines = lines.where(F.col("l_shipdate") >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        lines = lines.where(F.col("l_shipdate") < F.lit(str(end + timedelta(days=1))).cast("timestamp_ntz"))
    return _project(lines, state="n_name", obs_date="cast(l_shipdate as date)", param=PARAM, val=OBSERVED)


def irrigation(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    """Two nations are left out, so that they match by substring; `whole` has them all."""
    return _project(
        table(spark, folder, "nation").where(F.lit(whole) | F.expr("n_nationkey % 12 <> 11")),
        state="n_name",
        irrigation_coverage_pct="20 + (n_nationkey * 13 % 17) * 4.5e0",
        ord="cast(n_nationkey as bigint)",
    )


def fertilizer(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    """As `irrigation`."""
    return _project(
        table(spark, folder, "nation").where(F.lit(whole) | F.expr("n_nationkey % 12 <> 11")),
        state="n_name",
        npk_consumption_kg_per_ha="cast(30 + (n_nationkey * 29 % 23) * 9 as double)",
        ord="cast(n_nationkey as bigint)",
    )


def lookup_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _project(_customers_by_nation(spark, folder), key_id="c_custkey", state_key=LOOKUP_KEY)


def forecast_series(spark: SparkSession, folder: str) -> DataFrame:
    return _project(
        _orders_by_nation(spark, folder),
        state="n_name",
        ts="o_orderdate",
        temperature_2m="12 + o_totalprice / 25000",
        precipitation="case when o_orderkey % 17 = 0 then null else o_totalprice / 100000 end",
        relative_humidity_2m="cast(30 + o_orderkey % 61 as double)",
        shortwave_radiation="cast(100 + o_custkey % 150 as double)",
    )


def forecast_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return _project(
        _orders_by_nation(spark, folder),
        snap_id="o_orderkey",
        state="n_name",
        season=SNAPSHOT_SEASON,
        cached_at="o_orderdate",
    )


def requests(spark: SparkSession, folder: str, customers: DataFrame | None = None) -> DataFrame:
    """Scoring requests. `customers` may be a stream of the customer table."""
    nation = table(spark, folder, "nation")
    customers = table(spark, folder, "customer") if customers is None else customers
    return _project(
        customers.join(nation, customers.c_nationkey == nation.n_nationkey),
        request_id="c_custkey",
        crop=REQUEST_CROP,
        state="case when c_custkey % 5 = 0 then lower(n_name) else n_name end",
        season=REQUEST_SEASON,
        crop_year="cast(1995 + c_custkey % 9 as int)",
        area="c_acctbal / 100",
        irrigation_pct="case when c_custkey % 3 = 0 then cast(c_custkey % 121 as double) end",
        npk_kg_per_ha="case when c_custkey % 4 = 0 then cast(c_custkey % 601 as double) end",
        use_forecast="c_custkey % 2 = 0",
    )
