"""Keys, names and calendar expressions."""

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, functions as F

from harvestline import fixed_values as fv


def lookup(table: Mapping, key: Column) -> Column:
    """Value of a small fixed table as an expression, NULL where the key is absent."""
    entries = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*entries), key)


def canonical_name(name: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Trimmed name, or the name an alias stands for."""
    trimmed = F.trim(name)
    if not aliases:
        return trimmed
    return F.coalesce(lookup(aliases, F.lower(trimmed)), trimmed)


def canonical_season(season: Column) -> Column:
    cleaned = F.upper(F.trim(season))
    return F.coalesce(lookup(fv.SEASON_ALIASES, cleaned), cleaned)


def season_months(season: Column) -> Column:
    """Months of a season; an unknown season covers the year."""
    months = F.create_map(
        *[e for name, ms in fv.SEASON_MONTHS.items() for e in (F.lit(name), F.array(*[F.lit(m) for m in ms]))]
    )
    return F.coalesce(
        F.try_element_at(months, canonical_season(season)), F.sequence(F.lit(1), F.lit(12))
    )


def seasons_of_month(month: Column) -> Column:
    """Seasons that contain a month. Seasons overlap, so this is a list."""
    return F.filter(
        F.array(*[F.when(month.isin(ms), F.lit(name)) for name, ms in fv.SEASON_MONTHS.items()]),
        lambda s: s.isNotNull(),
    )


def display_name(column: Column) -> Column:
    """The fixed display name, else title case, where a letter after a digit also counts as a start."""
    words = F.regexp_extract_all(F.replace(column, F.lit("_"), F.lit(" ")), F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.coalesce(lookup(fv.DISPLAY_NAMES, column), F.array_join(F.transform(words, F.initcap), ""))


def state_year_key(state: Column, year: Column) -> Column:
    return F.concat_ws("_", F.trim(state), F.coalesce(year.cast("string"), F.lit("LATEST")))


def forecast_key(state: Column, season: Column, as_of: Column) -> Column:
    return F.concat_ws("_", state, canonical_season(season), F.date_format(as_of, "yyyy-MM"))


def key_state(key: Column) -> Column:
    """Everything before the last underscore."""
    return F.regexp_extract(key, r"^(.*)_([^_]*)$", 1)


def key_year(key: Column) -> Column:
    """Number after the last underscore, NULL when it is not a number."""
    return F.regexp_extract(key, r"^(.*)_([^_]*)$", 2).try_cast("int")


def wall_clock(text: Column) -> Column:
    """ISO text to a timestamp without zone; the zone suffix is cut off, bad text gives NULL."""
    return F.regexp_replace(text, r"Z|\+.*$", "").try_cast("timestamp_ntz")


def as_date(as_of: date | str) -> Column:
    return F.lit(str(as_of)).cast("date")


def period_start(as_of: date | str) -> Column:
    return F.date_sub(as_date(as_of), fv.TRAILING_DAYS)


def period_label(as_of: date | str) -> Column:
    return F.concat(
        F.date_format(period_start(as_of), "yyyy-MM-dd"), F.lit(" to "), F.date_format(as_date(as_of), "yyyy-MM-dd")
    )


def year_start(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def year_end(year: Column) -> Column:
    return F.make_date(year, F.lit(12), F.lit(31))
