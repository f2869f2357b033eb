"""Tiered reference match: exact name, same name in another case, substring either way, default.

Works on distinct keys.  Every tier is an equi-join: the substring tier joins on the parts of a name
instead of comparing every key with every name, so no tier grows with keys times names and the planner is
free to broadcast or shuffle any side.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from harvestline.functions.text import canonical_name


def _parts(text: Column, lengths: Column) -> Column:
    """All substrings of `text` that have one of the lengths."""
    size = F.length(text)
    windows = F.transform(
        F.filter(lengths, lambda n: n <= size),
        lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(text, i, n)),
    )
    return F.array_distinct(F.flatten(windows))


def _first(rows: DataFrame, by: str, order: str, payload: str, alias: str) -> DataFrame:
    """The payload of the first dimension row per `by`, with its position in front."""
    return rows.groupBy(by).agg(F.min_by(F.struct(order, payload), order).alias(alias))


def tiered_match(
    keys: DataFrame,
    key: str,
    dimension: DataFrame,
    values: Sequence[str],
    defaults: Sequence,
    aliases: Mapping[str, str] | None = None,
    name: str = "state",
    order: str = "ord",
    empty_key: str = "first",
) -> DataFrame:
    """`(key, values…, match_tier)` for every distinct non-NULL key.

    Within a tier the first dimension row wins.  With `empty_key="first"` an empty key is contained in every
    name and takes the first row; with `"default"` it takes the defaults.  Tier 4 is the default.
    """
    wanted = keys.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    wanted = wanted.withColumn("_name", canonical_name(F.col(key), aliases))
    wanted = wanted.withColumn("_lower", F.lower("_name"))
    names = dimension.select(
        F.col(name).alias("_dim_name"),
        F.lower(name).alias("_dim_lower"),
        F.col(order).alias("_ord"),
        F.struct(*values).alias("_values"),
    )

    exact = _first(names, "_dim_name", "_ord", "_values", "_exact")
    caseless = _first(names, "_dim_lower", "_ord", "_values", "_caseless")
    found = wanted.join(exact, wanted["_name"] == exact["_dim_name"], "left").join(
        caseless, wanted["_lower"] == caseless["_dim_lower"], "left"
    )
    found = found.select(key, "_lower", "_exact", "_caseless")

    # Names that contain the key: the key is one of the parts of the name.
    lower = F.col("_dim_lower")
    all_lengths = F.sequence(F.lit(0), F.length(lower))
    name_parts = names.select(F.explode(_parts(lower, all_lengths)).alias("_part"), "_ord", "_values")
    holders = _first(name_parts, "_part", "_ord", "_values", "_holder")

    # Names contained in the key: the name is one of the parts of the key.  Only the lengths that
    # names have are tried, and only for keys the first two tiers left open.
    lengths = names.agg(F.collect_set(F.length("_dim_lower")).alias("n")).scalar()
    open_keys = found.where(F.col("_exact").isNull() & F.col("_caseless").isNull()).select(key, "_lower")
    key_parts = open_keys.withColumn("_lengths", lengths).select(
        key, F.explode(_parts(F.col("_lower"), F.col("_lengths"))).alias("_part")
    )
    held = key_parts.join(caseless, key_parts["_part"] == caseless["_dim_lower"])
    held = held.groupBy(F.col(key).alias("_held_key")).agg(F.min("_caseless").alias("_held"))

    found = found.join(holders, found["_lower"] == holders["_part"], "left").join(
        held, found[key] == held["_held_key"], "left"
    )
    partial = F.least("_holder", "_held")
    if empty_key == "default":
        partial = F.when(F.col(key) != "", partial)
    tier = (
        F.when(F.col("_exact").isNotNull(), 1)
        .when(F.col("_caseless").isNotNull(), 2)
        .when(F.col("_partial").isNotNull(), 3)
        .otherwise(4)
    )
    found = found.withColumn("_partial", partial).withColumn(
        "_best", F.coalesce("_exact", "_caseless", "_partial")
    )
    return found.select(
        key,
        *[F.coalesce(F.col(f"_best._values.{v}"), F.lit(d)).alias(v) for v, d in zip(values, defaults)],
        tier.alias("match_tier"),
    )
