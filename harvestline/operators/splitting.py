"""Reproducible train/test split with exact shares.

Rows are ordered by a seeded hash of their key and the first share of each stratum is the test set.
Instead of sorting a stratum in one task, hash prefixes are counted and the prefix where the share ends is
found from the counts.  While more than `MOST` rows have that prefix, it is lengthened and only they are counted again;
in the end the few rows below it are ranked.  The result is a hash threshold per stratum, so labelling a row is a
comparison and the large table is never shuffled.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from harvestline import fixed_values as fv
from harvestline.sources.stored import stored


#: Rows of a stratum that a task ranks.
MOST = 50_000
#: Digits of the first prefix: 4,096 counts a stratum, so that a task adds its rows up before they are shuffled.
FIRST_DIGITS = 3
_DIGITS = 32  # of a hash


def _hash(key: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))


def split_thresholds(
    df: DataFrame,
    key: str,
    strata: Sequence[str] = (),
    fraction: float = fv.TEST_FRACTION,
    seed: int = fv.SEED,
    prefix_digits: int = FIRST_DIGITS,
    most: int = MOST,
) -> DataFrame:
    """`(strata…, n, n_test, threshold)`: a row is test when its hash is at most the threshold."""
    strata = list(strata)
    hashed = df.select(*strata, _hash(key, seed).alias("_h"))
    prefix = lambda digits: F.substring("_h", 1, digits)
    counts = hashed.groupBy(*strata, prefix(prefix_digits).alias("_p")).agg(F.count("*").alias("_c"))
    sizes = stored(counts, "split-prefixes")
    total = sizes.groupBy(*strata).agg(F.sum("_c").alias("n"))
    share = F.when(F.col("n") >= 2, F.ceil(F.lit(fraction) * F.col("n"))).otherwise(F.lit(0)).cast("bigint")
    total = stored(total.withColumn("n_test", share).withColumns({"_need": F.col("n_test"), "_edge": F.lit("")}), "split-sizes")
    counts, digits = _beside(sizes, total, strata, 0), prefix_digits
    while True:
        # At most 16 ** prefix_digits rows per stratum and edge.
        before = Window.partitionBy(*strata, "_edge").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("_upto", F.sum("_c").over(before))
        hit = upto.where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_c") < F.col("_need")))
        left = F.col("_need") - (F.col("_upto") - F.col("_c"))
        edge = stored(hit.select(*strata, "n", "n_test", F.col("_p").alias("_edge"), left.alias("_need"), "_c"), "split-edges")
        if digits >= _DIGITS or (edge.agg(F.max("_c")).first()[0] or 0) <= most:
            break
        near = _beside(hashed, edge.drop("_c"), strata, digits)
        digits = min(_DIGITS, digits + prefix_digits)
        counts = near.groupBy(*strata, "n", "n_test", "_need", "_edge", prefix(digits).alias("_p")).agg(F.count("*").alias("_c"))
    near = _beside(hashed, edge.drop("_c"), strata, digits)
    rank = F.row_number().over(Window.partitionBy(*strata, "_edge").orderBy("_h"))
    at_edge = near.withColumn("_rank", rank).where(F.col("_rank") == F.col("_need"))
    return stored(at_edge.select(*strata, "n", "n_test", F.col("_h").alias("threshold")), "split-thresholds")


def _beside(rows: DataFrame, edges: DataFrame, strata: Sequence[str], digits: int) -> DataFrame:
    """The rows whose hash starts with the edge (`digits` long) of their stratum, with its columns."""
    columns = [c for c in edges.columns if c not in strata]
    starts = F.substring(rows["_h"], 1, digits) if digits else F.lit("")
    if not strata:
        one = edges.select(F.struct(*columns)).scalar()
        return rows.withColumn("_e", one).where(starts == F.col("_e._edge")).select(*rows.columns, "_e.*")
    same = [rows[c].eqNullSafe(edges[c]) for c in strata] + [starts == edges["_edge"]]
    return rows.join(edges, same).select(*[rows[c] for c in rows.columns], *[edges[c] for c in columns])


def split(
    df: DataFrame,
    key: str,
    strata: Sequence[str] = (),
    fraction: float = fv.TEST_FRACTION,
    seed: int = fv.SEED,
    prefix_digits: int = FIRST_DIGITS,
    most: int = MOST,
) -> DataFrame:
    """`df` with a `split` column. The key must be unique; a stratum of one row goes to train."""
    strata = list(strata)
    limits = split_thresholds(df, key, strata, fraction, seed, prefix_digits, most)
    if strata:
        same = [df[c].eqNullSafe(limits[c]) for c in strata]
        joined = df.join(limits, same, "left").select(*[df[c] for c in df.columns], "threshold")
    else:
        joined = df.withColumn("threshold", limits.select("threshold").scalar())
    is_test = F.coalesce(_hash(key, seed) <= F.col("threshold"), F.lit(False))
    return joined.select(*df.columns, F.when(is_test, "test").otherwise("train").alias("split"))


def split_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("split").agg(F.count("*").alias("n"))
