"""Report aggregates over production rows."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from harvestline import fixed_values as fv
from harvestline.functions.numbers import correlation, half_even, nan_to_null
from harvestline.operators.quantiles import exact_quantiles
from harvestline.operators.shaping import numeric_columns
from harvestline.sources.stored import stored

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def default_crops(df: DataFrame, crop: str = "crop", n: int = 5) -> DataFrame:
    """The first crops in sort order."""
    return df.select(crop).where(F.col(crop).isNotNull()).distinct().orderBy(crop).limit(n)


def filter_crops(df: DataFrame, crops: Sequence[str] | DataFrame | None = None, crop: str = "crop") -> DataFrame:
    """Rows of the chosen crops; without a choice, of the first five."""
    if crops is None:
        crops = default_crops(df, crop)
    if isinstance(crops, DataFrame):
        return df.join(crops, crop, "left_semi")
    return df.where(F.col(crop).isin(*crops))


def mean_target(df: DataFrame, by: str, target: str = fv.TARGET) -> DataFrame:
    return df.groupBy(by).agg(F.avg(target).alias(f"mean_{target}"))


def mean_target_ascending(df: DataFrame, by: str = "crop", target: str = fv.TARGET) -> DataFrame:
    return mean_target(df, by, target).orderBy(f"mean_{target}", by)


def top_groups(df: DataFrame, by: str = "state", target: str = fv.TARGET, n: int = 15) -> DataFrame:
    """The groups with the highest mean, shown from low to high."""
    top = mean_target(df, by, target).orderBy(F.desc(f"mean_{target}"), by).limit(n)
    return top.orderBy(f"mean_{target}", by)


def trend(df: DataFrame, year: str = "crop_year", target: str = fv.TARGET) -> DataFrame:
    return mean_target(df, year, target).orderBy(year)


def first_value(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """First non-NULL value of each group, groups by value."""
    present = df.where(F.col(value).isNotNull())
    # Most often the value is a property of the group.  Distinct pairs are a hash aggregate; only groups
    # with several values need the order column, whose text minimum has to sort its input.
    pairs = stored(present.select(by, value).distinct(), "group-values")
    several = pairs.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    single = pairs.join(several, by, "left_anti")
    ordered = present.join(several, by, "left_semi").groupBy(by).agg(F.min_by(value, order).alias(value))
    return single.select(by, value).unionByName(ordered).orderBy(value, by)


def histogram(df: DataFrame, value: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed on both sides."""
    present = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    span = present.agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    span = span.select(F.struct("low", "high")).scalar()
    present = present.withColumn("_r", span)
    low, high = F.col("_r.low"), F.col("_r.high")
    index = F.when(high > low, F.least(F.floor((F.col("_v") - low) / (high - low) * bins), F.lit(bins - 1))).otherwise(0)
    counted = present.groupBy(*by, index.cast("int").alias("bin")).agg(F.count("*").alias("n")).withColumn("_r", span)
    width = (high - low) / bins
    return counted.select(
        *by, "bin", (low + F.col("bin") * width).alias("bin_start"), (low + (F.col("bin") + 1) * width).alias("bin_end"), "n"
    )


def _moments(columns: int):
    """Per part of the table, for every pair of columns: rows that have both, their means, and sums of products about these means.

    The masked matrices M'M, X'M, (X²)'M and X'X of a batch, taken about the batch's own means, give all pairs at once; batches
    are merged by moving their sums to the common mean.
    """

    def work(batches):
        whole = None
        for batch in batches:
            x = np.stack([np.asarray(batch.column(i).cast(pa.float64()).fill_null(np.nan)) for i in range(columns)], axis=1)
            m = ~np.isnan(x)
            shift = np.where(m.any(axis=0), np.nanmean(np.where(m.any(axis=0), x, 0.0), axis=0), 0.0)
            x, m = np.where(m, x - shift, 0.0), m.astype(float)
            n = m.T @ m
            held = np.maximum(n, 1)
            a, b = x.T @ m / held, m.T @ x / held
            part = [n, a + shift[:, None], b + shift, (x * x).T @ m - n * a * a, m.T @ (x * x) - n * b * b, x.T @ x - n * a * b]
            whole = part if whole is None else _merged(whole, part)
        if whole is not None:
            cells = [(i, j) for i in range(columns) for j in range(i, columns)]
            named = {"l": pa.array([c[0] for c in cells], pa.int32()), "r": pa.array([c[1] for c in cells], pa.int32())}
            sums = {k: [float(v[c]) for c in cells] for k, v in zip(("n", "a", "b", "aa", "bb", "ab"), whole)}
            yield pa.RecordBatch.from_pydict(named | sums)

    return work


def _merged(one: list, two: list) -> list:
    n, held = one[0] + two[0], np.maximum(one[0] + two[0], 1)
    da, db, weight = two[1] - one[1], two[2] - one[2], one[0] * two[0] / held
    a, b = one[1] + da * two[0] / held, one[2] + db * two[0] / held
    return [n, a, b, one[3] + two[3] + da * da * weight, one[4] + two[4] + db * db * weight, one[5] + two[5] + da * db * weight]


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlations of the numeric columns; NULL where a column does not vary.

    Every task sums its rows up to one row per pair of columns; no row is repeated, and only these sums are shuffled.
    """
    columns = list(columns or numeric_columns(df))
    numbers = df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(columns)])
    schema = "l int, r int, n double, a double, b double, aa double, bb double, ab double"
    parts = stored(numbers.mapInArrow(_moments(len(columns)), schema).where("n > 0"), "moments")
    weighted = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"mean_{c}")
    means = parts.groupBy("l", "r").agg(weighted("a"), weighted("b"))
    da, db = F.col("a") - F.col("mean_a"), F.col("b") - F.col("mean_b")
    moved = {"aa": da * da, "bb": db * db, "ab": da * db}
    sums = parts.join(means, ["l", "r"]).groupBy("l", "r").agg(*[F.sum(F.col(k) + F.col("n") * d).alias(k) for k, d in moved.items()])
    # A column whose values are all the same varies by rounding at most.
    varies = parts.groupBy("l", "r").agg(F.sum("n").alias("n"))
    scale = sums.join(varies, ["l", "r"]).join(means, ["l", "r"])
    tiny = lambda k, m: F.col(k) > 1e-28 * F.col("n") * F.col(m) * F.col(m)
    both = tiny("aa", "mean_a") & tiny("bb", "mean_b")
    corr = F.when(both, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")))))
    every = df.sparkSession.createDataFrame([(i, j) for i in range(len(columns)) for j in range(i, len(columns))], "l int, r int")
    name = F.array(*[F.lit(c) for c in columns])
    cells = every.join(scale.select("l", "r", corr.alias("corr")), ["l", "r"], "left")
    pair = [F.struct(F.get(name, F.col(x)).alias("x"), F.get(name, F.col(y)).alias("y")) for x, y in (("l", "r"), ("r", "l"))]
    return cells.select(F.explode(F.array_distinct(F.array(*pair))).alias("p"), "corr").select("p.x", "p.y", "corr")


def profile(df: DataFrame) -> DataFrame:
    """Rows, distinct states, year range and distinct (state, year) combinations.

    Counting runs over the distinct combinations, which the map side already reduces.
    """
    combos = df.groupBy("state", "crop_year").agg(F.count("*").alias("_n"))
    return combos.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count_distinct("state").alias("states"),
        F.min("crop_year").alias("first_year"),
        F.max("crop_year").alias("last_year"),
        F.count("*").alias("combos"),
    )


def domains(df: DataFrame, columns: Sequence[str] = (*fv.CATEGORICAL, "crop_year")) -> DataFrame:
    """Distinct values per column as `(domain, value)` rows, sorted."""
    columns = list(columns)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    # One aggregate over the distinct combinations, then a small unpivot.
    combos = text.distinct()
    values = combos.unpivot([], columns, "domain", "value").where(F.col("value").isNotNull()).distinct()
    return values.orderBy("domain", "value")


def area_stats(df: DataFrame, column: str = "area") -> DataFrame:
    moments = df.agg(
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
    )
    median = exact_quantiles(df, column, {"median": 0.5}).select("median").scalar()
    return moments.withColumn("median", median).select(
        *[half_even(F.col(c), 1).alias(c) for c in ("min", "max", "mean", "median", "std")]
    )


def unpivoted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    columns = list(columns)
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")


def per_column(df: DataFrame, columns: Sequence[str], **statistics) -> DataFrame:
    """`(feature, one column per statistic)` from one aggregate over the columns side by side."""
    numbers = {c: F.col(c).cast("double") for c in columns}
    wide = df.agg(
        *[F.struct(*[f(x).alias(s) for s, f in statistics.items()]).alias(c) for c, x in numbers.items()]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.*")) for c in columns])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, range and quartiles, one row per numeric column."""
    columns = list(columns or numeric_columns(df))
    moments = per_column(
        df, columns, count=F.count, mean=F.avg, std=F.stddev_samp, min=F.min, max=F.max
    )
    quartiles = exact_quantiles(unpivoted(df, columns), "value", QUARTILES, ["feature"])
    return moments.join(quartiles, "feature", "left").select(
        "feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def five_numbers(df: DataFrame, by: str = "crop", value: str = fv.TARGET) -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    names = {"lowest": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "highest": 1.0}
    return exact_quantiles(df, value, names, [by])


def features_with_values(df: DataFrame, columns: Sequence[str] = tuple(fv.WEATHER)) -> DataFrame:
    columns = list(columns)
    counts = df.agg(*[F.count(c).alias(c) for c in columns])
    return counts.unpivot([], columns, "feature", "n_values").withColumn("available", F.col("n_values") > 0)


def scatter_points(df: DataFrame, feature: str, target: str = fv.TARGET, by: str = "crop", fraction: float | None = None,
                   seed: int = fv.SEED) -> DataFrame:
    """Points to plot; with `fraction` a seeded sample of them."""
    points = df.select(by, feature, target)
    return points if fraction is None else points.sample(fraction=fraction, seed=seed)


def scatter_summary(df: DataFrame, feature: str, target: str = fv.TARGET, by: str = "crop") -> DataFrame:
    """What a plot of all points would show: count, correlation and slope per group."""
    return df.groupBy(by).agg(
        F.count_if(F.col(feature).isNotNull() & F.col(target).isNotNull()).alias("n"),
        correlation(feature, target).alias("corr"),
        F.regr_slope(target, feature).alias("slope"),
    )


def preview(df: DataFrame, order: Sequence[str], n: int = 200) -> DataFrame:
    """First rows in a fixed order, each with the size of the whole table."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return df.orderBy(*order).limit(n).withColumn("total_rows", total)
