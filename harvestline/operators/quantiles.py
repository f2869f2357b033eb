"""Exact quantiles of any number of rows, by repeated refinement of brackets.

`median` and `percentile` collect every distinct value of a group into one buffer, which does not hold for
a measure with hundreds of billions of distinct values.  Here each wanted rank lies between two values, a bracket; one
aggregate counts the rows below it, at its ends and inside, and a mergeable sketch divides the inside into `_PIECES` parts.
The part with the rank and its neighbours is the next bracket, less than a sixtieth of the last, and so on until it can hold
`MOST` rows at most; only its values are put in order, so that no task ever orders more, whatever the size of a group.  Up to
60 times `MOST` rows of a group take two passes, 60 times that takes three.  Counts are exact: a rank outside its bracket stops
the job, so a result is exact or there is none.
"""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from harvestline.functions.numbers import nan_to_null
from harvestline.sources.stored import stored

#: Rows of one group that a task puts in order.
MOST = 50_000
_ACCURACY = 10_000
_PIECES = 256
_SHARE = 60  # a bracket holds at most four pieces of the last


def _matched(left: DataFrame, right: DataFrame, by: Sequence[str], on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Join on `by`, where NULL equals NULL, and `on`."""
    named = right.withColumnsRenamed({c: f"_right_{c}" for c in (*by, *on)})
    same = [left[c].eqNullSafe(named[f"_right_{c}"]) for c in by] + [left[c] == named[f"_right_{c}"] for c in on]
    return left.join(named, reduce(lambda a, b: a & b, same), how).drop(*[f"_right_{c}" for c in (*by, *on)])


def _inside(data: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows up to the end of each bracket of their group, with the bracket; a group has a few per probability."""
    lists = brackets.groupBy(*by).agg(F.collect_list(F.struct("low", "high")).alias("_b"))
    if by:
        lists = stored(lists, "quantile-brackets")
        rows = _matched(data, lists, by)
    else:
        rows = data.withColumn("_b", lists.select("_b").scalar())
    return rows.select(*by, "_v", F.inline("_b")).where(F.col("_v") <= F.col("high"))


def _counts(accuracy: int):
    strict = (F.col("_v") > F.col("low")) & (F.col("_v") < F.col("high"))
    pieces = [k / _PIECES for k in range(1, _PIECES)]
    return [
        F.count_if(F.col("_v") < F.col("low")).alias("below"),
        F.count_if(F.col("_v") == F.col("low")).alias("at_low"),
        F.count_if(strict).alias("strict"),
        F.count_if((F.col("_v") == F.col("high")) & (F.col("low") < F.col("high"))).alias("at_high"),
        F.percentile_approx(F.when(strict, F.col("_v")), pieces, accuracy).alias("cuts"),
    ]


def _placed(targets: DataFrame, by: Sequence[str], accuracy: int) -> DataFrame:
    """Ranks with their value, where it is an end of the bracket, or with the next bracket."""
    place = F.col("rank") - F.col("below")
    within = place - F.col("at_low")
    missed = (place < 1) | (within > F.col("strict") + F.col("at_high"))
    value = F.when(missed, F.raise_error(F.lit("a quantile's rank is outside its bracket")).cast("double"))
    value = value.when(within <= 0, F.col("low")).when(within > F.col("strict"), F.col("high"))
    share, margin = F.try_divide(within, F.col("strict")), 2.0 / accuracy
    first, last = F.floor((share - margin) * _PIECES).cast("int"), F.ceil((share + margin) * _PIECES).cast("int")
    # The first and last of a few values may lie beyond the outermost cuts.
    low = F.when(first >= 1, F.get("cuts", first - 1)).otherwise(F.col("low"))
    high = F.when(last < _PIECES, F.get("cuts", last - 1)).otherwise(F.col("high"))
    return targets.select(
        *by, "rank", "low", "high", "strict", value.alias("value"), low.alias("next_low"), high.alias("next_high")
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
    accuracy: int = _ACCURACY,
    most: int | None = None,
) -> DataFrame:
    """`(by…, n, one column per probability)` with linear interpolation between neighbours; NULLs are left out."""
    by, most = list(by), MOST if most is None else most
    data = df.select(*by, nan_to_null(F.col(value).cast("double")).alias("_v")).where(F.col("_v").isNotNull())
    ends = {"low": F.lit(float("-inf")), "high": F.lit(float("inf"))}
    found = stored(data.withColumns(ends).groupBy(*by, "low", "high").agg(F.count("*").alias("n"), *_counts(accuracy)), "quantile-counts")

    position = [F.lit(float(q)) * (F.col("n") - 1) for q in probabilities.values()]
    spots = [F.struct(F.lit(i).alias("i"), p.alias("position"), (F.floor(p) + 1).alias("_lo"), (F.ceil(p) + 1).alias("_hi")) for i, p in enumerate(position)]
    found = found.withColumn("spots", F.array(*spots))
    wanted = found.select(*by, "n", F.inline("spots"))
    targets, placed = found.withColumn("rank", F.explode(F.array_distinct(F.concat("spots._lo", "spots._hi")))), []
    while True:
        state = stored(_placed(targets, by, accuracy), "quantile-ranks")
        whole = F.col("strict") <= most
        ready = state.withColumns({"low": F.when(whole, F.col("low")).otherwise(F.col("next_low")), "high": F.when(whole, F.col("high")).otherwise(F.col("next_high"))})
        placed.append(ready.where(F.col("value").isNotNull() | (F.col("strict") <= most * _SHARE)).select(*by, "rank", "low", "high", "value"))
        open_ = ready.where(F.col("value").isNull() & (F.col("strict") > most * _SHARE)).select(*by, "rank", "low", "high")
        if not open_.limit(1).count():
            break
        rows = _inside(data, open_.select(*by, "low", "high").distinct(), by)
        found = stored(rows.groupBy(*by, "low", "high").agg(*_counts(accuracy)), "quantile-counts")
        targets = _matched(open_, found, by, ["low", "high"])

    state = reduce(DataFrame.unionByName, placed)
    left = state.where("value IS NULL")
    rows = _inside(data, left.select(*by, "low", "high").distinct(), by)
    # What lies below a bracket is counted in one row.
    values = rows.groupBy(*by, "low", "high", F.when(F.col("_v") >= F.col("low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "low", "high").orderBy(F.col("_v").asc_nulls_first()))
    ordered = values.select(*by, "low", "high", "_v", upto.alias("_upto"), (upto - F.col("_c")).alias("_from"))
    hit = _matched(left.select(*by, "rank", "low", "high"), ordered, by, ["low", "high"])
    hit = hit.where((F.col("rank") > F.col("_from")) & (F.col("rank") <= F.col("_upto"))).select(*by, "rank", F.col("_v").alias("value"))
    known = stored(state.where("value IS NOT NULL").select(*by, "rank", "value").unionByName(hit), "quantile-values")

    lower, upper = (known.select(*by, F.col("rank").alias(r), F.col("value").alias(f"{r}_v")) for r in ("_lo", "_hi"))
    both = _matched(_matched(wanted, lower, by, ["_lo"], "left"), upper, by, ["_hi"], "left")
    share = F.col("position") - F.floor("position")
    # A rank without a value would be a miss of the method, never a NULL in the answer.
    low = F.when(F.col("_lo_v").isNull() | F.col("_hi_v").isNull(), F.raise_error(F.lit("a quantile's rank has no value")).cast("double")).otherwise(F.col("_lo_v"))
    mixed = F.when(F.col("_lo_v") == F.col("_hi_v"), F.col("_lo_v")).otherwise(low + (F.col("_hi_v") - F.col("_lo_v")) * share)
    result = both.select(*by, "n", "i", mixed.alias("_q"))
    return result.groupBy(*by, "n").agg(
        *[F.max(F.when(F.col("i") == i, F.col("_q"))).alias(name) for i, name in enumerate(probabilities)]
    )
