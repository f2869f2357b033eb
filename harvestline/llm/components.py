"""Connected components by alternating large and small stars, one stored edge table per round."""

from pyspark.sql import DataFrame, functions as F

from harvestline.sources.stored import stored


def _state(edges: DataFrame):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(code, root) for every node of the edges a > b; the root is the smallest node of its component.

    The number of edges never grows.  Each round first points the larger neighbours of every node at the least node
    near it, then the smaller ones; the loop ends when a round changes nothing, and then every node but the
    roots has the single edge to its root.
    """
    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pointed = large.join(least, "a")
        small = pointed.select("a", F.col("m").alias("b")).union(pointed.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = stored(small.distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("a").alias("code"), F.col("b").alias("root"))
    return roots
