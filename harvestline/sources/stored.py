"""Stored intermediate tables.

A small aggregate that is joined back to a large table is written once to the shared folder and read
back.  That does three things a plain lazy DataFrame cannot: the planner sees its true size and picks
broadcast or shuffle join by itself, every use sees the same rows even when executors are lost, and the
aggregate is not recomputed for each use.
"""

from pyspark.sql import DataFrame

from harvestline.session import scratch_path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
