"""Arithmetic of counters (tid, value): pointwise on common ids, union-add, and the sum over ids that all have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _common(a: DataFrame, b: DataFrame, value) -> DataFrame:
    return a.join(b.withColumnRenamed("value", "other"), "tid").select("tid", value.alias("value"))


def common_sum(*counters: DataFrame) -> DataFrame:
    """The sum of the values of each id that all counters have."""
    rows = reduce(DataFrame.unionByName, counters)
    return rows.groupBy("tid").agg(F.sum("value").alias("value"), F.count("*").alias("n")).filter(F.col("n") == len(counters)).drop("n")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    return _common(a, b, F.col("value") * F.col("other"))


def ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    return _common(a, b, F.try_divide(F.col("value"), F.col("other")))


def floor_divided(a: DataFrame, n: int) -> DataFrame:
    """Values divided by n and rounded down; ids whose value becomes 0 stay."""
    return a.select("tid", F.floor(F.col("value") / n).alias("value"))


def positive(a: DataFrame) -> DataFrame:
    return a.filter("value > 0")


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sum over all ids of either; values that are not positive are dropped."""
    return positive(a.unionByName(b).groupBy("tid").agg(F.sum("value").alias("value")))


def increased(a: DataFrame, b: DataFrame) -> DataFrame:
    """a with b's values added to the ids that a has."""
    return a.join(b.withColumnRenamed("value", "other"), "tid", "left").select("tid", (F.col("value") + F.coalesce("other", F.lit(0))).alias("value"))
