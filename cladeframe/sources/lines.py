"""Lines of text files with their places, without gathering a file in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(spark: SparkSession, paths: str | list[str], whole_line: str | None = None) -> DataFrame:
    """(file, line, value): each line with its number in its file, from 0. `whole_line` is another line separator.

    Lines of a block of a file are read in order by one task, so that numbers follow from the blocks' line counts:
    a table with one row a block.
    """
    options = {"lineSep": whole_line} if whole_line else {}
    rows = spark.read.options(**options).text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select(F.col("file").alias("of"), F.col("block").alias("at"), "first", before.alias("before"))
    return rows.join(placed, (F.col("file") == F.col("of")) & (F.col("block") == F.col("at"))).select("file", (F.col("id") - F.col("first") + F.col("before")).alias("line"), "value")


def until_bad(rows: DataFrame, bad) -> DataFrame:
    """The rows of each file before its first one that is bad."""
    ends = rows.filter(bad).groupBy(F.col("file").alias("of")).agg(F.min("line").alias("end"))
    return rows.join(ends, F.col("file") == F.col("of"), "left").filter("end is null or line < end").drop("of", "end")
