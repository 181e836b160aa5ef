"""Reads that arrive over time: counts by sample and node that are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(reads: DataFrame) -> DataFrame:
    """A stream of reads (sample, tid, score) as counts (sample, tid, count, scored, total), for roll-ups over the latest state.

    State grows with the nodes seen, not with the reads. Comparisons between samples need all samples and stay batch jobs.
    """
    return reads.groupBy("sample", "tid").agg(F.count("*").alias("count"), F.count("score").alias("scored"), F.sum("score").alias("total"))
