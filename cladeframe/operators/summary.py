"""Summaries of cross analysis over ranks: what a sample has of a kind, whatever the rank it was found at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written
from ..ontology import Ontology

KEYS = ["kind", "raw_sample"]


def summarised(derived: DataFrame, ontology: Ontology, ranks: list[str]) -> DataFrame:
    """(kind, raw_sample, tid, acc, count, score) of derived (kind, rank, raw_sample, tid, count, score).

    Counts of a node are added over ranks and its score is that of the last rank in order. From the deepest level up, each
    node then gives up the reads that are already counted below it: if it has as many, they are taken off and what it
    had is passed on; if not, it stays and the sum is passed on. Nodes without reads are left out of the result,
    and a node without reads of its own has the mean score of its children, by their accumulated reads.
    """
    derived = derived.withColumn("raw_sample", F.coalesce("raw_sample", F.lit("")))  # what is shared has no sample, and must meet itself in joins
    order = F.array_position(F.array(*map(F.lit, ranks)), F.col("rank"))
    own = derived.filter("count > 0 or score is not null").groupBy(*KEYS, "tid").agg(F.sum("count").alias("count"), F.max_by("score", F.when(F.col("score").isNotNull(), order)).alias("score"))
    paths = ontology.closure()
    depths = paths.groupBy("tid").agg(F.max("dist").alias("depth"))
    parents = ontology.nodes.select("tid", F.when(F.col("tid") != ontology.root, F.col("parent")).alias("parent"))
    grown = own.join(paths, "tid").select(*KEYS, F.col("anc").alias("tid")).distinct().join(own, [*KEYS, "tid"], "left")
    grown = written(grown.join(depths, "tid").join(parents, "tid").withColumn("count", F.coalesce("count", F.lit(0).cast("long"))), "summary", by="depth")
    deepest = grown.agg(F.max("depth")).first()[0]
    if deepest is None:
        return _shown(grown.withColumn("acc", F.col("count")))
    found, rising = [], None
    for depth in range(deepest, -1, -1):
        level = grown.filter(F.col("depth") == depth)
        if rising is None:
            level = level.withColumns({"below": F.lit(0).cast("long"), "below_acc": F.lit(0).cast("long"), "below_score": F.lit(None).cast("double")})
        else:
            level = level.join(rising, [*KEYS, "tid"], "left")
        below = F.coalesce("below", F.lit(0))
        enough = F.col("count") >= below
        rest = F.when(enough, F.col("count") - below).otherwise(F.col("count"))
        level = level.select(*KEYS, "tid", "parent", rest.alias("count"), (F.coalesce("below_acc", F.lit(0)) + rest).alias("acc"), F.when(rest > 0, F.col("score")).otherwise(F.col("below_score")).alias("score"), F.when(enough, F.col("count")).otherwise(F.col("count") + below).alias("passed"))
        level = written(level, "summary-level")
        found.append(level.filter("acc > 0").select(*KEYS, "tid", "acc", "count", "score"))
        weight = F.when(F.col("score").isNotNull(), F.col("acc"))
        rising = level.filter("parent is not null").groupBy(*KEYS, F.col("parent").alias("tid")).agg(F.sum("passed").alias("below"), F.sum("acc").alias("below_acc"), F.try_divide(F.sum(weight * F.col("score")), F.sum(weight)).alias("below_score"))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return _shown(result)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("kind", F.nullif(F.col("raw_sample"), F.lit("")).alias("raw_sample"), "tid", "acc", "count", "score")
