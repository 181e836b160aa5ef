"""Roll-up of counts and scores over an ontology.

Counts come as (sample, tid, count, scored, total): reads, reads that have a score, and the sum of their scores, in
any numeric type. Sums are kept apart from means so that integer scores stay exact; with_scores() divides once at
the end. `extra` grouping columns, such as a kind or a rank, may stand beside `sample`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions.ranks import TOP_VALUE, at_or_below, below
from ..ontology import Ontology

MEASURES = ["acc", "scored", "total"]
#: Decades by which powers of ten are moved: scores between -146 and 446 neither vanish nor overflow, however many are summed.
LOG_SHIFT = 154.0


def _powers(score: Column, log: bool) -> Column:
    """What is summed of a score: with `log`, its power of ten, moved by LOG_SHIFT decades so that 0 and 308 both have room."""
    return F.pow(F.lit(10.0), score - LOG_SHIFT) if log else score


def mean_score(total: Column, scored: Column, log: bool = False) -> Column:
    """The mean of `scored` scores whose sum, as _powers() has it, is `total`; null if there are none."""
    mean = total.cast("double") / F.when(scored > 0, scored)
    return F.log10(mean) + LOG_SHIFT if log else mean


def counts_of(reads: DataFrame, keys: list[str] = ["sample"], log: bool = False) -> DataFrame:
    """Reads (sample, tid, score) by node. With `log`, scores are summed as powers of ten, in one pass."""
    return reads.groupBy(*keys, "tid").agg(F.count("*").alias("count"), F.count("score").alias("scored"), F.sum(_powers(F.col("score"), log)).alias("total"))


def weighed(means: DataFrame, log: bool = False, keys: list[str] = ["sample"]) -> DataFrame:
    """Counts (keys, tid, count, score) with each mean score as the sum of as many equal scores: (keys, tid, count, scored, total)."""
    scored = F.when(F.col("score").isNotNull(), F.col("count")).otherwise(0).cast("long")
    return means.select(*keys, "tid", "count", scored.alias("scored"), F.coalesce(_powers(F.col("score"), log) * F.col("count"), F.lit(0.0)).alias("total"))


def with_scores(fact: DataFrame, log: bool = False) -> DataFrame:
    """fact with `score`, the mean, in place of its parts."""
    return fact.withColumn("score", mean_score(F.col("total"), F.col("scored"), log)).drop("scored", "total")


def selected(counts: DataFrame, ontology: Ontology) -> DataFrame:
    """Counts of the nodes that the ontology's includes and excludes leave: below an included node, not below an excluded one."""
    found = counts
    paths = ontology.closure()
    if ontology.include and ontology.root not in ontology.include:
        inside = paths.filter(F.col("anc").isin(*ontology.include)).select("tid").distinct()
        found = found.join(inside, "tid", "left_semi")
    if excluded := [x for x in ontology.exclude if x != ontology.root]:
        outside = paths.filter(F.col("anc").isin(*excluded)).select("tid").distinct()
        found = found.join(outside, "tid", "left_anti")
    return found


def accumulated(counts: DataFrame, ontology: Ontology, keys: list[str] = ["sample"]) -> DataFrame:
    """(keys, tid, acc, scored, total) of each node and all that is below it. Ids without a path to the root don't count."""
    sums = counts.join(ontology.rooted(), "tid").groupBy(*keys, "anc").agg(F.sum("count").alias("acc"), F.sum("scored").alias("scored"), F.sum("total").alias("total"))
    return sums.withColumnRenamed("anc", "tid")


def folded(acc: DataFrame, ontology: Ontology, mintaxa: int | Column, keys: list[str] = ["sample"]) -> DataFrame:
    """Nodes with at least `mintaxa` accumulated reads, and the root; `count` has the reads of the others below a node.

    `mintaxa` may be a column of `acc`.
    """
    least = F.lit(mintaxa) if isinstance(mintaxa, int) else mintaxa
    kept = acc.filter((F.col("acc") >= least) | (F.col("tid") == ontology.root))
    parents = ontology.nodes.filter("parent != tid").select("tid", "parent")
    below_kept = kept.join(parents, "tid").groupBy(*keys, F.col("parent").alias("tid")).agg(F.sum("acc").alias("kept_below"))
    found = kept.join(below_kept, [*keys, "tid"], "left")
    return found.withColumn("count", F.col("acc") - F.coalesce("kept_below", F.lit(0))).drop("kept_below")


def rollup(counts: DataFrame, ontology: Ontology, mintaxa: int | Column = 1, keys: list[str] = ["sample"]) -> DataFrame:
    """The tree of each sample: (keys, tid, acc, scored, total, count), small nodes folded into their parents."""
    return folded(accumulated(selected(counts, ontology), ontology, keys), ontology, mintaxa, keys)


def anchors(counts: DataFrame, ontology: Ontology, rank_value: int, keys: list[str] = ["sample"]) -> DataFrame:
    """Reads by their ancestor or self of just that rank; reads without such an ancestor are dropped."""
    ranked = ontology.nodes.filter(F.col("rank_value") == rank_value).select(F.col("tid").alias("anc"))
    paths = ontology.closure().join(ranked, "anc", "left_semi")
    sums = counts.join(paths, "tid").groupBy(*keys, "anc").agg(*(F.sum(c).alias(c) for c in ("count", "scored", "total")))
    return sums.withColumnRenamed("anc", "tid")


def at_rank(counts: DataFrame, ontology: Ontology, rank_value: int, mintaxa: int | Column = 1, keys: list[str] = ["sample"]) -> DataFrame:
    """The tree of each sample above the nodes of a rank that have `mintaxa` reads: (keys, tid, acc, scored, total, count).

    Smaller nodes are dropped and not folded. Exact where ranks fall along each path; exact_tree() does the others.
    """
    least = F.lit(mintaxa) if isinstance(mintaxa, int) else mintaxa
    kept = anchors(selected(counts, ontology), ontology, rank_value, keys).filter(F.col("count") >= least)
    acc = accumulated(kept, ontology, keys)
    own = kept.select(*keys, "tid", "count")
    return acc.join(own, [*keys, "tid"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def _levels(ontology: Ontology) -> tuple[DataFrame, int]:
    """Nodes on the root's tree with their depth, rank values, and the rank of the nearest ranked node above."""
    paths = ontology.closure()
    depths = paths.groupBy("tid").agg(F.max("dist").alias("depth"), F.max((F.col("anc") == ontology.root).cast("int")).alias("rooted")).filter("rooted = 1").drop("rooted")
    values = ontology.nodes.select(F.col("tid").alias("anc"), F.when(F.col("anc") == ontology.root, TOP_VALUE).otherwise(F.col("rank_value")).alias("anc_value"), F.col("rank").alias("anc_rank"))
    above = paths.filter("dist > 0").join(values, "anc").filter((F.col("anc_rank") != "NO_RANK") | (F.col("anc") == ontology.root))
    near = above.groupBy("tid").agg(F.min_by("anc_value", "dist").alias("parent_value"))
    nodes = ontology.nodes.select("tid", F.when(F.col("tid") == ontology.root, None).otherwise(F.col("parent")).alias("parent"), "rank_value")
    found = written(nodes.join(depths, "tid").join(near, "tid", "left"), "levels")
    return found, found.agg(F.max("depth")).first()[0] or 0


def exact_tree(
    counts: DataFrame, ontology: Ontology, mintaxa: int | str = 1, rank: int | str | None = None, just_rank: bool = False, keys: list[str] = ["sample"],
) -> DataFrame:
    """The tree by its literal rules, level by level from the deepest; right for any order of ranks along paths.

    A child is pruned if it has fewer than `mintaxa` reads, or at `rank` if it, its parent or the nearest ranked node
    above the parent is at that rank or below. A pruned child's reads go to its parent; with `just_rank` only if the
    parent is at the rank, or the ranked node above it is at it or below; other reads vanish. Each level is one grouped
    sum, written before the next. `mintaxa` and `rank` (a rank's value) may be columns of counts that are alike in each
    group of `keys`, so that trees of many ranks and kinds rise level by level together.
    """
    named = [c for c in (mintaxa, rank) if isinstance(c, str)]
    keys, out = [*keys, *(c for c in named if c not in keys)], keys
    least = F.col(mintaxa) if isinstance(mintaxa, str) else F.lit(mintaxa)
    target = F.col(rank) if isinstance(rank, str) else F.lit(rank)
    nodes, deepest = _levels(ontology)
    own = selected(counts, ontology).join(nodes, "tid")
    if just_rank and rank is not None:
        own = own.filter(at_or_below(F.col("rank_value"), target) | at_or_below(F.coalesce("parent_value", F.lit(TOP_VALUE)), target))
    own = own.select(*keys, "tid", "depth", F.col("count").alias("acc"), "count", "scored", "total")
    tops = nodes.select(F.col("tid").alias("parent"), F.col("rank_value").alias("top_value"), F.col("parent_value").alias("top_parent"))
    sums = [F.sum(c).alias(c) for c in ("acc", "count", "scored", "total")]
    kept, rising = [], None
    for depth in range(deepest, -1, -1):
        level = own.filter(F.col("depth") == depth).drop("depth")
        if rising is not None:
            level = level.unionByName(rising)
        level = level.groupBy(*keys, "tid").agg(*sums).join(nodes.select("tid", "parent", "rank_value"), "tid").join(tops, "parent", "left")
        small = F.col("acc") < least
        moves, pruned = F.lit(not just_rank), small
        if rank is not None:
            above = at_or_below(F.coalesce("top_parent", F.lit(TOP_VALUE)), target)
            at_prune = below(F.col("rank_value"), target) | at_or_below(F.col("top_value"), target) | above
            pruned = small | at_prune
            if just_rank:
                moves = at_prune & ((F.col("top_value") == target) | above)
        level = written(level.withColumn("pruned", F.col("parent").isNotNull() & pruned).withColumn("moves", moves), "level")
        kept.append(level.filter("not pruned").select(*out, "tid", *MEASURES, "count"))
        gone = level.filter("parent is not null and pruned and moves and acc > 0").select(*keys, F.col("parent").alias("tid"), "acc", "count", "scored", "total")
        stays = level.filter("parent is not null and not pruned").select(*keys, F.col("parent").alias("tid"), "acc", F.lit(0).cast("long").alias("count"), "scored", "total")
        rising = gone.unionByName(stays)
    found = kept[0]
    for part in kept[1:]:
        found = found.unionByName(part)
    return found


def selected_ids(ontology: Ontology, include: list[str], exclude: list[str], parity: bool = False) -> DataFrame:
    """tid of the nodes that an extraction takes.

    A node counts by its nearest ancestor or self that is listed: included ones are taken, excluded ones not; without
    any included all others are taken. With `parity` and nothing included, only the excluded nodes themselves go.
    """
    if parity and not include:
        return ontology.nodes.select("tid").filter(~F.col("tid").isin(*exclude)) if exclude else ontology.nodes.select("tid")
    listed = ontology.closure().filter(F.col("anc").isin(*include, *exclude))
    nearest = listed.groupBy("tid").agg(F.min_by("anc", "dist").alias("by"))
    taken = ontology.nodes.select("tid").join(nearest, "tid", "left")
    default = F.lit(not include)
    return taken.filter(F.when(F.col("by").isNull(), default).otherwise(F.col("by").isin(*include))).select("tid")


def listed_ids(ontology: Ontology, include: list[str] = [], exclude: list[str] = [], mindepth: int = 0, maxdepth: int = 0, just_rank: str | None = None) -> DataFrame:
    """tid of the selected nodes of the root's tree from a depth on and above another, at one rank or at all.

    The root's depth is 1. No `maxdepth`, or 0, is no limit; nodes at `maxdepth` itself are out.
    """
    depths = ontology.rooted().groupBy("tid").agg(F.count("*").alias("depth")).filter(F.col("depth") >= mindepth)
    if maxdepth:
        depths = depths.filter(F.col("depth") < maxdepth)
    found = selected_ids(ontology, include, exclude).join(depths, "tid", "left_semi")
    if just_rank is not None:
        found = found.join(ontology.nodes.filter(F.col("rank") == just_rank).select("tid"), "tid", "left_semi")
    return found


def collapsed_reads(reads: DataFrame, collapse: str = "131567", root: str = "1", column: str = "tid") -> DataFrame:
    """Reads of "cellular organisms" as reads of the root, so that a mean over the root's reads has both."""
    return reads.withColumn(column, F.when(F.col(column) == collapse, root).otherwise(F.col(column)))


def without_root(counts: DataFrame, root: str) -> DataFrame:
    """Counts or reads without those of the root itself."""
    return counts.filter(F.col("tid") != root)
