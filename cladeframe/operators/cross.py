"""Comparison of samples at a rank: presence, exclusive, shared, control-subtracted and control-shared nodes.

All samples are worked on in one job, with the sample as a grouping column. `samples` is (sample, ord, is_ctrl, mintaxa).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import written
from ..functions.ranks import RANK_VALUES
from ..ontology import Ontology, is_monotone
from .tree import accumulated, anchors, exact_tree, folded, mean_score, selected, weighed

#: Limits of the decision list, all compared strictly.
EPSILON = 1e-14
OUTLIER = 5
MAGNITUDE = 3
SEVERE = 0.01
MILD = 0.001
#: Factors that make the Qn scale consistent for a law of errors.
QN_FACTORS = {"gauss": 2.2219, "cauchy": 1.2071, "negexp": 3.4760}
LABELS = ("just-ctrl", "critical", "severe", "mild", "crossover", "other")


def checked_samples(samples: DataFrame) -> tuple[int, int]:
    """How many samples there are, and how many of them are controls; an error if no sample is left besides controls."""
    n, controls = samples.agg(F.count("*"), F.count_if("is_ctrl")).first()
    if n and n == controls:
        raise ValueError("all samples are controls")
    return n, controls


def presence(fact: DataFrame, ontology: Ontology, rank_value: int) -> DataFrame:
    """(sample, tid) of the nodes of a rank that are left in each raw sample's tree."""
    ranked = ontology.nodes.filter(F.col("rank_value") == rank_value).select("tid")
    return fact.filter("acc > 0").join(ranked, "tid", "left_semi").select("sample", "tid").distinct()


def exclusive_ids(present: DataFrame) -> DataFrame:
    """(sample, tid) of nodes that only one sample has."""
    return present.groupBy("tid").agg(F.count_distinct("sample").alias("n"), F.min("sample").alias("sample")).filter("n = 1").select("sample", "tid")


def _excluding(counts: DataFrame, ontology: Ontology, excluded: DataFrame) -> DataFrame:
    """Counts without those below a node that (sample, tid) of `excluded` bars for their sample."""
    barred = excluded.select("sample", F.col("tid").alias("anc")).join(ontology.closure(), "anc").select("sample", "tid").distinct()
    return counts.join(barred, ["sample", "tid"], "left_anti")


def exclusive(counts: DataFrame, present: DataFrame, samples: DataFrame, ontology: Ontology, rank_value: int) -> DataFrame:
    """Each raw sample's tree at the rank without the nodes that any other sample has."""
    several = present.groupBy("tid").agg(F.count_distinct("sample").alias("n"), F.min("sample").alias("only"))
    # A node barred for a sample is one that another sample has: of the sample's own nodes, those that are not exclusive.
    own = anchors(selected(counts, ontology), ontology, rank_value).join(several, "tid", "left")
    kept = own.filter((F.col("n").isNull()) | ((F.col("n") == 1) & (F.col("only") == F.col("sample")))).select("sample", "tid", "count", "scored", "total")
    return _tree_of(kept, samples, ontology)


def _tree_of(own: DataFrame, samples: DataFrame, ontology: Ontology) -> DataFrame:
    """The tree above nodes of a rank, those with fewer reads than their sample's mintaxa dropped."""
    kept = written(own.join(samples.select("sample", "mintaxa"), "sample").filter("count >= mintaxa").drop("mintaxa"), "ranked")
    acc = accumulated(kept, ontology)
    return acc.join(kept.select("sample", "tid", "count"), ["sample", "tid"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def shared(partial: DataFrame, n: int | Column, least: int, ontology: Ontology, keys: list[str] = [], log: bool = False) -> DataFrame:
    """Nodes that all n samples have, from their trees at a rank: (keys, tid, acc, scored, total, count), nodes below `least` folded into parents.

    A node's count is the floor of the mean, its score the mean of the samples' scores by their reads. Above it, scores are
    averaged by the floored counts, with `log` as powers of ten.
    """
    own = partial.filter("count > 0").withColumn("score", mean_score(F.col("total"), F.col("scored"), log))
    weight = F.when(F.col("score").isNotNull(), F.col("count"))
    sums = [F.count_distinct("sample").alias("n"), F.sum("count").alias("reads"), F.try_divide(F.sum(weight * F.col("score")), F.sum(weight)).alias("score")]
    common = own.groupBy(*keys, "tid").agg(*sums).withColumn("all", F.lit(n) if isinstance(n, int) else n)
    common = common.filter("n = all").withColumn("count", F.expr("cast(reads div all as long)"))
    acc = accumulated(selected(weighed(common, log, keys), ontology), ontology, keys)
    return folded(acc, ontology, least, keys).filter("acc > 0")


def strict_control(counts: DataFrame, present: DataFrame, samples: DataFrame, ontology: Ontology, rank_value: int) -> DataFrame:
    """Each non-control sample's tree at the rank without any node that a control has."""
    in_control = present.join(samples.filter("is_ctrl").select("sample"), "sample", "left_semi").select("tid").distinct()
    plain = counts.join(samples.filter("not is_ctrl").select("sample"), "sample", "left_semi")
    own = anchors(selected(plain, ontology), ontology, rank_value).join(in_control, "tid", "left_anti")
    return _tree_of(own, samples, ontology)


def frequencies(fact: DataFrame, present: DataFrame, samples: DataFrame, root: str, keys: list[str] = []) -> DataFrame:
    """(keys, tid, sample, ord, is_ctrl, freq): the share of each sample's reads, for the nodes that some control has. Absent is 0."""
    in_control = present.join(samples.filter("is_ctrl").select("sample"), "sample", "left_semi").select(*keys, "tid").distinct()
    whole = fact.filter(F.col("tid") == root).select("sample", F.col("acc").alias("all_reads"))
    found = fact.join(in_control.select("tid"), "tid", "left_semi").join(whole, "sample").select("sample", "tid", (F.col("acc") / F.col("all_reads")).alias("freq"))
    # Samples are the few files of a study: each candidate has a row a sample.
    dense = in_control.select(*keys, "tid", F.explode(F.array(*(F.struct(F.lit(x.sample).alias("sample"), F.lit(x.ord).alias("ord"), F.lit(x.is_ctrl).alias("is_ctrl")) for x in samples.collect()))).alias("x"))
    dense = dense.select(*keys, "tid", "x.sample", "x.ord", "x.is_ctrl")
    return dense.join(found, ["sample", "tid"], "left").withColumn("freq", F.coalesce("freq", F.lit(0.0)))


def median(values: Column) -> Column:
    """The middle of an array, or the mean of its middle two."""
    ordered, n = F.array_sort(values), F.size(values)
    return (F.try_element_at(ordered, ((n + 1) / 2).cast("int")) + F.try_element_at(ordered, ((n + 2) / 2).cast("int"))) / 2


def qn_scale(values: Column, law: str = "negexp") -> Column:
    """The Qn scale of an array: an order statistic of all pairs' differences, by a factor of the law of errors; 0 below two values."""
    n = F.size(values)
    pairs = F.flatten(F.transform(values, lambda x, i: F.transform(F.slice(values, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: F.abs(x - y))))
    k = F.greatest(F.lit(1), F.floor(n * (n / 2.0 + 1) / 4).cast("int"))
    return F.coalesce(F.lit(QN_FACTORS[law]) * F.try_element_at(F.array_sort(pairs), k), F.lit(0.0))


def contaminants(
    freq: DataFrame, severe: float = SEVERE, mild: float = MILD, outlier: float = OUTLIER, magnitude: float = MAGNITUDE, keys: list[str] = [],
) -> DataFrame:
    """(keys, tid, label, sources, all_sources): what each candidate of the controls is, and the samples that a crossover comes from.

    The first that holds: in controls only; above `severe` in all controls, or in some; above `mild` in all; a
    crossover, where some sample is an outlier among all and orders of magnitude above the controls; other.
    """
    per_id = freq.groupBy(*keys, "tid").agg(
        F.collect_list(F.when(F.col("is_ctrl"), F.struct("ord", "freq"))).alias("c"),
        F.collect_list(F.when(~F.col("is_ctrl"), F.struct("ord", "sample", "freq"))).alias("s"),
    )
    rows = per_id.select(*keys, "tid", F.transform(F.array_sort("c"), lambda x: x["freq"]).alias("rc"), F.transform(F.array_sort("s"), lambda x: x["freq"]).alias("rs"), F.array_sort("s").alias("s"))
    everything = F.concat("rc", "rs")
    rows = rows.withColumn("limit", median(everything) + outlier * qn_scale(everything)).withColumn("times", F.array_max("rc") * 10.0**magnitude)
    rows = rows.withColumn("from", F.transform(F.filter("s", lambda x: (x["freq"] > F.col("limit")) & (x["freq"] > F.col("times"))), lambda x: x["sample"]))
    label = (
        F.when(F.forall("rs", lambda x: x < EPSILON), "just-ctrl").when(F.forall("rc", lambda x: x > severe), "critical")
        .when(F.exists("rc", lambda x: x > severe), "severe").when(F.forall("rc", lambda x: x > mild), "mild")
        .when(F.size("from") > 0, "crossover").otherwise("other")
    )
    crossover = F.col("label") == "crossover"
    sources = F.when(crossover, F.col("from")).otherwise(F.array().cast("array<string>")).alias("sources")
    return rows.withColumn("label", label).select(*keys, "tid", "label", sources, (crossover & (F.size("from") == F.size("rs"))).alias("all_sources"))


def exclusions(labels: DataFrame, samples: DataFrame, keys: list[str] = []) -> DataFrame:
    """(keys, sample, tid) that control subtraction bars: contaminants in all samples, crossovers where they don't come from."""
    plain = [x.sample for x in samples.filter("not is_ctrl").select("sample").collect()]  # the few files of a study
    rows = labels.filter("label != 'just-ctrl'").withColumn("sample", F.explode(F.array(*map(F.lit, plain)).cast("array<string>")))
    return rows.filter(~F.array_contains("sources", F.col("sample"))).select(*keys, "sample", "tid")


def control_subtracted(counts: DataFrame, labels: DataFrame, samples: DataFrame, ontology: Ontology, rank_value: int) -> DataFrame:
    """Each non-control sample's tree at the rank without its contaminants."""
    plain = counts.join(samples.filter("not is_ctrl").select("sample"), "sample", "left_semi")
    kept = _excluding(selected(plain, ontology), ontology, exclusions(labels, samples))
    return _tree_of(anchors(kept, ontology, rank_value), samples, ontology)


def control_shared(counts: DataFrame, labels: DataFrame, samples: DataFrame, ontology: Ontology, rank_value: int) -> DataFrame:
    """Nodes that all non-control samples have and that no control explains; crossovers from all samples stay."""
    n, least = samples.filter("not is_ctrl").agg(F.count("*"), F.min("mintaxa")).first()
    plain = counts.join(samples.filter("not is_ctrl").select("sample"), "sample", "left_semi")
    partial = _tree_of(anchors(selected(plain, ontology), ontology, rank_value), samples, ontology)
    barred = labels.filter("not all_sources").select("tid")
    ranked = partial.filter("count > 0").join(barred, "tid", "left_anti")
    return shared(ranked, n, least, ontology)


def shared_by_all(counts: DataFrame, samples: DataFrame, ontology: Ontology, rank_value: int) -> DataFrame:
    """Nodes that all raw samples have, controls too."""
    n, _ = checked_samples(samples)
    least = samples.filter("not is_ctrl").agg(F.min("mintaxa")).first()[0]
    return shared(_tree_of(anchors(selected(counts, ontology), ontology, rank_value), samples, ontology), n, least, ontology)


def _targets(ranks: list[str]) -> Column:
    """An array of the ranks and their values, to be exploded."""
    return F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(RANK_VALUES[r]).alias("target")) for r in ranks))


def presences(fact: DataFrame, ontology: Ontology, ranks: list[str]) -> DataFrame:
    """(rank, sample, tid) of the nodes of some ranks that are left in each raw sample's tree."""
    found = ontology.nodes.withColumn("x", F.explode(_targets(ranks))).filter("rank_value = x.target").select("tid", "x.rank")
    return fact.filter("acc > 0").join(found, "tid").select("rank", "sample", "tid").distinct()


def _barred(counts: DataFrame, ontology: Ontology, present: DataFrame, labels: DataFrame | None, samples: DataFrame) -> DataFrame:
    """(kind, rank, sample, tid) of the nodes of counts that a kind's comparison leaves out: those at or below a node it excludes."""
    several = present.groupBy("rank", "tid").agg(F.count_distinct("sample").alias("n"), F.min("sample").alias("only"))
    held = counts.select("sample", "tid").join(ontology.closure(), "tid").select("sample", "tid", "anc")
    others = held.join(several.withColumnRenamed("tid", "anc"), "anc").filter("n > 1 or only != sample")
    found = others.select(F.lit("EXCLUSIVE").alias("kind"), "rank", "sample", "tid")
    if labels is not None:
        dirty = held.join(exclusions(labels, samples, ["rank"]).withColumnRenamed("tid", "anc"), ["sample", "anc"])
        found = found.unionByName(dirty.select(F.lit("CTRL").alias("kind"), "rank", "sample", "tid"))
    return found.distinct()


def rank_trees(
    counts: DataFrame, present: DataFrame, labels: DataFrame | None, samples: DataFrame, ontology: Ontology, ranks: list[str], exact: bool,
) -> DataFrame:
    """The trees at all ranks of all raw samples: (kind, rank, sample, tid, acc, scored, total, count).

    kind is EXCLUSIVE, CTRL (with `labels`; no controls) or PARTIAL, which excludes nothing. All of them are made at
    once, with kind and rank as grouping columns. `exact` follows the literal rules level by level; else the closed form
    is taken, which is right where ranks fall along each path.
    """
    kinds = F.array(*(F.lit(k) for k in ("EXCLUSIVE", "PARTIAL", *(["CTRL"] if labels is not None else []))))
    allowed = samples.select("sample", F.col("mintaxa").alias("least"), "is_ctrl").withColumn("kind", F.explode(kinds)).filter("not (is_ctrl and kind = 'CTRL')").drop("is_ctrl")
    chosen = selected(counts, ontology)
    if exact:
        rows = chosen.join(allowed, "sample").withColumn("x", F.explode(_targets(ranks))).select("*", "x.rank", "x.target").drop("x")
        rows = rows.join(_barred(chosen, ontology, present, labels, samples), ["kind", "rank", "sample", "tid"], "left_anti")
        return written(exact_tree(rows, ontology, "least", "target", True, ["kind", "rank", "sample"]), "rank-trees")
    # Ranks fall: a node at the rank that is excluded takes just its own reads along, so nodes at the ranks say all.
    ranked = ontology.nodes.withColumn("x", F.explode(_targets(ranks))).filter("rank_value = x.target").select(F.col("tid").alias("anc"), "x.rank")
    sums = [F.sum(c).alias(c) for c in ("count", "scored", "total")]
    own = chosen.join(ontology.closure().join(ranked, "anc"), "tid").groupBy("rank", "sample", "anc").agg(*sums).withColumnRenamed("anc", "tid")
    own = own.join(allowed, "sample").filter("count >= least").drop("least")
    several = present.groupBy("rank", "tid").agg(F.count_distinct("sample").alias("n"), F.min("sample").alias("only"))
    own = own.join(several, ["rank", "tid"], "left").filter("kind != 'EXCLUSIVE' or n is null or (n = 1 and only = sample)").drop("n", "only")
    if labels is not None:
        dirty = exclusions(labels, samples, ["rank"]).select(F.lit("CTRL").alias("kind"), "rank", "sample", "tid")
        own = own.join(dirty, ["kind", "rank", "sample", "tid"], "left_anti")
    keys = ["kind", "rank", "sample"]
    own = written(own, "ranked")
    acc = accumulated(own, ontology, keys)
    return written(acc.join(own.select(*keys, "tid", "count"), [*keys, "tid"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long"))), "rank-trees")


def cross_analysis(
    counts: DataFrame, fact: DataFrame, samples: DataFrame, ontology: Ontology, ranks: list[str], log: bool = False, exact: bool | None = None, **limits: float,
) -> DataFrame:
    """All derived samples at all ranks: (kind, rank, raw_sample, tid, acc, scored, total, count). Empty ones have no rows.

    kind is EXCLUSIVE, SHARED, CTRL or CONTROL_SHARED. With fewer than two samples there is nothing to compare. All ranks go
    through the same few jobs. With `log`, totals are of powers of ten, as weighed() makes them. Whether ranks fall along
    each path is tested, unless `exact` says that the literal rules shall or need not be followed. `limits` are those of
    contaminants().
    """
    n, controls = checked_samples(samples)
    if n < 2 or not ranks:
        schema = "kind string, rank string, raw_sample string, tid string, acc long, scored long, total double, count long"
        return counts.sparkSession.createDataFrame([], schema)
    exact = not is_monotone(ontology) if exact is None else exact
    present = written(presences(fact, ontology, ranks), "present")
    labels = None
    if controls:
        labels = written(contaminants(frequencies(fact, present, samples, ontology.root, ["rank"]), keys=["rank"], **limits), "labels")
    trees = rank_trees(counts, present, labels, samples, ontology, ranks, exact)
    partial = trees.filter("kind = 'PARTIAL'").drop("kind").withColumn("kind", F.lit("SHARED"))
    least = samples.filter("not is_ctrl").agg(F.min("mintaxa")).first()[0]
    if controls:
        plain = partial.join(samples.filter("not is_ctrl").select("sample"), "sample", "left_semi").withColumn("kind", F.lit("CONTROL_SHARED"))
        explained = labels.filter("not all_sources").select("rank", F.col("tid").alias("anc")).join(ontology.closure(), "anc").select("rank", "tid").distinct()
        partial = partial.unionByName(plain.join(explained, ["rank", "tid"], "left_anti"))
    needed = F.when(F.col("kind") == "SHARED", n).otherwise(n - controls)
    common = shared(partial, needed, least, ontology, ["kind", "rank"], log).withColumn("sample", F.lit(None).cast("string"))
    found = trees.filter("kind != 'PARTIAL' and acc > 0").unionByName(common)
    return found.select("kind", "rank", F.col("sample").alias("raw_sample"), "tid", "acc", "scored", F.col("total").cast("double").alias("total"), "count")
