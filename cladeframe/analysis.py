"""From classifiers' files to result tables in one call: reads, statistics, trees, comparison of samples, summaries, and their files."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import written
from .functions.ranks import target_ranks
from .functions.scores import checked_scoring, group_score
from .ontology import CELLULAR, Ontology
from .operators import cross, stats, summary, tree
from .sources import classified, sinks

#: ADD summarises besides the comparison, ONLY gives the summaries alone, AVOID leaves them out.
SUMMARIES = ("ADD", "ONLY", "AVOID")
#: Genes that a node of a gene ontology needs, below which it is folded.
LEAST_GENES = 2
#: What `Analysis.write` can write: both tables at once, one table after the other, a file a sample, sheets of counts.
OUTPUTS = ("FULL", "CSV", "TSV", "MULTICSV", "DYNOMICS")


@dataclass
class Analysis:
    """Written tables. `trees` has a row a sample and node; `derived` and `summaries` a row a kind, sample and node; None where not asked for."""

    stats: DataFrame
    samples: DataFrame
    trees: DataFrame
    order: list[str]
    ontology: Ontology
    derived: DataFrame | None = None
    summaries: DataFrame | None = None
    scoring: str = "SHEL"

    def everything(self) -> DataFrame:
        """(sample, kind, rank, raw_sample, tid, acc, count, score) of raw, derived and summary samples, each with a name of its own."""
        found = self.trees.select("sample", F.lit("RAW").alias("kind"), *(F.lit(None).cast("string").alias(c) for c in ("rank", "raw_sample")), "tid", "acc", "count", "score")
        for part, rank in ((self.derived, F.lower("rank")), (self.summaries, F.lit("SUMMARY"))):
            if part is not None:
                shown = part if "rank" in part.columns else part.withColumn("rank", F.lit(None).cast("string"))
                name = F.concat_ws("_", "raw_sample", "kind", rank).alias("sample")
                found = found.unionByName(shown.select(name, "kind", "rank", "raw_sample", "tid", "acc", "count", "score"))
        return found

    def names(self) -> list[str]:
        """All samples: raw ones in order, then the others by name."""
        others = self.everything().filter("kind != 'RAW'").select("sample").distinct().orderBy("sample").collect()  # a few for each raw sample
        return [*self.order, *(r.sample for r in others)]

    def write(self, path: str, kind: str = "FULL") -> None:
        """The results as files below `path`, in one of the OUTPUTS."""
        if kind not in OUTPUTS:
            raise ValueError(f"no such output: {kind}")
        figures = stats.statistics_table(self.stats, self.order)
        if kind == "DYNOMICS":
            sheets = sinks.dynomics(self.everything(), self.ontology)
            return sinks.publish(path, {"stat": figures, "sheets": sheets})
        everything = self.everything()
        if kind == "MULTICSV":
            sinks.write_table(figures, f"{path}/stat")
            return sinks.write_samples(sinks.described(everything, self.ontology), f"{path}/samples")
        data = sinks.wide(everything, self.ontology, self.names())
        if kind == "FULL":
            return sinks.publish(path, {"stat": figures, "data": data})
        sinks.write_table(figures, f"{path}/stat", kind.lower())
        sinks.write_table(data, f"{path}/data", kind.lower())

    def write_chart(self, path: str, title: str = "Samples") -> None:
        """A page with the trees of all samples, to a local path."""
        everything = self.everything()
        kinds = everything.select("sample", "kind", "rank").distinct().collect()  # a few for each raw sample
        attributes = {r.sample: r.attributes for r in stats.chart_attributes(self.stats).collect()}
        sinks.write_chart(everything, self.ontology, self.names(), path, title, {r.sample: (r.kind, r["rank"]) for r in kinds}, attributes, self.scoring)


def sample_name(path: str) -> str:
    """A sample's name: its file's name without the extension."""
    return re.sub(r"\.[^.]*(\.gz|\.bz2)?$", "", path.rstrip("/").rsplit("/", 1)[-1])


def output_name(first: str, go: bool = False) -> str:
    """A name for results after the first file: what stands before _mhl, or before _go."""
    return re.split("_go" if go else "_mhl", first.rstrip("/").rsplit("/", 1)[-1])[0]


def read_samples(spark: SparkSession, reader: str, paths: list[str], form: classified.GenericFormat | None = None) -> tuple[DataFrame, list[str]]:
    """The reads of all files, written, and the samples' names in order. A single folder stands for the files in it that the reader takes."""
    if len(paths) == 1 and (inside := classified.folder_inputs(spark, paths[0], reader)):
        paths = inside
    names = [sample_name(p) for p in paths]
    if len(set(names)) < len(names):
        raise ValueError("two files have the same name")
    reads = None
    for name, path in zip(names, paths):
        part = classified.generic(spark, path, form) if reader == "generic" else classified.READERS[reader](spark, path)
        part = part.withColumn("sample", F.lit(name))
        reads = part if reads is None else reads.unionByName(part)
    return written(reads, "reads"), names


def analyse(
    spark: SparkSession, reader: str, paths: list[str], ontology: Ontology, controls: int = 0, scoring: str | None = None, minscore: float | None = None,
    control_minscore: float | None = None, mintaxa: int | None = None, control_mintaxa: int | None = None, ranks: list[str] | None = None, summaries: str = "ADD",
    form: classified.GenericFormat | None = None, strain: bool = True, take_out_root: bool = False, collapse: bool = True, avoid_cross: bool = False, **limits: float,
) -> Analysis:
    """Compares the samples of files; the first `controls` files are the controls.

    A control without reads that pass is an error, as nothing can be told from it; another sample without any is left out with a
    warning. Without `ranks`, all target ranks are compared, of a gene ontology its depths; `strain` tells whether strains are among them.
    `collapse` moves reads of "cellular organisms" to the root, `take_out_root` leaves out what stands at the root itself.
    Raw trees average scores as they are; the comparison averages logarithms (scoring LOGLENGTH) as powers of ten. What is compared are
    the folded trees: a node's own reads carry the mean score of all below it. Where ranks do not fall along each path, the comparison
    follows the literal rules.
    """
    if summaries not in SUMMARIES:
        raise ValueError(f"no such choice of summaries: {summaries}")
    if controls > len(paths) and len(paths) > 1:
        raise ValueError("there are more controls than samples")
    go, scoring = reader == "go", checked_scoring(reader, scoring)
    reads, names = read_samples(spark, reader, paths, form)
    own_limit = control_minscore if control_minscore is not None else minscore
    least = F.when(F.col("sample").isin(names[:controls]), F.lit(own_limit)).otherwise(F.lit(minscore)).cast("double")
    reads = tree.collapsed_reads(reads.withColumn("node", F.col("tid")), CELLULAR, ontology.root, "node") if collapse and not go else reads.withColumn("node", F.col("tid"))
    figures = stats.sample_stats(reads, least, classified.MEASURE.get(scoring, "score"), "node", ontology.root if take_out_root else None)
    figures = written(figures.withColumn("is_ctrl", F.col("sample").isin(names[:controls])).withColumn("score_limit", least), "stats")

    kept = classified.passing(reads, scoring, minscore, control_minscore, names[:controls]).withColumn("tid", F.col("node"))
    if take_out_root:
        kept = tree.without_root(kept, ontology.root)
    means = kept.groupBy("sample", "tid").agg(F.count("*").alias("count"), group_score(scoring, F.col("score"), F.col("length")).alias("score"))
    counts = written(tree.weighed(means), "counts")
    samples = written(stats.samples_of(figures, controls, names, None if go else mintaxa, None if go else control_mintaxa), "samples")
    # A gene ontology is folded by genes; what its samples are compared by is told from their reads.
    fold = F.lit(LEAST_GENES if mintaxa is None else mintaxa) if go else F.col("mintaxa")
    acc = tree.accumulated(tree.selected(counts, ontology), ontology).join(samples.select("sample", fold.alias("least")), "sample")
    trees = written(tree.folded(acc, ontology, F.col("least")).drop("least").filter((F.col("acc") > 0) | (F.col("tid") == ontology.root)), "trees")

    full = {r.sample for r in trees.filter("count > 0").select("sample").distinct().collect()}  # the few files of a study
    if void := [n for n in names[:controls] if n not in full]:
        raise ValueError(f"controls without reads: {', '.join(void)}")
    for name in names[controls:]:
        if name not in full:
            warnings.warn(f"sample without reads: {name}", stacklevel=2)
    order = [n for n in names if n in full]
    trees = trees.filter(F.col("sample").isin(order))
    figures = written(stats.with_folded(figures, trees), "stats")
    samples = samples.filter(F.col("sample").isin(order))
    found = Analysis(figures, samples, tree.with_scores(trees), order, ontology, scoring=scoring)
    if len(order) < 2 or avoid_cross:
        return found
    ranks, log = ranks or target_ranks(strain, go), scoring == "LOGLENGTH"
    compared = written(tree.weighed(tree.with_scores(trees).filter("count > 0"), log), "compared")
    derived = cross.cross_analysis(compared, trees, samples, ontology, ranks, log, **limits)
    derived = written(tree.with_scores(derived, log), "derived")
    if summaries != "ONLY":
        found.derived = derived
    if summaries != "AVOID":
        found.summaries = written(summary.summarised(derived.select("kind", "rank", "raw_sample", "tid", "count", "score"), ontology, ranks), "summaries")
    return found

