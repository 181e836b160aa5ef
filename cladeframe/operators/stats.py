"""Statistics of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import auto_mintaxa, length_text, share
from ..ontology import Ontology, orphans


#: Statistics in the order in which tables list them, with their titles.
TITLES = {
    "seqs_read": "Seqs. read", "seqs_unclassified": "Seqs. unclass.", "seqs_classified": "Seqs. class.", "seqs_filtered": "Seqs. filtered",
    "score_min": "Score min", "score_mean": "Score mean", "score_max": "Score max", "length_min": "Length min", "length_mean": "Length mean", "length_max": "Length max",
    "nt_read": "Total nt read", "ids_classified": "TIDs class.", "ids_filtered": "TIDs filtered", "ids_folded": "TIDs folded", "score_limit": "Score limit",
}


def sample_stats(reads: DataFrame, minscore: float | Column | None = None, measure: str = "score", node: str = "tid", without: str | None = None) -> DataFrame:
    """A row a sample of reads (sample, tid, length, score, unclassified, bad).

    Bad lines count only as such. All others are read, and their lengths add up to nt_read. Scores and lengths are of the
    classified reads whose `measure` is `minscore` at least, a number or a column; the mean length is cut to a whole number. NaN
    stands for ratios of nothing. Ids that pass are counted by the column `node`, into which ids may have been moved.
    Reads of the node `without` are taken from those that passed, after the least number of reads was told from them.
    """
    good, passes = ~F.col("bad"), ~F.col("bad") & ~F.col("unclassified")
    least = minscore if isinstance(minscore, Column) else F.lit(minscore).cast("double")
    kept = F.coalesce(passes & (least.isNull() | (F.col(measure) >= least)), F.lit(False))
    when = lambda c: F.when(kept, F.col(c))
    removed = F.count_if(kept & (F.col(node) == without)) if without is not None else F.lit(0).cast("long")
    rows = reads.groupBy("sample").agg(
        F.count_if(good).alias("seqs_read"), F.count_if(good & F.col("unclassified")).alias("seqs_unclassified"), F.count_if(passes).alias("seqs_classified"),
        F.count_if(kept).alias("seqs_filtered"), F.count_if("bad").alias("seqs_bad"),
        F.count_distinct(F.when(passes, F.col("tid"))).alias("ids_classified"), F.count_distinct(when(node)).alias("ids_filtered"),
        F.coalesce(F.sum(F.when(good, F.col("length"))), F.lit(0)).cast("long").alias("nt_read"),
        F.min(when("length")).alias("length_min"), F.floor(F.avg(when("length"))).alias("length_mean"), F.max(when("length")).alias("length_max"),
        F.min(when("score")).alias("score_min"), F.avg(when("score")).alias("score_mean"), F.max(when("score")).alias("score_max"), removed.alias("removed"),
    )
    rows = rows.withColumn("mintaxa", auto_mintaxa(F.col("seqs_filtered"))).withColumn("seqs_filtered", F.col("seqs_filtered") - F.col("removed"))
    rows = rows.withColumn("ids_filtered", F.col("ids_filtered") - (F.col("removed") > 0).cast("long")).drop("removed")
    rejected = share(F.col("seqs_classified") - F.col("seqs_filtered"), F.col("seqs_classified"))
    return rows.select(
        *(c for c in rows.columns if c != "mintaxa"), share(F.col("seqs_unclassified"), F.col("seqs_read")).alias("unclassified_ratio"), rejected.alias("reject_ratio"), "mintaxa",
        length_text(F.col("nt_read")).alias("nt_text"),
    )


def with_folded(figures: DataFrame, trees: DataFrame) -> DataFrame:
    """figures with ids_folded: the nodes of each sample's folded tree that have reads of their own."""
    left = trees.filter("count > 0").groupBy("sample").agg(F.count("*").alias("ids_folded"))
    return figures.join(left, "sample", "left").withColumn("ids_folded", F.coalesce("ids_folded", F.lit(0).cast("long")))


def statistics_table(figures: DataFrame, samples: list[str]) -> DataFrame:
    """(place, statistic, a column a sample): the statistics of TITLES as rows, as numbers."""
    known = [c for c in TITLES if c in figures.columns]
    values = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(TITLES[c]).alias("statistic"), F.col(c).cast("double").alias("value")) for k, c in enumerate(known)))
    rows = figures.select("sample", F.explode(values).alias("x")).select("sample", "x.*")
    return rows.groupBy("place", "statistic").pivot("sample", samples).agg(F.first("value"))


def chart_attributes(figures: DataFrame) -> DataFrame:
    """(sample, attributes): each sample's statistics as texts by short names, for a page."""
    short = {
        "isctr": "is_ctrl", "sread": "seqs_read", "sclas": "seqs_classified", "sfilt": "seqs_filtered", "scmin": "score_min", "scavg": "score_mean", "scmax": "score_max", "lnmin": "length_min",
        "lnavg": "length_mean", "lnmax": "length_max", "tclas": "ids_classified", "tfilt": "ids_filtered", "tfold": "ids_folded", "sclim": "score_limit", "totnt": "nt_text",
    }
    pairs = [x for name, c in short.items() if c in figures.columns for x in (F.lit(name), F.coalesce(F.col(c).cast("string"), F.lit("None")))]
    return figures.select("sample", F.create_map(*pairs).alias("attributes"))


def samples_of(stats: DataFrame, controls: int, order: list[str], mintaxa: int | None = None, control_mintaxa: int | None = None) -> DataFrame:
    """(sample, ord, is_ctrl, mintaxa): the first `controls` samples in order are the controls. A control has no fall-back to `mintaxa`."""
    if controls > len(order):
        raise ValueError("there are more controls than samples")
    place = stats.sparkSession.createDataFrame([(s, k, k < controls) for k, s in enumerate(order)], "sample string, ord int, is_ctrl boolean")
    fixed = F.when(F.col("is_ctrl"), F.lit(control_mintaxa)).otherwise(F.lit(mintaxa)).cast("int")
    return place.join(stats.select("sample", "mintaxa"), "sample").select("sample", "ord", "is_ctrl", F.coalesce(fixed, "mintaxa").alias("mintaxa"))


def orphan_stats(counts: DataFrame, ontology: Ontology) -> DataFrame:
    """(sample, orphan_ids, orphan_reads): what lies outside the tree."""
    return orphans(counts, ontology).groupBy("sample").agg(F.count("*").alias("orphan_ids"), F.sum("count").alias("orphan_reads"))


def lost_reads(counts: DataFrame, fact: DataFrame, root: str) -> DataFrame:
    """(sample, lost): reads that were accepted and are not in the tree."""
    into = counts.groupBy("sample").agg(F.sum("count").alias("accepted"))
    kept = fact.filter(F.col("tid") == root).select("sample", "acc")
    return into.join(kept, "sample", "left").select("sample", (F.col("accepted") - F.coalesce("acc", F.lit(0))).alias("lost"))


def fold_report(acc: DataFrame, fact: DataFrame) -> DataFrame:
    """The nodes that went into their parents, with their accumulated reads."""
    return acc.join(fact, ["sample", "tid"], "left_anti").select("sample", "tid", "acc")


def ids_per_rank(ids: DataFrame, ontology: Ontology) -> DataFrame:
    return ids.join(ontology.nodes.select("tid", "rank"), "tid").groupBy("rank").agg(F.count("*").alias("n_ids"))


def score_extent(fact: DataFrame) -> DataFrame:
    """(score_min, score_max) over the nodes with reads."""
    return fact.filter("count > 0").agg(F.min("score").alias("score_min"), F.max("score").alias("score_max"))
