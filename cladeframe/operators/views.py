"""What a viewer of a tree asks for: search, shares among siblings, order of children, chains and leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ontology import Ontology

KEYS = ["sample"]


def search(fact: DataFrame, ontology: Ontology, text: str) -> DataFrame:
    """(sample, tid, hits): nodes that have a match below or in themselves, with the number of nodes that match. Case is ignored."""
    return subtree_hits(fact, ontology, ontology.names.filter(F.lower("name").contains(text.lower())).select("tid"))


def subtree_hits(fact: DataFrame, ontology: Ontology, ids: DataFrame) -> DataFrame:
    """(sample, tid, hits): how many of the nodes of `ids` (tid) a sample has below or in each node."""
    found = fact.select(*KEYS, "tid").join(ids.distinct(), "tid", "left_semi").join(ontology.closure(), "tid")
    return found.groupBy(*KEYS, F.col("anc").alias("tid")).agg(F.count("*").alias("hits"))


def sibling_shares(fact: DataFrame, ontology: Ontology) -> DataFrame:
    """(sample, parent, tid, acc, place, before, share): children in falling order, what the ones before hold, and their share of the parent."""
    parents = ontology.nodes.filter(F.col("tid") != ontology.root).select("tid", "parent")
    rows = fact.join(parents, "tid").join(fact.select(*KEYS, F.col("tid").alias("parent"), F.col("acc").alias("whole")), [*KEYS, "parent"])
    order = Window.partitionBy(*KEYS, "parent").orderBy(F.desc("acc"), "tid")
    return rows.select(*KEYS, "parent", "tid", "acc", F.row_number().over(order).alias("place"), (F.sum("acc").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("acc")).alias("before"), (F.col("acc") / F.col("whole")).alias("share"))


def children_by_score(fact: DataFrame, ontology: Ontology) -> DataFrame:
    """(sample, parent, tid, score, place): children in falling order of score, those without score last."""
    parents = ontology.nodes.filter(F.col("tid") != ontology.root).select("tid", "parent")
    order = Window.partitionBy(*KEYS, "parent").orderBy(F.desc_nulls_last("score"), "tid")
    return fact.join(parents, "tid").select(*KEYS, "parent", "tid", "score", F.row_number().over(order).alias("place"))


def chains(fact: DataFrame, ontology: Ontology) -> DataFrame:
    """(sample, parent, tid): children that hold all of their parent's reads, so that the two can be drawn as one."""
    parents = ontology.nodes.filter(F.col("tid") != ontology.root).select("tid", "parent")
    return fact.join(parents, "tid").join(fact.select(*KEYS, F.col("tid").alias("parent"), F.col("acc").alias("whole")), [*KEYS, "parent"]).filter("acc = whole").select(*KEYS, "parent", "tid")


def leaves(fact: DataFrame, ontology: Ontology) -> DataFrame:
    """(sample, tid, acc) of nodes with reads none of whose children have any."""
    inner = fact.filter("acc > 0").join(ontology.nodes.filter(F.col("tid") != ontology.root).select("tid", "parent"), "tid").select(*KEYS, F.col("parent").alias("tid")).distinct()
    return fact.filter("acc > 0").join(inner, [*KEYS, "tid"], "left_anti").select(*KEYS, "tid", "acc")


def members(fact: DataFrame, ontology: Ontology, tid: str) -> DataFrame:
    """The rows of a node and all below it."""
    return fact.join(ontology.closure().filter(F.col("anc") == tid).select("tid"), "tid", "left_semi")
