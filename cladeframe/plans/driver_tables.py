"""The order tables as an ontology with samples: root, regions, nations, customers; a read is an order, a sample its priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import RANK_VALUES, rank_value
from ..ontology import ROOT, Ontology

DEPTH = 3
CONTROLS = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def level(name: str, mark: str, key: str, parent, rank: str, label: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("tid"), parent.alias("parent"), F.lit(rank).alias("rank"), F.lit(RANK_VALUES[rank]).alias("rank_value"), F.col(label).alias("name"))

    root = spark.range(1).select(F.lit(ROOT).alias("tid"), F.lit(ROOT).alias("parent"), F.lit("ROOT").alias("rank"), F.lit(RANK_VALUES["ROOT"]).alias("rank_value"), F.lit("root").alias("name"))
    regions = level("region", "R", "r_regionkey", F.lit(ROOT), "FAMILY", "r_name")
    nations = level("nation", "N", "n_nationkey", F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), "GENUS", "n_name")
    customers = level("customer", "C", "c_custkey", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), "SPECIES", "c_name")
    return root.union(regions).union(nations).union(customers)


def ontology(spark: SparkSession, sf_dir: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Ontology:
    return Ontology(nodes(spark, sf_dir), ROOT, include, exclude, DEPTH)


def reads(spark: SparkSession, sf_dir: str, lengths: bool = False) -> DataFrame:
    """sample, read_id, tid, score (hundredths, whole), unclassified, bad; with `lengths` the ordered quantity as length.

    Orders under a hundred are bad lines, and orders that are still open (status P) have no class.
    """
    orders = table(spark, sf_dir, "orders")
    found = orders.select(
        F.col("o_orderpriority").alias("sample"), F.col("o_orderkey").alias("read_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("tid"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("score"), (F.col("o_orderstatus") == "P").alias("unclassified"), (F.col("o_orderkey") % 100 == 0).alias("bad"),
    )
    if lengths:
        sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("read_id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("length"))
        found = found.join(sizes, "read_id", "left").withColumn("length", F.coalesce("length", F.lit(1)))
    return found


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads by sample and node."""
    return reads(spark, sf_dir).groupBy("sample", "tid").agg(F.count("*").alias("count"), F.count("score").alias("scored"), F.sum("score").alias("total"))


def samples(spark: SparkSession, sf_dir: str, mintaxa: int) -> DataFrame:
    """The samples in order of name, the first CONTROLS of which are controls."""
    names = [x.sample for x in table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("sample")).distinct().orderBy("sample").collect()]  # the few samples of a study
    return spark.createDataFrame([(s, k, k < CONTROLS, mintaxa) for k, s in enumerate(names)], "sample string, ord int, is_ctrl boolean, mintaxa int")


def inverted_ontology(spark: SparkSession, sf_dir: str) -> Ontology:
    """The same tree with ranks that do not fall along its paths, and nations without a rank."""
    key = F.substring("tid", 2, 20).cast("long")
    rank = (
        F.when(F.col("tid").startswith("R"), F.when(key % 2 == 0, "FAMILY").otherwise("GENUS"))
        .when(F.col("tid").startswith("N"), F.when(key % 3 == 0, "SPECIES").when(key % 3 == 1, "GENUS").otherwise("NO_RANK"))
        .when(F.col("tid").startswith("C"), F.when(key % 4 == 0, "GENUS").when(key % 4 == 3, "STRAIN").otherwise("SPECIES")).otherwise("ROOT")
    )
    found = nodes(spark, sf_dir).withColumn("rank", rank)
    return Ontology(found.withColumn("rank_value", rank_value(F.col("rank"))), ROOT, depth=DEPTH)


def scattered_counts(spark: SparkSession, sf_dir: str, log: bool = False) -> DataFrame:
    """Reads that stand at customers, nations and regions; with `log`, their scores are logarithms from 0 to 308."""
    orders = table(spark, sf_dir, "orders")
    tid = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN concat('N', o_custkey % 25) WHEN o_orderkey % 31 = 0 THEN concat('R', o_custkey % 5) ELSE concat('C', o_custkey) END")
    score = F.col("o_orderkey") % 309 if log else F.round(F.col("o_totalprice") * 100).cast("long")
    rows = orders.select(F.col("o_orderpriority").alias("sample"), tid.alias("tid"), score.alias("score"))
    return rows.groupBy("sample", "tid").agg(F.count("*").alias("count"), F.count("score").alias("scored"), F.sum("score").alias("total"))
