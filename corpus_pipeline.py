"""A corpus in five stages: each reads, as written Parquet, what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import language_id, near_texts, packing, spaced_seeds, toxicity
from cladeframe.llm._shared import plain_text, table, written

#: Least probability of the likeliest language.
LEAST_LANGUAGE_SCORE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the model knows; those without letters, or like none of the languages, go."""
    found = language_id.identify(docs.select(F.struct("*").alias("row"), "text"), language_id.train(docs))
    kept = (F.col("language.lang") != language_id.UNKNOWN) & (F.col("language.score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(kept).select("row.*")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough evidence of toxic passages."""
    found = toxicity.toxicity(docs.select(F.struct("*").alias("row"), "text"), toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.filter(F.col("toxicity") < toxicity.THRESHOLD).select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies, the document with the smallest id."""
    return near_texts.without_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item.

    A row goes by its own text: rows without doc_id, and rows that share one, stay if their texts are clean. Texts are told apart by a hash of 64 bits.
    """
    row = docs.select(F.struct("*").alias("row"), F.xxhash64(plain_text()).alias("copy"))
    leaks = spaced_seeds.overlaps(row.select(F.col("copy").alias("doc_id"), "row.text"), table(spark, sf_dir, "benchmark"))
    # A written table, so that Spark knows its size and broadcasts it only while it is small.
    leaking = written(leaks.select(F.col("doc_id").alias("copy")).distinct(), "leaking-texts")
    return row.join(leaking, "copy", "left_anti").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", known_language),
    ("toxicity", not_toxic),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]
#: The models' and the tokenizer's results can't be written in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
