"""Token counts through a digest cache.

A text is known by the SHA-256 of its normalised content, a tokenizer by the SHA-256 of its file and of how it is
called. Counts already stored under both digests are joined; of the others each distinct text is encoded once,
wherever it occurs first, and appended to the cache. Counting again, with more documents or after a lost run,
encodes only what is new.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import plain_text, slices, table, tokenizer_file, work_folder, written

CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"
TOKEN_LIMIT = 4096
#: Part of the tokenizer's digest: a change in how the library is called makes old counts void.
CALL = "plain-1"


@lru_cache(maxsize=2)
def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + CALL.encode()).hexdigest()


def stored(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; none if nothing was written yet. A count stored twice counts once."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE_SCHEMA)
    return found


def _encode(tokenizer: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer)
        for batch in batches:
            found = [n for run in slices(batch.column("text").to_pylist(), 1 << 20) for n in count(run)]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(found, pa.int64())], names=["content", "n_tokens"])

    return task


def count_tokens(docs: DataFrame, cache: str, tokenizer: str = tokenizer_file("piece_bpe_32k.model"), normal=plain_text) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row of docs; the cache folder gains what it lacked.

    `normal` gives the content that is counted and digested, by default the text, with null as the empty text. Rows
    with equal or null doc_id each get a row. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal().alias("text"))
    digested = rows.withColumn("content", F.unhex(F.sha2(F.col("text"), 256)))
    known = stored(spark, cache).filter(F.col("tokenizer") == version).select("content")
    # Digests alone tell what is missing; where nothing is, no text is read again or shuffled.
    new = written(digested.select("content").distinct().join(known, "content", "left_anti"), "token-misses")
    if not new.isEmpty():
        # One text of each digest leaves the map side, so a group of copies is as light as a single text.
        misses = digested.groupBy("content").agg(F.first("text").alias("text")).join(new, "content", "left_semi")
        counted = misses.mapInArrow(_encode(tokenizer), "content binary, n_tokens long")
        counted.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    # Written, so that the join reads both sides as they are and Spark can split a digest that very many rows share.
    counts = written(stored(spark, cache).filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    light = digested.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    return light.join(counts, "content").select("doc_id", "n_bytes", "n_tokens")


def op5_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts twice: what the first pass encodes and stores, the second takes from the cache."""
    docs, cache = table(spark, sf_dir, "documents"), work_folder(spark, "token-cache")
    count_tokens(docs, cache)
    found = count_tokens(docs, cache)
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


QUERIES = {"op5_digest_cache": op5_digest_cache}
SQL: dict[str, str] = {}
