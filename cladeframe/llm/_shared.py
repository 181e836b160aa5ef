"""Session helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is not set there must be no cluster, as workers would not see a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all workers share")
        root = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read from there: later reads depend on no executor, and what was shuffled for them goes at once."""
    path = work_folder(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of a query that is made and run when it ends; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tokenizer_file(name: str) -> str:
    """The path of a public tokenizer's vocabulary."""
    return str(public_tokenizers.path(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lets Spark pass rows to tasks by so many at a time, where the session has Spark's own number of 10,000: whole texts are held on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def release_encoders() -> None:
    """Gives back the encoders, with the words they remember, that an earlier stage left in this worker process."""
    module = sys.modules.get(f"{__package__}.word_ids")
    if module is None or not module.word_ids.cache_info().currsize:
        return
    module.word_ids.cache_clear()
    release_memory()


def release_memory() -> None:
    """Gives memory that earlier tasks of this worker process have freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class BitFilter:
    """Which hashes may be among some keys: a table of so many bits, whatever the number of keys; a full one lets all pass."""

    def __init__(self, bits: int, whole: np.ndarray) -> None:
        self.bits, self.whole = bits, whole

    @staticmethod
    def spots(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        spread = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift in (0, 16, 32):
            yield ((spread >> np.uint64(shift)) % np.uint64(bits)).astype(np.int64)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        known = np.ones(len(hashes), bool)
        for spots in self.spots(hashes, self.bits):
            known &= (self.whole[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8) & 1).astype(bool)
        return known

    @classmethod
    def of(cls, keys: DataFrame, bits: int) -> BitFilter:
        """The filter of a table with one column of longs; its bits are made by tasks and joined by words of 64."""

        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(bits >> 3, np.uint8)
            for batch in batches:
                for spots in cls.spots(batch.column(0).to_numpy(), bits):
                    np.bitwise_or.at(table, spots >> 3, (128 >> (spots & 7)).astype(np.uint8))
            whole = table.view(np.int64)
            place = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(whole[place])], names=["place", "bits"])

        pieces = keys.mapInArrow(marks, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
        whole = np.zeros(bits >> 6, np.int64)
        whole[pieces.column("place").to_numpy()] = pieces.column("bits").to_numpy()
        return cls(bits, whole.view(np.uint8))


def plain_text(column: str = "text"):
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def training_row(id_column: str = "doc_id"):
    """Whether a row may be learned from: the CRC-32 of its id as text is not 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4, F.lit(0)) != 2


def slices(texts: Iterable[str] | pa.Array, chars: int) -> Iterator[list[str]]:
    """Runs of texts of about so many characters in all; a longer text is a run of its own. Of an Arrow column, few texts are held at a time."""
    run, size = [], 0
    for text in _each(texts) if isinstance(texts, pa.Array) else texts:
        if run and size + len(text) > chars:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def _each(column: pa.Array, rows: int = 64) -> Iterator[str]:
    for at in range(0, len(column), rows):
        yield from (x or "" for x in column.slice(at, rows).to_pylist())
