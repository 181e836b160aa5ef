"""Harmonic packing of documents into training sequences.

Piece lengths belong to reciprocal-capacity classes: class k holds lengths up to capacity // k, and every bin of
class k takes exactly k pieces. A document is cut so that its pieces fill their class: the largest capacity // k
that fits is cut off until fewer than `least` ids are left, which go as one piece to the class of their length.
Each task packs its own rows, with at most one open bin a class, so no task waits for another and nothing is
shuffled. The pieces of a task's open bins are at the end laid end to end into whole sequences, and what is left
into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import plain_text, release_memory, table, tokenizer_file
from .word_ids import word_ids

CAPACITY = 2048
LEAST = 64
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY, least: int = LEAST) -> list[tuple[int, int]]:
    """(class, length) of the pieces of n ids, in order."""
    found = []
    while n:
        if n >= capacity:
            k, size = 1, capacity
        elif n < least:
            k, size = capacity // n, n
        else:
            k = -(-capacity // n)
            size = capacity // k
        found.append((k, size))
        n -= size
    return found


def binary_lengths(n: int, capacity: int) -> list[int]:
    """Sequence lengths for n ids: whole ones, then the powers of two that make up the rest."""
    return [capacity] * (n // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if (n % capacity) >> b & 1]


class Packer:
    """The open bins of one task. A piece is [doc_id, start, ids, doc_tokens]."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, least: int = LEAST) -> None:
        self.next, self.capacity, self.least = first_id, capacity, least
        self.open: dict[tuple[int, int], list] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, ids, total, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        for k, size in cuts(total, self.capacity, self.least):
            piece = [doc, start, ids[4 * start : 4 * (start + size)], total]
            pieces = self.open.setdefault((k, 0), [])
            pieces.append(piece)
            if len(pieces) == k:
                self._close(self.open.pop((k, 0)))
            start += size

    def finish(self) -> None:
        rest = [piece for key in sorted(self.open) for piece in self.open[key]]
        self.open.clear()
        lengths = binary_lengths(sum(len(p[2]) // 4 for p in rest), self.capacity)
        at = 0
        for room in lengths:
            pieces = []
            while room:
                doc, start, ids, total = rest[at]
                take = min(room, len(ids) // 4)
                pieces.append([doc, start, ids[: 4 * take], total])
                room -= take
                if 4 * take == len(ids):
                    at += 1
                else:
                    rest[at] = [doc, start + take, ids[4 * take :], total]
            self._close(pieces)

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer: str = tokenizer_file("word_bpe_49k.json"), end_id: int = END_ID, capacity: int = CAPACITY, least: int = LEAST) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Documents with equal or null ids are packed as rows of their own.
    Other columns are not read; an empty table gives no rows. `end_id` None appends nothing, and an empty text
    then has no piece.
    """
    end = b"" if end_id is None else end_id.to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        encoder = word_ids(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, least)
        for got in batches:
            ids, texts = got.column("doc_id").to_pylist(), got.column("text")
            for at in range(0, len(ids), 512):
                for doc, x in zip(ids[at : at + 512], encoder.encode(texts.slice(at, 512).to_pylist())):
                    packer.add(doc, x + end)
                if rows := packer.taken():
                    yield batch(rows)
        packer.finish()
        if rows := packer.taken():
            yield batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text")).mapInArrow(task, SCHEMA)


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op6_harmonic_packing": op6_harmonic_packing}
SQL: dict[str, str] = {}
