"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

A record is: payload length (unsigned 64-bit), masked checksum of those 8 bytes (unsigned 32-bit), payload, masked
checksum of the payload. Checksums are CRC-32C, masked by rotation and addition as is usual for such frames. The
payload is the document id (signed 64-bit) and its token ids, unsigned and 16 or 32 bits wide by the vocabulary.
Everything is little-endian. Beside each .rec file, an .idx file holds one INDEX entry a record, so that any record
can be read alone.

Documents are range-partitioned by id and each task writes one pair of files under a name of its own attempt. Only
files named in the manifest, a small table with one row a file that is written last, belong to the data set: what
a lost executor or a repeated attempt leaves behind is never read.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import partitions, plain_text, table, tokenizer_file, work_folder
from .word_ids import word_ids

END_ID = 2
#: Documents that one read task takes at most.
READ_RECORDS = 20_000
INDEX = np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("first", "<u8"), ("ids", "<u4"), ("null_id", "<u4")])
MANIFEST = "part long, path string, records long, ids long, bytes long, width long"

#: The reflected CRC-32C polynomial and the constant that masks a checksum.
CRC32C_POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

_BLOCK = 64


@lru_cache(maxsize=1)
def _block_tables() -> np.ndarray:
    """[j, v]: what byte value v at place j of a block adds to the remainder at the block's end."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(CRC32C_POLYNOMIAL), one >> 1).astype(np.uint32)
    found = np.empty((_BLOCK, 256), np.uint32)
    found[-1] = one
    for j in range(_BLOCK - 2, -1, -1):
        found[j] = one[found[j + 1] & 0xFF] ^ (found[j + 1] >> 8)
    return found


@lru_cache(maxsize=64)
def _advance(level: int) -> np.ndarray:
    """[k, v]: the remainder that has value v in its byte k, moved on by 2**level blocks of zeros."""
    if level == 0:
        step = _block_tables()[-1]
        found = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        for _ in range(_BLOCK):
            found = step[found & 0xFF] ^ (found >> 8)
        return found
    return _moved(_advance(level - 1), level - 1)


def _moved(remainders: np.ndarray, level: int) -> np.ndarray:
    by = _advance(level)
    return by[0][remainders & 0xFF] ^ by[1][remainders >> 8 & 0xFF] ^ by[2][remainders >> 16 & 0xFF] ^ by[3][remainders >> 24]


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of each of many byte strings, all at once. An empty one has 0; one below 4 bytes is done singly."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    found = np.zeros(len(payloads), np.uint32)
    for i in np.flatnonzero((sizes > 0) & (sizes < 4)):
        r, step = np.uint32(0xFFFFFFFF), _block_tables()[-1]
        for b in payloads[i]:
            r = step[(r ^ b) & 0xFF] ^ (r >> np.uint32(8))
        found[i] = ~r
    long = np.flatnonzero(sizes >= 4)
    if not len(long):
        return found
    blocks = -(-sizes[long] // _BLOCK)
    ends = np.cumsum(blocks)
    data = bytearray(int(ends[-1]) * _BLOCK)
    # Zeros before a string leave a zero remainder as it is, so strings end at block ends; the usual starting
    # remainder of ones is the same as inverting the first four bytes.
    for i, end in zip(long, ends * _BLOCK):
        data[end - sizes[i] : end] = payloads[i]
    data = np.frombuffer(data, np.uint8)
    heads = (ends * _BLOCK - sizes[long])[:, None] + np.arange(4)
    data[heads] ^= 0xFF
    rows, tables = data.reshape(-1, _BLOCK), _block_tables()
    parts = np.zeros(len(rows), np.uint32)
    for j in range(_BLOCK):
        parts ^= tables[j][rows[:, j]]
    levels = np.ceil(np.log2(blocks)).astype(np.int64)
    for level in np.unique(levels):
        own, width = np.flatnonzero(levels == level), 1 << int(level)
        at = ends[own][:, None] - width + np.arange(width)
        lacks = np.arange(width) < width - blocks[own][:, None]
        grid = np.where(lacks, np.uint32(0), parts[np.where(lacks, 0, at)])
        for k in range(int(level)):
            grid = _moved(grid[:, 0::2], k) ^ grid[:, 1::2]
        found[long[own]] = ~grid[:, 0]
    return found


def masked(checksums: np.ndarray) -> np.ndarray:
    return ((checksums >> 15) | (checksums << 17)) + np.uint32(MASK_DELTA)


def _masked_crcs(payloads: list[bytes]) -> np.ndarray:
    return masked(crc32c(payloads)).astype("<u4")


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    head_crcs, crcs = _masked_crcs(heads).tolist(), _masked_crcs(payloads).tolist()
    return [h + a.to_bytes(4, "little") + p + b.to_bytes(4, "little") for h, a, p, b in zip(heads, head_crcs, payloads, crcs)]


def unframed(data: bytes, starts: list[int]) -> list[bytes]:
    """The payloads of the records that begin at these places; an error if a length or checksum is wrong."""
    heads = [data[s : s + 8] for s in starts]
    payloads = [data[s + 12 : s + 12 + int.from_bytes(h, "little")] for s, h in zip(starts, heads)]
    told = [(data[s + 8 : s + 12], data[s + 12 + len(p) : s + 16 + len(p)]) for s, p in zip(starts, payloads)]
    for mine, place in ((heads, 0), (payloads, 1)):
        if _masked_crcs(mine).tobytes() != b"".join(t[place] for t in told):
            raise ValueError("a record's checksum does not match its bytes")
    return payloads


@dataclass(frozen=True)
class RecordSet:
    """A written data set: its folder, and the manifest that names its files in order."""

    spark: SparkSession
    folder: str

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")

    def read(self) -> DataFrame:
        """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit), by chunks of whole records."""
        found, before, chunks = sorted(self.manifest().collect()), 0, []  # one row a file
        for x in found:
            for at in range(0, x.records, READ_RECORDS):
                chunks.append((x.path, at, min(READ_RECORDS, x.records - at), before, x.width))
            before += x.ids
        schema = "path string, at long, records long, before long, width long"
        jobs = self.spark.createDataFrame(chunks, schema).repartition(max(1, min(len(chunks), partitions(self.spark))), "path", "at")
        return jobs.mapInArrow(_read_chunks(self.folder), "doc_id long, start long, ids binary")

    def read_at(self, places: DataFrame) -> DataFrame:
        """A shuffled read: the records at (part, record) of `places`, each found through the offset index.

        Rows of `places` that name no record give no row; repeated rows give repeated records.
        """
        files = self.manifest().select(F.col("part").alias("file_part"), "path", "records", "width")
        jobs = places.join(files, places["part"] == F.col("file_part")).filter("record >= 0 and record < records").select("part", "record", "path", "width")
        return jobs.mapInArrow(_read_single(self.folder), "part long, record long, doc_id long, ids binary")


def _ids32(payload: bytes, width: int) -> bytes:
    return np.frombuffer(payload, f"<u{width}", offset=8).astype("<u4").tobytes()


def _read_chunks(folder: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for job in (row for batch in batches for row in batch.to_pylist()):
            store, base = _opened(folder)
            with store.open_input_file(posixpath.join(base, job["path"] + ".idx")) as file:
                index = np.frombuffer(file.read_at(job["records"] * INDEX.itemsize, job["at"] * INDEX.itemsize), INDEX)
            with store.open_input_file(posixpath.join(base, job["path"] + ".rec")) as file:
                for k in range(0, len(index), 1000):
                    part = index[k : k + 1000]
                    first, last = int(part["offset"][0]), int(part["offset"][-1]) + 24 + job["width"] * int(part["ids"][-1])
                    payloads = unframed(file.read_at(last - first, first), (part["offset"].astype(np.int64) - first).tolist())
                    docs = [None if null else int.from_bytes(p[:8], "little", signed=True) for p, null in zip(payloads, part["null_id"].tolist())]
                    ids = [_ids32(p, job["width"]) for p in payloads]
                    starts = part["first"].astype(np.int64) + job["before"]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    return task


def _read_single(folder: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(folder)
        for batch in batches:
            rows = []
            for job in batch.to_pylist():
                with store.open_input_file(posixpath.join(base, job["path"] + ".idx")) as file:
                    entry = np.frombuffer(file.read_at(INDEX.itemsize, job["record"] * INDEX.itemsize), INDEX)[0]
                with store.open_input_file(posixpath.join(base, job["path"] + ".rec")) as file:
                    payload = unframed(file.read_at(24 + job["width"] * int(entry["ids"]), int(entry["offset"])), [0])[0]
                rows.append((job["part"], job["record"], None if entry["null_id"] else int(entry["doc_id"]), _ids32(payload, job["width"])))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "record", "doc_id", "ids"])

    return task


def write(docs: DataFrame, folder: str, tokenizer: str = tokenizer_file("word_bpe_49k.json"), end_id: int | None = END_ID, files: int | None = None) -> RecordSet:
    """Write each document's ids and then `end_id` in ascending doc_id order below `folder`, a path that all executors share.

    A null text is an empty one. Null ids come first and equal ids are ordered by text; each row has its own record.
    Other columns are not read. An empty table gives a manifest without rows.
    """
    spark = docs.sparkSession
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        width = 2 if max(encoder.size - 1, end_id or 0) < 1 << 16 else 4
        part, name = TaskContext.get().partitionId(), ""
        records = total = place = 0
        out = index = None
        for got in batches:
            ids, texts = got.column("doc_id").to_pylist(), got.column("text")
            for at in range(0, len(ids), 512):
                if not out:
                    name = f"part-{part:06d}-{uuid.uuid4().hex}"
                    store, base = _opened(folder)
                    store.create_dir(base, recursive=True)
                    out, index = (store.open_output_stream(posixpath.join(base, name + x)) for x in (".rec", ".idx"))
                own = ids[at : at + 512]
                encoded = [np.frombuffer(x + end, "<u4") for x in encoder.encode(texts.slice(at, 512).to_pylist())]
                framed = frames([(doc or 0).to_bytes(8, "little", signed=True) + x.astype(f"<u{width}").tobytes() for doc, x in zip(own, encoded)])
                entries = np.zeros(len(own), INDEX)
                counts, sizes = np.array([len(x) for x in encoded], np.int64), np.array([len(x) for x in framed], np.int64)
                entries["doc_id"], entries["null_id"], entries["ids"] = [doc or 0 for doc in own], [doc is None for doc in own], counts
                entries["first"], entries["offset"] = total + np.cumsum(counts) - counts, place + np.cumsum(sizes) - sizes
                out.write(b"".join(framed))
                index.write(entries.tobytes())
                records, total, place = records + len(own), total + int(counts.sum()), place + int(sizes.sum())
        if out:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": name, "records": records, "ids": total, "bytes": place, "width": width}], schema=pa.schema([("part", pa.int64()), ("path", pa.string()), *((c, pa.int64()) for c in ("records", "ids", "bytes", "width"))]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    ordered = rows.repartitionByRange(files or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(task, MANIFEST).write.parquet(f"{folder}/manifest")
    return RecordSet(spark, folder)


def op2_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = write(table(spark, sf_dir, "documents"), work_folder(spark, "records")).read()
    return found.select("doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op2_binary_records": op2_binary_records}
SQL: dict[str, str] = {}
