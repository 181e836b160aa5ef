"""Text files that are compressed whatever their names say: told by their first two bytes, and streamed.

Spark picks a codec by a file's extension. Files without one are looked at by tasks, which read two bytes of each; compressed ones are
then streamed by one task a file (a gzip file cannot be split), the others stay with Spark's own reader.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .classified import listed_files

#: Fixed value: the first two bytes of a gzip file.
MAGIC = b"\x1f\x8b"
CHUNK = 1 << 20


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.separator, self.only_look = json.loads(options["paths"]), options["separator"].encode(), options["look"] == "true"

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs  # by the tasks alone

        system, path = fs.FileSystem.from_uri(partition.path)
        if self.only_look:
            with system.open_input_stream(path) as stream:
                found = stream.read(2) == MAGIC
            yield _batch(partition.path, int(found), [""])
            return
        with system.open_input_stream(path) as stream:
            first, rest = 0, b""
            plain = gzip.GzipFile(fileobj=stream)
            while chunk := plain.read(CHUNK):
                *lines, rest = (rest + chunk).split(self.separator)
                yield _batch(partition.path, first, self._texts(lines))
                first += len(lines)
            if rest:
                yield _batch(partition.path, first, self._texts([rest]))

    def _texts(self, lines: list[bytes]) -> list[str]:
        if self.separator == b"\n":
            lines = [x.removesuffix(b"\r") for x in lines]
        return [x.decode("utf-8", "replace") for x in lines]


def _batch(path: str, first: int, values: list[str]) -> pa.RecordBatch:
    columns = [pa.array([path] * len(values), pa.string()), pa.array(range(first, first + len(values)), pa.int64()), pa.array(values, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["file", "line", "value"])


class SniffedLines(DataSource):
    """Lines of gzip files: option `paths` is a JSON array, `separator` parts lines; with `look` there is one row a file, whose line tells whether it is one."""

    @classmethod
    def name(cls) -> str:
        return "sniffed_lines"

    def schema(self) -> str:
        return "file string, line long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _read(spark: SparkSession, paths: list[str], separator: str, look: bool) -> DataFrame:
    spark.dataSource.register(SniffedLines)
    return spark.read.format("sniffed_lines").options(paths=json.dumps(paths), separator=separator, look=str(look).lower()).load()


def sniffed(spark: SparkSession, paths: str | list[str]) -> tuple[list[str], list[str]]:
    """(files for Spark's own reader, gzip files that it would not know) of files and folders."""
    files = [x for p in ([paths] if isinstance(paths, str) else paths) for x in listed_files(spark, p) or [p]]
    unknown = [x for x in files if not x.endswith((".gz", ".bz2"))]
    hidden = {r.file for r in _read(spark, unknown, "\n", True).filter("line = 1").collect()} if unknown else set()  # a row a file
    return [x for x in files if x not in hidden], sorted(hidden)


def gzip_lines(spark: SparkSession, files: list[str], separator: str = "\n") -> DataFrame:
    """(file, line, value) of gzip files, each streamed by one task."""
    return _read(spark, files, separator, False)
