"""Sequence files and layouts: FASTQ, FASTA, accession maps, mock layouts."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import numbered
from .sniffed import gzip_lines, sniffed


def _lines(spark: SparkSession, paths: str | list[str], sniff: bool, separator: str | None = None) -> DataFrame:
    """(file, line, value); with `sniff` also of gzip files whose names do not say so."""
    if not sniff:
        return numbered(spark, paths, separator)
    plain, hidden = sniffed(spark, paths)
    if not hidden:
        return numbered(spark, plain, separator)
    found = gzip_lines(spark, hidden, separator or "\n")
    return found.unionByName(numbered(spark, plain, separator)) if plain else found


def fastq(spark: SparkSession, paths: str | list[str], sniff: bool = False) -> DataFrame:
    """(file, record, title, seq, qual) of records of four lines; qualities are not decoded. A record cut short is left out."""
    rows = _lines(spark, paths, sniff).withColumn("record", F.floor(F.col("line") / 4))
    line = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    found = rows.groupBy("file", "record").agg(line(0).alias("title"), line(1).alias("seq"), line(3).alias("qual"))
    return found.filter("qual is not null").withColumn("title", F.regexp_replace("title", "^@", ""))


def fasta(spark: SparkSession, paths: str | list[str], sniff: bool = False) -> DataFrame:
    """(file, record, title, seq): records begin at a line's >; their lines are joined."""
    rows = _lines(spark, paths, sniff, "\n>")
    text = F.regexp_replace("value", "^>", "")
    parts = F.split(text, "\r?\n", 2)
    return rows.select("file", F.col("line").alias("record"), F.get(parts, 0).alias("title"), F.regexp_replace(F.coalesce(F.get(parts, 1), F.lit("")), r"\s", "").alias("seq")).filter("title != '' or seq != ''")


def mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of two mate files by their number."""
    return first.join(second.select("record", F.col("title").alias("mate_title"), F.col("seq").alias("mate_seq"), F.col("qual").alias("mate_qual")), "record")


def write_fastq(records: DataFrame, path: str, compression: str | None = None) -> None:
    lines = records.orderBy("record").select(F.concat_ws("\n", F.concat(F.lit("@"), "title"), "seq", F.lit("+"), "qual").alias("value"))
    lines.write.mode("overwrite").text(path, compression=compression)


def write_fasta(records: DataFrame, path: str, compression: str | None = None) -> None:
    lines = records.select(F.concat_ws("\n", F.concat(F.lit(">"), F.regexp_replace("title", "^>", "")), "seq").alias("value"))
    lines.write.mode("overwrite").text(path, compression=compression)


def accessions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(accession, tid) of lines of two words."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(paths).filter(F.trim("value") != "").select(F.get(parts, 0).alias("accession"), F.trim(F.get(parts, 1)).alias("tid")).filter("tid is not null")


def layout(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(tid, n) of a mock layout; lines from # on are comments."""
    parts = F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+")
    return spark.read.text(paths).select(F.get(parts, 0).alias("tid"), F.get(parts, 1).try_cast("long").alias("n")).filter("n is not null")


def mock_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(sample, tid, n) of a sheet as CSV: a column of names, one of ids, and one a sample, with a header; its last line, of sums, is left out."""
    lines = numbered(spark, path)
    header = lines.filter("line = 0").first()
    if header is None:
        return spark.createDataFrame([], "sample string, tid string, n long")
    names = next(csv.reader([header.value]))[2:]
    schema = ", ".join(f"c{k} string" for k in range(len(names) + 2))
    last = lines.filter(F.trim("value") != "").agg(F.max("line").alias("last"))
    rows = lines.filter("line > 0").join(F.broadcast(last), F.col("line") < F.col("last"), "left_semi").select(F.from_csv("value", schema).alias("x")).select("x.*")
    cells = F.array(*(F.struct(F.lit(name).alias("sample"), F.trim(f"c{k + 2}").try_cast("double").cast("long").alias("n")) for k, name in enumerate(names)))
    return rows.select(F.trim("c1").alias("tid"), F.explode(cells).alias("x")).select("x.sample", "tid", "x.n").filter("n > 0 and tid is not null")
