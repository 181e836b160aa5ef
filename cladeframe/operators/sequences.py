"""Sequence utilities: selection of reads, length classes, header expansion, splits, mock reads, rates of recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import share

#: Fixed value: an accession at the head of one of several joined titles.
HEADER = r">[A-Za-z0-9_.]+ "
HISTOGRAM_BINS = 100
#: Ranges of record numbers, at most, whose counts or lengths are summed one after another.
RANGES = 1 << 14


def extracted(reads: DataFrame, ids: DataFrame, minscore: float | None = None, unclassified: bool = False) -> DataFrame:
    """Reads whose node is one of `ids`, or those that are unclassified; with scores below `minscore` dropped."""
    found = reads.filter("unclassified") if unclassified else reads.filter("not unclassified").join(ids.select("tid").distinct(), "tid", "left_semi")
    return found.filter(F.col("score") >= minscore) if minscore is not None and not unclassified else found


def record_id(column: Column, paired: bool = True) -> Column:
    """A record's id: the first word of its title, with the mate's number after a slash cut off if `paired`."""
    word = F.regexp_extract(column, r"^\s*(\S*)", 1)
    return F.regexp_replace(word, r"/[^/]*$", "") if paired else word


def matched_records(records: DataFrame, reads: DataFrame, limit: int | None = None, maxreads: int | None = None, paired: bool = True) -> DataFrame:
    """Records (record, title, ...) of the reads (read_id), each read once, in file order.

    `maxreads` is how many records are looked at and `limit` how many are taken. No task orders all records: those before the
    limit are told by running counts of ranges of record numbers.
    """
    seen = records.filter(F.col("record") < maxreads) if maxreads is not None else records
    wanted = reads.select(record_id(F.col("read_id"), paired).alias("id")).distinct()
    hits = seen.withColumn("id", record_id(F.col("title"), paired)).join(wanted, "id", "left_semi")
    first = hits.groupBy("id").agg(F.min("record").alias("record"))
    found = hits.join(first, ["id", "record"], "left_semi")
    if limit is not None:
        found = first_rows(found, limit, "record")
    return found.drop("id")


def extraction_name(path: str, include: list[str] = [], exclude: list[str] = [], unclassified: bool = False, compress: bool = False, mark: str = "rxtr") -> str:
    """A name for what is extracted from a file: its own, a mark, the sorted ids that were chosen, its extension."""
    folder, _, name = path.rpartition("/")
    stem, dot, kind = name.removesuffix(".gz").rpartition(".")
    if not dot:
        stem, kind = kind, ""
    chosen = ["unclass"] if unclassified else [x for word, ids in (("incl", include), ("excl", exclude)) if ids for x in (word, *sorted(ids))]
    return "/".join(x for x in (folder, "_".join([stem, mark, *chosen])) if x) + dot + kind + (".gz" if compress else "")


def accession_records(records: DataFrame, accessions: DataFrame, ids: DataFrame, maxreads: int | None = None) -> DataFrame:
    """FASTA records whose id is an accession (accession, tid) of one of `ids`; of the first `maxreads` records, if that is given."""
    records = records.filter(F.col("record") < maxreads) if maxreads else records
    wanted = accessions.join(ids.select("tid").distinct(), "tid", "left_semi").select(F.col("accession").alias("id")).distinct()
    return records.withColumn("id", record_id(F.col("title"), paired=False)).join(wanted, "id", "left_semi").drop("id")


def length_class(length: Column, least: int | None, most: int | None) -> Column:
    """short, long or pass; a limit that is None bars nothing."""
    found = F.lit("pass")
    if most is not None:
        found = F.when(length > most, "long").otherwise(found)
    return F.when(length < least, "short").otherwise(found) if least is not None else found


def headers(title: Column, expand: bool = True) -> Column:
    """The titles joined in one, as an array, each with its accession. A title that does not begin with one is kept whole."""
    parts = F.regexp_extract_all(title, F.lit(rf"(?s)({HEADER}(?:(?!{HEADER}).)*)"), F.lit(1))
    whole = F.array(title)
    starts = F.regexp_like(title, F.lit(rf"^{HEADER}"))
    return F.when(starts, parts if expand else whole).otherwise(whole)


def length_filtered(records: DataFrame, least: int | None, most: int | None, expand: bool = False) -> DataFrame:
    """(title, seq, class) with a row a header: short, pass or long by the sequence's length. Titles carry their > here."""
    rows = records.select("seq", F.explode(headers(F.col("title"), expand)).alias("title"))
    return rows.select("title", "seq", length_class(F.length("seq"), least, most).alias("class"))


def length_stats(lengths: DataFrame) -> DataFrame:
    """(n, nt, length_min, length_mean, length_max) of `length`."""
    return lengths.agg(F.count("*").alias("n"), F.sum("length").alias("nt"), F.min("length").alias("length_min"), F.avg("length").alias("length_mean"), F.max("length").alias("length_max"))


def length_histogram(lengths: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, n) over bins of equal width on a logarithmic scale; the longest belongs to the last bin, empty bins are left out."""
    ends = lengths.filter("length > 0").agg(F.log10(F.min("length")).alias("lo"), F.log10(F.max("length")).alias("hi"))
    counted = lengths.filter("length > 0").groupBy("length").agg(F.count("*").alias("n"))
    step = (F.col("hi") - F.col("lo")) / bins
    place = F.when(step > 0, F.floor((F.log10("length") - F.col("lo")) / step)).otherwise(0)
    # ends is one row.
    return counted.join(F.broadcast(ends)).select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("n"))


def _ranged(rows: DataFrame, order: str, weight: Column) -> DataFrame:
    """rows with `inner`, the running sum of weight before each row in its range of `order`, `before`, that of all ranges before, and `whole`.

    At most RANGES ranges of equal width span what `order` has, however sparse it is; their sums are all that is ordered as a whole.
    """
    ends = rows.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    width = 1 if ends.low is None else max(1, (ends.high - ends.low + RANGES) // RANGES)
    placed = rows.withColumn("bucket", F.floor((F.col(order) - F.lit(ends.low or 0)) / width)).withColumn("weight", weight)
    sums = placed.groupBy("bucket").agg(F.sum("weight").alias("sum"))
    before = sums.select("bucket", (F.sum("sum").over(Window.orderBy("bucket")) - F.col("sum")).alias("before"), F.sum("sum").over(Window.partitionBy()).alias("whole"))
    inner = F.sum("weight").over(Window.partitionBy("bucket").orderBy(order)) - F.col("weight")
    return placed.join(before, "bucket").withColumn("inner", inner)


def first_rows(rows: DataFrame, limit: int, order: str) -> DataFrame:
    """The first `limit` rows by `order`, a whole number that is different in each."""
    found = _ranged(rows, order, F.lit(1)).filter(F.col("before") + F.col("inner") < limit)
    return found.drop("bucket", "weight", "before", "whole", "inner")


def match_rate(matched: DataFrame, records: DataFrame) -> DataFrame:
    """(matched, scanned, rate): how many of the records were taken, of how many that were looked at; NaN if there were none."""
    n = matched.agg(F.count("*").alias("matched"))
    return n.join(F.broadcast(records.agg(F.count("*").alias("scanned")))).withColumn("rate", share(F.col("matched"), F.col("scanned")))  # one row each


def range_split(records: DataFrame, files: int, order: str = "record") -> DataFrame:
    """records with `file`: runs in order, each of about an equal share of all characters of `seq`."""
    placed = _ranged(records, order, F.length("seq").cast("long"))
    part = (F.col("before") + F.col("inner")) * files
    found = placed.withColumn("file", F.least(F.lit(files - 1), F.floor(part / F.greatest(F.col("whole"), F.lit(1)))).cast("int"))
    return found.drop("bucket", "weight", "before", "whole", "inner")


def greedy_split(records: DataFrame, files: int, order: str = "record") -> DataFrame:
    """(order, file) by the greedy rule: each record in order to the file with the fewest characters, of equals the last.

    The rule is sequential by nature: each choice needs all choices before it. Only record numbers and lengths go through
    the one task, not sequences; range_split() balances without that.
    """
    def split(frames):
        import heapq

        import pandas as pd

        heap = [(0, -k) for k in range(files)]
        heapq.heapify(heap)
        for frame in frames:
            out = []
            for n in frame["length"]:
                size, k = heap[0]
                heapq.heapreplace(heap, (size + int(n), k))
                out.append(-k)
            yield pd.DataFrame({order: frame[order], "file": out})

    light = records.select(F.col(order).cast("long").alias(order), F.length("seq").alias("length"))
    return light.repartition(1).sortWithinPartitions(order).mapInPandas(split, f"{order} long, file int")


def first_per_key(rows: DataFrame, key: str, order: list[str], wanted: DataFrame | int) -> DataFrame:
    """The first rows of each key in order: so many of each, or (key, n) as `wanted` says."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    if isinstance(wanted, int):
        return rows.withColumn("place", place).filter(F.col("place") <= wanted)
    least = wanted.select(F.col(key), F.col("n").alias("wanted_n"))
    return rows.join(least, key).withColumn("place", place).filter("place <= wanted_n").drop("wanted_n")


def _draw(seed: int, *keys: str) -> Column:
    """A number from 0 to under 1 that depends on the keys alone, not on how rows are dealt."""
    text = F.concat_ws(":", *(F.col(k).cast("string") for k in keys), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mock_reads(layout: DataFrame, least: int = 16, most: int = 150, length: int = 200, seed: int = 18490, keys: list[str] = []) -> DataFrame:
    """Reads made up by layout (keys, tid, n): keys, read_id, tid, score, length, with hit lengths between `least` and a maximum of each tid.

    A hit of h characters has the score (h - 15) squared, from which readers get h back. `keys`, such as a sample, have draws of their own.
    """
    top = F.lit(least) + F.floor(_draw(seed, *keys, "tid") * (most - least + 1))
    rows = layout.filter("n > 0").withColumn("top", top).select(*keys, "tid", "top", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("k"))
    hit = (F.lit(least) + F.floor(_draw(seed + 1, *keys, "tid", "k") * (F.col("top") - least + 1))).cast("long")
    name = F.concat_ws("_", F.lit("test"), "tid", F.col("k").cast("string")).alias("read_id")
    return rows.select(*keys, name, "tid", ((hit - 15) * (hit - 15)).cast("double").alias("score"), F.lit(length).cast("long").alias("length"))


def recovery(truth: DataFrame, counts: DataFrame) -> DataFrame:
    """(sample, tpr, fpr) of counts (sample, tid, count) against truth (sample, tid, count, native).

    Reads of native nodes beyond the true ones count as false.
    """
    both = truth.withColumnRenamed("count", "made").join(counts.withColumnRenamed("count", "found"), ["sample", "tid"], "left").fillna(0, ["found"])
    native = F.col("native")
    sums = both.groupBy("sample").agg(*(F.sum(F.when(which, F.col(c)).otherwise(0)).alias(n) for n, which, c in (("positives", native, "made"), ("negatives", ~native, "made"), ("true_found", native, "found"), ("false_found", ~native, "found"))))
    right = F.least("true_found", "positives")
    return sums.select("sample", F.try_divide(right, F.col("positives")).alias("tpr"), F.try_divide(F.col("false_found") + F.col("true_found") - right, F.col("negatives")).alias("fpr"))
