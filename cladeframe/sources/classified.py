"""Reads from classifiers' text files: (sample, tid, length, score, conf, gamma, share, unclassified, bad).

`score` is the single hit equivalent length, or the format's own score; the other measures are null where the
format has none. A file is a sample, named by its path without folder and last extension. Lines that don't parse are
rows with `bad` true, so that they can be counted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import GO_LARGEST_SCORE, SHEL_OFFSET, centrifuge_shel
from .lines import numbered, until_bad

COLUMNS = ["sample", "tid", "length", "score", "conf", "gamma", "share", "unclassified", "bad"]
EXTENSIONS = {"centrifuge": (".out",), "clark": (".csv",), "kraken": (".krk", ".krk.gz", ".krk.bz2"), "go": (".out",), "generic": ("",)}
#: Names of match types that the LMAT format has, and their other spellings.
MATCHES = {"NOMATCH": "NOMATCH", "NoMatch": "NOMATCH", "NO": "NOMATCH", "MULTIMATCH": "MULTIMATCH", "MultiMatch": "MULTIMATCH", "MULTI": "MULTIMATCH", "DIRECTMATCH": "DIRECTMATCH", "DirectMatch": "DIRECTMATCH", "DIRECT": "DIRECTMATCH", "NODBHITS": "NODBHITS", "NoDbHits": "NODBHITS", "READTOOSHORT": "READTOOSHORT", "ReadTooShort": "READTOOSHORT", "LOWSCORE": "LOWSCORE", "LowScore": "LOWSCORE"}
#: Reads after which a generic file with more bad lines than good ones is an error.
GENERIC_TRIES = 100
#: Columns that a generic line has at least.
GENERIC_COLUMNS = 3


def _sample() -> Column:
    return F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"(\.[^.]*?)(\.gz|\.bz2)?$", "").alias("sample")


def _number(column: Column, kind: str = "double") -> Column:
    return F.trim(column).try_cast(kind)


def _rows(lines: DataFrame, unclassified: Column, needed: list[Column], **measures: Column) -> DataFrame:
    """Reads of lines: a line is bad if a needed value is null, or one of its measures and it is not unclassified."""
    bad = F.lit(False)
    for value in needed:
        bad = bad | value.isNull()
    unclassified = F.coalesce(unclassified, F.lit(False))
    kinds = {"tid": "string", "length": "long"}
    given = {name: (measures.get(name) if name in measures else F.lit(None)).cast(kinds.get(name, "double")) for name in ("tid", "length", "score", "conf", "gamma", "share")}
    bad = bad | (~unclassified & (given["tid"].isNull() | given["score"].isNull()))
    clean = [F.when(~bad & ((F.lit(name == "length")) | ~unclassified), value).alias(name) for name, value in given.items()]
    return lines.select(_sample(), *clean, (unclassified & ~bad).alias("unclassified"), bad.alias("bad"))


def centrifuge(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The first line of a file is its header; a line has seven fields at least; node 0 is unclassified."""
    part = F.split("value", "\t")
    tid, score, length = F.get(part, 2), _number(F.get(part, 3)), _number(F.get(part, 6), "long")
    return _rows(numbered(spark, paths).filter("line > 0"), tid == "0", [score, length], tid=tid, length=length, score=F.when(score >= 0, F.sqrt(score) + SHEL_OFFSET["centrifuge"]))


def centrifuge_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole records: file, line, read_id, sequence_id, tid, score, second_score (both as equivalent lengths), hit_length, query_length, matches.

    A record has eight fields; after title lines at its head, a file ends at its first line that has another number of them.
    """
    part = F.split("value", "\t")
    lines = numbered(spark, paths)
    begin = lines.filter(~F.col("value").contains("readID")).groupBy(F.col("file").alias("of")).agg(F.min("line").alias("begin"))
    rows = lines.join(begin, F.col("file") == F.col("of")).filter("line >= begin").drop("of", "begin")
    rows = until_bad(rows, F.size(part) != 8)
    shel = lambda k: centrifuge_shel(_number(F.get(part, k)))
    return rows.select(
        "file", "line", F.regexp_extract(F.get(part, 0), r"^\s*(\S*)", 1).alias("read_id"), F.get(part, 1).alias("sequence_id"), F.get(part, 2).alias("tid"), shel(3).alias("score"),
        shel(4).alias("second_score"), F.get(part, 5).alias("hit_length"), F.get(part, 6).alias("query_length"), _number(F.get(part, 7), "long").alias("matches"),
    )


def kraken(spark: SparkSession, paths: str | list[str], parity: bool = False) -> DataFrame:
    """Five fields; the node is a number or in a text as (taxid n); mates' lengths are added, their hits counted together.

    A read without any mapped part is bad. With `parity` the first line of a file is dropped as if it were a header.
    """
    lines = numbered(spark, paths)
    part = F.split("value", "\t")
    kind, raw = F.get(part, 0), F.get(part, 2)
    lengths = F.transform(F.split(F.get(part, 3), r"\|"), lambda x: F.trim(x).try_cast("long"))
    length = F.when(F.forall(lengths, lambda x: x.isNotNull()), F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x))
    tid = F.coalesce(_number(raw, "long").cast("string"), F.nullif(F.regexp_extract(raw, r"\(taxid (\d+)\)", 1), F.lit("")))
    pairs = F.transform(F.filter(F.split(F.trim(F.get(part, 4)), r"\s+"), lambda x: x != "|:|"), lambda x: F.struct(F.get(F.split(x, ":"), 0).alias("k"), F.get(F.split(x, ":"), 1).try_cast("long").alias("n")))
    total = lambda kept: F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    marked = lines.select("file", "line", kind.alias("kind"), length.alias("length"), tid.alias("node"), pairs.alias("pairs"))
    hits, whole = total(F.filter("pairs", lambda x: x["k"] == F.col("node"))), total(F.col("pairs"))
    marked = marked.select("file", "line", "kind", "length", "node", hits.alias("hits"), whole.alias("whole"))
    if parity:
        marked = marked.filter("line > 0")
    score = F.when(F.col("whole") > 0, F.col("hits") + SHEL_OFFSET["kraken"])
    return _rows(marked, F.col("kind") == "U", [F.col("kind"), F.col("length")], tid=F.col("node"), length=F.col("length"), score=score, share=F.try_divide(100.0 * F.col("hits"), F.col("whole")))


def clark(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Eight fields after a header; the second assignment counts where the first is NA, with the rest of the confidence."""
    part = F.split("value", ",")
    get = lambda k, kind="double": _number(F.get(part, k), kind)
    first, second, conf = F.get(part, 3), F.get(part, 5), get(7)
    only = first == "NA"
    return _rows(
        numbered(spark, paths).filter("line > 0"), only & (second == "NA"), [get(1, "long"), get(2), first, second],
        tid=F.when(only, second).otherwise(first), length=get(1, "long"), score=F.when(only, get(6)).otherwise(get(4)) + SHEL_OFFSET["clark"], conf=F.when(only, 1 - conf).otherwise(conf), gamma=get(2),
    )


def lmat(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Five fields; a file ends at its first line with another number of them. Only direct and multiple matches are classified.

    A sample has many files: a folder stands for all output files in it, and what is no file for those whose names begin so.
    """
    part = F.split("value", "\t")
    lines = until_bad(numbered(spark, lmat_files(spark, paths)), F.size(part) != 5)
    final = F.split(F.trim(F.get(part, 4)), r"\s+")
    names = F.create_map(*(F.lit(x) for pair in MATCHES.items() for x in pair))
    match = F.try_element_at(names, F.get(final, 2))
    classified = match.isin("DIRECTMATCH", "MULTIMATCH")
    return _rows(lines, ~classified, [match], tid=F.get(final, 0), length=F.length(F.get(part, 1)).cast("long"), score=F.get(final, 1).try_cast("double"))


def listed_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a folder and of those in it, or the file itself, by Spark's own listing; no content is read."""
    try:
        return sorted(r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect())
    except AnalysisException:  # nothing has this path
        return []


def lmat_files(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The files of LMAT samples given as folders, beginnings of names, or files; where none fits a path, the path itself."""
    out = []
    for path in [paths] if isinstance(paths, str) else paths:
        folder, _, start = path.rstrip("/").rpartition("/")
        inside = listed_files(spark, path)
        if inside and inside[0].rstrip("/").endswith("/" + start):
            out.append(path)
        elif inside:
            below = {x: x.rsplit(f"/{start}/", 1)[-1].split("/")[0] for x in inside}  # a file that Spark wrote is a folder
            chosen = set(named_files(list(below.values()), "lmat"))
            out += [x for x in inside if below[x] in chosen] or [path]
        else:
            beside = [x for x in listed_files(spark, folder or ".") if (n := x.rsplit("/", 1)[-1]).startswith(start) and n.endswith(".out") and "canVfin" not in n and "pyLCA" not in n]
            out += beside or [path]
    return out


def lmat_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All fields of LMAT records: file, line, read_id, sequence, average, deviation, kmers, candidates (tid, score) in order, tid, score, match.

    A file ends at its first line that has not five fields. Candidates without a score are left out.
    """
    part = F.split("value", "\t")
    lines = until_bad(numbered(spark, lmat_files(spark, paths)), F.size(part) != 5)
    words = lambda k: F.filter(F.split(F.trim(F.get(part, k)), r"\s+"), lambda x: x != "")
    names = F.create_map(*(F.lit(x) for pair in MATCHES.items() for x in pair))
    rows = lines.select("file", "line", *(words(k).alias(n) for k, n in ((0, "title"), (2, "figures"), (3, "listed"), (4, "final"))), F.get(part, 1).alias("sequence"))
    place = F.sequence(F.lit(0), F.floor(F.size("listed") / 2).cast("int") - 1)
    pairs = F.transform(place, lambda k: F.struct(F.get("listed", 2 * k).alias("tid"), F.get("listed", 2 * k + 1).try_cast("double").alias("score")))
    candidates = F.when(F.size("listed") > 1, F.filter(pairs, lambda x: x["score"].isNotNull())).otherwise(F.array().cast("array<struct<tid:string,score:double>>"))
    return rows.select(
        "file", "line", F.get("title", 0).alias("read_id"), "sequence", F.get("figures", 0).try_cast("double").alias("average"), F.get("figures", 1).try_cast("double").alias("deviation"),
        F.get("figures", 2).try_cast("long").alias("kmers"), candidates.alias("candidates"), F.get("final", 0).alias("tid"), F.get("final", 1).try_cast("double").alias("score"),
        F.try_element_at(names, F.get("final", 2)).alias("match"),
    )


def write_lmat(records: DataFrame, path: str) -> None:
    """Records, as lmat_records() gives them, in LMAT's format: title, sequence, figures, candidates, final call. Tabs and line ends in titles become spaces."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-1"))
    candidates = F.array_join(F.transform("candidates", lambda x: F.concat_ws(" ", x["tid"], x["score"].cast("string"))), " ")
    fields = [F.regexp_replace(F.coalesce("read_id", F.lit("")), r"[\t\r\n]", " "), F.coalesce("sequence", F.lit("")), F.concat_ws(" ", number("average"), number("deviation"), number("kmers")), candidates]
    final = F.concat_ws(" ", F.coalesce("tid", F.lit("0")), number("score"), F.coalesce("match", F.lit("NOMATCH")))
    records.select(F.concat_ws("\t", *fields, final).alias("value")).write.text(path)


def match_rates(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(sample, match, share): how an LMAT sample's reads match."""
    part = F.split("value", "\t")
    names = F.create_map(*(F.lit(x) for pair in MATCHES.items() for x in pair))
    lines = until_bad(numbered(spark, lmat_files(spark, paths)), F.size(part) != 5).select(_sample(), F.try_element_at(names, F.get(F.split(F.trim(F.get(part, 4)), r"\s+"), 2)).alias("match"))
    per = lines.groupBy("sample", "match").agg(F.count("*").alias("n"))
    return per.join(per.groupBy("sample").agg(F.sum("n").alias("whole")), "sample").select("sample", "match", (F.col("n") / F.col("whole")).alias("share"))


@dataclass(frozen=True)
class GenericFormat:
    """Columns, from 1, of a separated text format, as TYP:csv,TID:1,LEN:3,SCO:6,UNC:0 says."""

    separator: str
    tid: int
    length: int
    score: int
    unclassified: str

    @classmethod
    def parsed(cls, text: str) -> GenericFormat:
        fields = dict(x.strip().split(":", 1) for x in text.split(",") if ":" in x)
        fields = {k.strip().upper(): v.strip() for k, v in fields.items()}
        if missing := {"TYP", "TID", "LEN", "SCO", "UNC"} - fields.keys():
            raise ValueError(f"the format lacks {', '.join(sorted(missing))}")
        separators = {"CSV": ",", "TSV": "\t", "SSV": " "}
        if fields["TYP"].upper() not in separators:
            raise ValueError(f"no such type: {fields['TYP']}")
        columns = [int(fields[k]) for k in ("TID", "LEN", "SCO")]
        if min(columns) < 1 or len(set(columns)) < 3:
            raise ValueError("columns are different numbers from 1")
        return cls(separators[fields["TYP"].upper()], *columns, fields["UNC"])


def generic(spark: SparkSession, paths: str | list[str], form: GenericFormat) -> DataFrame:
    """Reads by a format. A first line that doesn't parse is a header. Quotes around values are taken off.

    A line of fewer than GENERIC_COLUMNS fields is an error, unless it is a header. So is a file with more bad lines than
    half of its good ones, once it has over GENERIC_TRIES good ones.
    """
    part = F.split("value", re.escape(form.separator))
    field = lambda k: F.trim(F.regexp_replace(F.trim(F.get(part, k - 1)), "^[\"']+|[\"']+$", ""))
    tid, length, score = field(form.tid), field(form.length).try_cast("long"), field(form.score).try_cast("double")
    lines = numbered(spark, paths).filter(F.trim("value") != "")
    plain = tid == form.unclassified
    header = (F.col("line") == 0) & (tid.isNull() | length.isNull() | (~plain & score.isNull()))
    found = _rows(lines.filter(~F.coalesce(header, F.lit(True))), plain, [tid, length], tid=tid, length=length, score=score)
    short = lines.filter((F.size(part) < GENERIC_COLUMNS) & ~((F.col("line") == 0) & F.coalesce(header, F.lit(True)))).select(_sample(), "line").first()
    if short:
        raise ValueError(f"line {short.line} of {short.sample} has fewer than {GENERIC_COLUMNS} columns")
    odd = found.groupBy("sample").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad")).filter(f"good > {GENERIC_TRIES} and 2 * bad > good").first()
    if odd:
        raise ValueError(f"{odd.bad} lines of {odd.sample} don't fit the format, {odd.good} do")
    return found


def go(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Gene-ontology annotations: five fields after a header; the score is the negative decimal logarithm of the e-value."""
    part = F.split("value", "\t")
    evalue, length = _number(F.get(part, 4)), _number(F.get(part, 3), "long")
    score = F.when(evalue <= 2e-308, GO_LARGEST_SCORE).otherwise(-F.log10(evalue))
    lines = numbered(spark, paths).filter("line > 0")
    return _rows(lines, F.lit(False), [evalue, length], tid=F.get(part, 2), length=length, score=score)


READERS = {"centrifuge": centrifuge, "kraken": kraken, "clark": clark, "lmat": lmat, "go": go}
#: The measure that a scoring takes; others take the score.
MEASURE = {"KRAKEN": "share", "CLARK_C": "conf", "CLARK_G": "gamma"}


def passing(reads: DataFrame, scoring: str, minscore: float | None = None, control_minscore: float | None = None, controls: list[str] = []) -> DataFrame:
    """Classified reads whose measure is `minscore` at least; controls have a limit of their own, by default the same.

    `score` is the scoring's measure afterwards, confidence in per cent.
    """
    measure = F.col(MEASURE.get(scoring, "score"))
    least = F.when(F.col("sample").isin(*controls), F.lit(control_minscore if control_minscore is not None else minscore)).otherwise(F.lit(minscore)).cast("double")
    kept = reads.filter(~F.col("bad") & ~F.col("unclassified")).filter(least.isNull() | (measure >= least))
    return kept.withColumn("score", 100 * measure if scoring == "CLARK_C" else measure)


def folder_inputs(spark: SparkSession, path: str, reader: str) -> list[str]:
    """The samples of a folder: its files that the reader takes, for LMAT its folders (but for the taxonomy's), sorted; none for a file."""
    inside = listed_files(spark, path)
    base = path.rstrip("/").rsplit("/", 1)[-1]
    if len(inside) == 1 and inside[0].endswith("/" + base):
        return []
    tails = [(x, x.rsplit(f"/{base}/", 1)[-1]) for x in inside]
    if reader == "lmat":
        return sorted({x[: len(x) - len(t)] + t.split("/")[0] for x, t in tails if "/" in t and not t.startswith((".", "taxdump/"))})
    chosen = set(named_files([t for _, t in tails if "/" not in t], reader))
    return [x for x, t in tails if t in chosen]


def named_files(names: list[str], reader: str) -> list[str]:
    """Of a folder's file names those that a reader takes, sorted; hidden ones are left out."""
    if reader == "lmat":
        return sorted(n for n in names if "_output" in n and n.endswith(".out") and "canVfin" not in n and "pyLCA" not in n)
    return sorted(n for n in names if not n.startswith(".") and n.endswith(EXTENSIONS[reader]))
