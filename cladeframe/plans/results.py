"""Queries of the one-call analysis over files and of its results: statistics, summaries, sheets, published tables, sequence utilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import analysis
from .. import ontology as O
from ..checkpoints import folder
from ..functions.ranks import go_rank
from ..functions.scores import group_score
from ..operators import sequences, stats, summary, tree, views
from ..sources import classified, sequence_files, sinks
from . import comparisons as C
from . import driver_tables as T
from .catalog import LEAST, query
from .files import _file

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
LIMIT, CONTROL_LIMIT = 30, 35

# ---------------------------------------------------------------------------------------------- the one call


def _sample_files(spark, sf, tid: str = "concat('C', o_custkey)", open_: str = "o_orderstatus = 'P'") -> list[str]:
    """Orders as Centrifuge output, a folder of files for each priority; one line in a hundred is odd."""
    out = []
    for priority in PRIORITIES:
        rows = T.table(spark, sf, "orders").filter(F.col("o_orderpriority") == priority)
        columns = ["o_orderkey", "'s'", f"if({open_}, '0', {tid})", "if(o_orderkey % 100 = 0, 'x', string(o_custkey % 997))", "0", "60", "100 + o_orderkey % 50", "1"]
        lines = rows.select(*(F.expr(c).cast("string").alias(f"f{n}") for n, c in enumerate(columns)))
        out.append(_file(lines, "one-call", inside=f"/{priority}.out"))
    return out


def _marked(tid: str = "'C' || o_custkey", open_: str = "o_orderstatus = 'P'") -> str:
    return f"""marked AS (SELECT o_orderpriority AS sample, {tid} AS tid, sqrt(CAST(o_custkey % 997 AS DOUBLE)) + 15 AS score, 100 + o_orderkey % 50 AS length, o_orderkey % 100 = 0 AS bad,
  {open_} AS open, CASE WHEN o_orderpriority = '1-URGENT' THEN {CONTROL_LIMIT} ELSE {LIMIT} END AS score_limit FROM orders)"""


_KEPT = "NOT bad AND NOT open AND score >= score_limit"


def _analysed(spark, sf, scoring: str, summaries: str = "ADD", **options) -> analysis.Analysis:
    return analysis.analyse(
        spark, "centrifuge", _sample_files(spark, sf), T.ontology(spark, sf), 1, scoring, LIMIT, CONTROL_LIMIT, LEAST, LEAST, ["SPECIES", "GENUS", "FAMILY"], summaries, **options, **C.LIMITS,
    )


_FIGURES = f"""SELECT sample, count(*) FILTER (NOT bad) AS seqs_read, count(*) FILTER (NOT bad AND open) AS seqs_unclassified, count(*) FILTER (NOT bad AND NOT open) AS seqs_classified,
 count(*) FILTER ({_KEPT}) AS seqs_filtered, count(*) FILTER (bad) AS seqs_bad, count(DISTINCT tid) FILTER (NOT bad AND NOT open) AS ids_classified,
  count(DISTINCT tid) FILTER ({_KEPT}) AS ids_filtered,
 CAST(sum(length) FILTER (NOT bad) AS BIGINT) AS nt_read, min(length) FILTER ({_KEPT}) AS length_min, CAST(floor(avg(length) FILTER ({_KEPT})) AS BIGINT) AS length_mean,
  max(length) FILTER ({_KEPT}) AS length_max,
 min(score) FILTER ({_KEPT}) AS score_min, avg(score) FILTER ({_KEPT}) AS score_mean, max(score) FILTER ({_KEPT}) AS score_max,
 count(*) FILTER (NOT bad AND open) / count(*) FILTER (NOT bad) AS unclassified_ratio,
 (count(*) FILTER (NOT bad AND NOT open) - count(*) FILTER ({_KEPT})) / count(*) FILTER (NOT bad AND NOT open) AS reject_ratio, CAST(max(score_limit) AS DOUBLE) AS score_limit FROM marked GROUP BY sample"""
_FOLDS = f"""acc AS (SELECT sample, anc AS tid, count(*) AS acc FROM marked JOIN paths USING (tid) WHERE {_KEPT} GROUP BY sample, anc),
kept AS (SELECT * FROM acc WHERE acc >= {LEAST} OR tid = '1'), below AS (SELECT sample, parent AS tid, sum(acc) AS b FROM kept JOIN up USING (tid) GROUP BY sample, parent),
folded AS (SELECT sample, count(*) FILTER (acc > coalesce(b, 0)) AS ids_folded FROM kept LEFT JOIN below USING (sample, tid) GROUP BY sample)"""


@query("+" + _marked() + f", figures AS ({_FIGURES}),\n" + _FOLDS.replace("acc AS (", "acc2 AS (", 1).replace("FROM acc WHERE", "FROM acc2 WHERE") + "\nSELECT figures.*, ids_folded FROM figures JOIN folded USING (sample)")
def analysis_statistics(spark, sf):
    """Each sample's statistics from its file on to what is left in its folded tree, with a limit of its own for the control."""
    found = _analysed(spark, sf, "SHEL").stats
    return found.drop("nt_text", "is_ctrl", "mintaxa")


_READ_KEPT = _marked() + f", reads AS (SELECT sample, tid, score, length FROM marked WHERE {_KEPT})"
_SHEL_DERIVED = C._compared(C._PLAIN_TREE, _READ_KEPT, C.FALLING)
_LOGLENGTH = "counts AS (SELECT sample, tid, count(*) AS count, count(*) * log10(avg(length)) AS total FROM reads GROUP BY sample, tid)"
_LOG_DERIVED = C._compared(C._PLAIN_TREE, _READ_KEPT, C.FALLING, True, _LOGLENGTH)


@query(_SHEL_DERIVED + C._SHOW.format(6), over_tree=False)
def analysis_derived(spark, sf):
    """What the one call compares, from files to derived samples."""
    return C._shown(_analysed(spark, sf, "SHEL").derived, 6)


@query(_LOG_DERIVED + C._SHOW.format(6), over_tree=False)
def analysis_log_lengths(spark, sf):
    """The same with logarithms of lengths as scores: means as they are in raw trees, by powers of ten in the comparison."""
    return C._shown(_analysed(spark, sf, "LOGLENGTH").derived, 6)


def _summary_level(depth: int) -> str:
    """SQL of a level of summaries: what is left after what is below, and what rises."""
    below = f"(SELECT kind, raw_sample, parent AS tid, sum(passed) AS b, sum(acc) AS ba, sum(acc * score) FILTER (score IS NOT NULL) / nullif(sum(acc) FILTER (score IS NOT NULL), 0) AS bs FROM s{depth + 1} JOIN up USING (tid) GROUP BY ALL)" if depth < 3 else "(SELECT NULL AS kind, NULL AS raw_sample, NULL AS tid, 0 AS b, 0 AS ba, NULL AS bs WHERE false)"
    return f"""s{depth} AS (SELECT kind, raw_sample, tid, rest AS count, rest + coalesce(ba, 0) AS acc, CASE WHEN rest > 0 THEN score ELSE bs END AS score, CASE WHEN enough THEN n ELSE n + b END AS passed
  FROM (SELECT g.*, b, ba, bs, n >= coalesce(b, 0) AS enough, CASE WHEN n >= coalesce(b, 0) THEN n - coalesce(b, 0) ELSE n END AS rest
    FROM grown g LEFT JOIN {below} x ON x.kind = g.kind AND x.raw_sample IS NOT DISTINCT FROM g.raw_sample AND x.tid = g.tid WHERE g.depth = {depth}))"""


_SUMMARY = ", merged AS (SELECT kind, raw_sample, tid, sum(count) AS n, arg_max(score, CASE rank WHEN 'SPECIES' THEN 1 WHEN 'GENUS' THEN 2 ELSE 3 END) AS score FROM found GROUP BY ALL),\n"
_SUMMARY += "grown AS (SELECT t.kind, t.raw_sample, t.tid, t.depth, coalesce(n, 0) AS n, score FROM (SELECT DISTINCT kind, raw_sample, i.tid, i.depth FROM merged m JOIN paths p USING (tid) JOIN info i ON i.tid = p.anc) t LEFT JOIN merged m ON m.kind = t.kind AND m.raw_sample IS NOT DISTINCT FROM t.raw_sample AND m.tid = t.tid),\n"
_SUMMARY += ",\n".join(_summary_level(d) for d in (3, 2, 1, 0))
_SUMMARY += "\nSELECT kind, raw_sample, tid, CAST(acc AS BIGINT) AS acc, CAST(count AS BIGINT) AS count, round(score, 6) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(4)) + ") WHERE acc > 0"


@query(_SHEL_DERIVED + _SUMMARY, over_tree=False)
def analysis_summaries(spark, sf):
    """The one call's summaries over ranks, with scores."""
    return _analysed(spark, sf, "SHEL").summaries.select("kind", "raw_sample", "tid", "acc", "count", F.round("score", 6).alias("score"))


@query(_LOG_DERIVED + _SUMMARY, over_tree=False)
def analysis_log_summaries(spark, sf):
    """Summaries of logarithms of lengths."""
    return _analysed(spark, sf, "LOGLENGTH").summaries.select("kind", "raw_sample", "tid", "acc", "count", F.round("score", 6).alias("score"))


_TOP = "CASE WHEN o_orderkey % 9 = 0 THEN '131567' WHEN o_orderkey % 11 = 0 AND o_orderpriority <> '5-LOW' THEN '1' ELSE 'C' || o_custkey END"


@query("+" + _marked(_TOP) + f""", moved AS (SELECT *, CASE WHEN tid = '131567' THEN '1' ELSE tid END AS node FROM marked),
tops AS (SELECT sample, count(*) FILTER ({_KEPT} AND node = '1') AS at_root, count(*) FILTER ({_KEPT}) AS passed, count(DISTINCT node) FILTER ({_KEPT}) AS nodes,
  count(DISTINCT tid) FILTER (NOT bad AND NOT open) AS ids_classified, count(*) FILTER (NOT bad AND NOT open) AS seqs_classified, avg(score) FILTER ({_KEPT}
  AND node = '1') AS root_score FROM moved GROUP BY sample)
SELECT sample, take_out, seqs_classified, ids_classified, passed - CASE WHEN take_out THEN at_root ELSE 0 END AS seqs_filtered, nodes - CASE WHEN take_out
  AND at_root > 0 THEN 1 ELSE 0 END AS ids_filtered,
  (seqs_classified - passed + CASE WHEN take_out THEN at_root ELSE 0 END) / seqs_classified AS reject_ratio FROM tops, (VALUES (true), (false)) t(take_out)""")
def root_statistics(spark, sf):
    """Statistics with reads of "cellular organisms" moved to the root, and with and without the root's reads."""
    paths = _sample_files(spark, sf, "case when o_orderkey % 9 = 0 then '131567' when o_orderkey % 11 = 0 and o_orderpriority != '5-LOW' then '1' else concat('C', o_custkey) end")
    found = None
    for take_out in (True, False):
        own = analysis.analyse(spark, "centrifuge", paths, T.ontology(spark, sf), 1, None, LIMIT, CONTROL_LIMIT, LEAST, take_out_root=take_out, avoid_cross=True).stats
        own = own.select("sample", F.lit(take_out).alias("take_out"), "seqs_classified", "ids_classified", "seqs_filtered", "ids_filtered", "reject_ratio")
        found = own if found is None else found.unionByName(own)
    return found


# -------------------------------------------------------------------------------------------- tables and sheets

_CELLS = ", ".join(f"CAST(coalesce(max(c) FILTER (col = '{p}'), 0) AS BIGINT) AS \"{p}\"" for p in PRIORITIES)
_SHEETS = f""", cells AS (SELECT 'raw_samples_no_rank' AS sheet, sample AS col, tid, CAST(count AS BIGINT) AS c FROM fact WHERE count > 0
  UNION ALL SELECT 'CTRL_' || lower(rank), raw_sample, tid, count FROM found WHERE kind = 'CTRL' AND count > 0),
every AS (SELECT DISTINCT tid FROM fact), sheets AS (SELECT DISTINCT sheet FROM cells)
SELECT s.sheet, e.tid, lower(t.rank) AS "__Rank", {_CELLS} FROM every e CROSS JOIN sheets s JOIN tree t ON t.tid = e.tid LEFT JOIN cells c ON c.sheet = s.sheet AND c.tid = e.tid GROUP BY s.sheet, e.tid, t.rank"""


@query(_SHEL_DERIVED + _SHEETS, over_tree=False)
def dynomics_sheets(spark, sf):
    """All sheets of raw and control-subtracted samples, published and read back, each as a wide table with its own columns."""
    path = folder(spark, "dynomics")
    _analysed(spark, sf, "SHEL").write(path, "DYNOMICS")
    sheets = sinks.published(spark, path)["sheets"]
    found = None
    for name in sorted(r.sheet for r in sheets.select("sheet").distinct().collect()):  # one a rank
        own = sinks.sheet_table(sheets, name).drop("__Name").withColumn("sheet", F.lit(name))
        found = own if found is None else found.unionByName(own, allowMissingColumns=True)
    return found.fillna(0, PRIORITIES)


_FULL_NAMES = """, names AS (SELECT sample, tid, acc, count, score FROM fact UNION ALL SELECT concat_ws('_', raw_sample, kind, lower(rank)), tid, acc, count, score FROM found)
SELECT sample, tid, CAST(acc AS BIGINT) AS cnt, CAST(count AS BIGINT) AS una, round(score, 6) AS sco FROM names"""


@query(_SHEL_DERIVED + _FULL_NAMES, over_tree=False)
def full_table(spark, sf):
    """Statistics and data published together and read back: the wide table's cells, a row a sample and node."""
    path = folder(spark, "full")
    found = _analysed(spark, sf, "SHEL", "AVOID")
    found.write(path, "FULL")
    data = sinks.published(spark, path)["data"]
    names = [c[: -len("_cnt")] for c in data.columns if c.endswith("_cnt")]
    cells = F.array(*(F.struct(F.lit(n).alias("sample"), *(F.col(f"`{n}_{m}`").alias(m) for m in ("cnt", "una", "sco"))) for n in names))
    rows = data.select("tid", F.explode(cells).alias("x")).select("x.*", "tid").filter("cnt is not null")
    return rows.withColumn("sco", F.round("sco", 6))


_LISTED = ["seqs_read", "seqs_unclassified", "seqs_classified", "seqs_filtered", "score_min", "score_mean", "score_max", "length_min", "length_mean", "length_max", "nt_read", "ids_classified", "ids_filtered", "ids_folded", "score_limit"]


@query("+" + _marked() + f", figures AS ({_FIGURES}),\n" + _FOLDS.replace("acc AS (", "acc2 AS (", 1).replace("FROM acc WHERE", "FROM acc2 WHERE")
       + ", wide AS (SELECT figures.*, ids_folded FROM figures JOIN folded USING (sample)), long AS ("
       + " UNION ALL ".join(f"SELECT {k} AS place, '{stats.TITLES[c]}' AS statistic, sample, CAST({c} AS DOUBLE) AS v FROM wide" for k, c in enumerate(_LISTED)) + ") SELECT place, statistic, "
       + ", ".join(f"max(v) FILTER (sample = '{p}') AS \"{p}\"" for p in PRIORITIES) + " FROM long GROUP BY place, statistic")
def statistics_table(spark, sf):
    """The table of statistics as results list it, a column a sample."""
    return stats.statistics_table(_analysed(spark, sf, "SHEL").stats, PRIORITIES)


@query("""+own AS (SELECT sample, anc AS tid, CAST(sum(count) AS BIGINT) AS acc FROM counts JOIN paths USING (tid) WHERE tid IN (SELECT 'C' || c_custkey FROM customer WHERE c_custkey < 30) GROUP BY sample, anc)
SELECT a.sample, u.parent, a.tid FROM own a JOIN up u USING (tid) JOIN own b ON b.sample = a.sample AND b.tid = u.parent WHERE a.acc = b.acc""")
def collapsed_chains(spark, sf):
    """Nodes whose parent has just the same reads, of a few customers' reads, so that there are some."""
    few = T.counts(spark, sf).filter(F.expr("try_cast(substring(tid, 2) AS long) < 30"))
    return views.chains(tree.accumulated(few, T.ontology(spark, sf)), T.ontology(spark, sf))


# ------------------------------------------------------------------------------------------------ more readers


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey + 1 AS c, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS part FROM orders),
ends AS (SELECT part, min(k) AS last FROM o WHERE k % 997 = 0 GROUP BY part), live AS (SELECT o.* FROM o LEFT JOIN ends USING (part) WHERE last IS NULL OR k < last)
SELECT 'run' AS sample, CAST(c AS VARCHAR) AS tid, k % 30 + 1 AS length, CAST(c % 100 AS DOUBLE) AS score FROM live WHERE part < 5 AND k % 3 <> 2""", over_tree=False)
def lmat_folder(spark, sf):
    """A sample of several files, by their folder, each read up to its first malformed line; files of another kind are left out."""
    path = _lmat_folder(spark, sf)
    found = classified.lmat(spark, f"{path}/run").filter("not bad and not unclassified")
    return found.select(F.lit("run").alias("sample"), "tid", "length", "score")


def _lmat_folder(spark, sf) -> str:
    """Five files of LMAT records in order of k; a line whose k is a multiple of 997 is malformed, the fifth file is of another kind."""
    path = folder(spark, "lmat-folder")
    rows = T.table(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_custkey + 1 AS c", "int(substr(o_orderpriority, 1, 1)) AS part")
    match = "case when k % 3 = 0 then 'DirectMatch' when k % 3 = 1 then 'MULTI' else 'NoDbHits' end"
    line = f"if(k % 997 = 0, 'end of run', concat_ws('\t', concat('r', k, ' x'), repeat('A', int(k % 30 + 1)), concat(k % 10, ' 0.5 ', k % 7), if(k % 5 = 0, '', concat(c, ' 0.25 ', c + 1, ' -1.5 9')), concat(c, ' ', c % 100, ' ', {match})))"
    for part in range(1, 6):
        name = f"p{part}_output.out" if part < 5 else "p5_output.canVfin.out"
        own = rows.filter(F.col("part") == part).select(F.col("k"), F.expr(line).alias("value"))
        # One file for a part, its lines in order: the format ends at a bad line.
        own.coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{path}/run/{name}")
    return path


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), live AS (SELECT * FROM o WHERE k < coalesce((SELECT min(k) FROM o WHERE k % 9973 = 9972), 1e18))
SELECT 'r' || k AS read_id, 'C' || c AS tid, sqrt(CAST(c % 997 AS DOUBLE)) + 15 AS score, sqrt(CAST(k % 13 AS DOUBLE)) + 15 AS second_score, k % 4 AS matches FROM live""", over_tree=False)
def centrifuge_whole_records(spark, sf):
    """Records of eight fields with both scores, up to the first malformed line."""
    line = "if(o_orderkey % 9973 = 9972, 'cut', concat_ws('\t', concat('r', o_orderkey, ' x'), 's', concat('C', o_custkey), o_custkey % 997, o_orderkey % 13, 60, 90, o_orderkey % 4)) AS value"
    path = folder(spark, "records")
    rows = T.table(spark, sf, "orders").selectExpr("o_orderkey", line).coalesce(1).sortWithinPartitions("o_orderkey")  # one file, in order
    rows.select("value").write.text(path)
    return classified.centrifuge_records(spark, path).select("read_id", "tid", "score", "second_score", "matches")


@query("""SELECT 'r' || o_orderkey AS read_id, CAST(o_custkey AS VARCHAR) AS tid, CAST(o_orderkey % 9 AS DOUBLE) AS score, 'MULTIMATCH' AS match, CAST(o_orderkey % 2 AS INTEGER) AS n_candidates FROM orders""", over_tree=False)
def lmat_round_trip(spark, sf):
    """Records written in LMAT's format and read back."""
    rows = T.table(spark, sf, "orders").selectExpr("concat('r', o_orderkey) AS read_id", "'ACGT' AS sequence", "0.5D AS average", "0.25D AS deviation", "o_orderkey % 7 AS kmers",
        "if(o_orderkey % 2 = 0, cast(array() AS array<struct<tid:string,score:double>>), array(struct(string(o_custkey) AS tid, double(1.5) AS score))) AS candidates",
        "string(o_custkey) AS tid", "double(o_orderkey % 9) AS score", "'MULTIMATCH' AS match")
    path = f"{folder(spark, 'lmat')}/a_output.out"
    classified.write_lmat(rows, path)
    return classified.lmat_records(spark, path).select("read_id", "tid", "score", "match", F.size("candidates").alias("n_candidates"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey + 1 AS c, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS part FROM orders),
ends AS (SELECT part, min(k) AS last FROM o WHERE k % 997 = 0 GROUP BY part), live AS (SELECT o.* FROM o LEFT JOIN ends USING (part) WHERE (last IS NULL OR k < last) AND part < 5)
SELECT 'r' || k AS read_id, CAST(k % 10 AS DOUBLE) AS average, 0.5::DOUBLE AS deviation, k % 7 AS kmers,
  CASE k % 3 WHEN 0 THEN 'DIRECTMATCH' WHEN 1 THEN 'MULTIMATCH' ELSE 'NODBHITS' END AS match,
 CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE 2 END AS INTEGER) AS n_candidates, CASE WHEN k % 5 <> 0 THEN c || ':0.25,' || (c + 1) || ':-1.5' ELSE '' END AS candidates FROM live""", over_tree=False)
def lmat_candidates(spark, sf):
    """Whole records, with each one's candidates in order."""
    found = classified.lmat_records(spark, f"{_lmat_folder(spark, sf)}/run")
    text = F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["tid"], x["score"].cast("string"))), ",")
    return found.select("read_id", "average", "deviation", "kmers", "match", F.size("candidates").alias("n_candidates"), text.alias("candidates"))


@query("SELECT 'r' || o_orderkey || ' x' AS title, repeat('ACGT', CAST(o_orderkey % 5 + 1 AS INTEGER)) AS seq, o_orderkey % 2 = 0 AS zipped FROM orders", over_tree=False)
def sniffed_fastq(spark, sf):
    """Plain and gzipped files whose names do not tell which they are."""
    path = folder(spark, "sniffed")
    rows = T.table(spark, sf, "orders").selectExpr("o_orderkey AS record", "concat('r', o_orderkey, ' x') AS title", "repeat('ACGT', int(o_orderkey % 5 + 1)) AS seq", "repeat('IIII', int(o_orderkey % 5 + 1)) AS qual")
    sequence_files.write_fastq(rows.filter("record % 2 = 1"), f"{path}/plain")
    sequence_files.write_fastq(rows.filter("record % 2 = 0"), f"{path}/packed", "gzip")
    _without_extension(spark, f"{path}/packed")
    found = sequence_files.fastq(spark, [f"{path}/plain", f"{path}/packed"], sniff=True)
    return found.select("title", "seq", F.col("file").contains("/packed/").alias("zipped"))


def _without_extension(spark, path: str) -> None:
    """Takes .gz off the names of a folder's files, by Hadoop's file system, which knows all that Spark can write to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(place):
        old = status.getPath()
        if old.getName().endswith(".gz"):
            system.rename(old, spark._jvm.org.apache.hadoop.fs.Path(place, old.getName()[:-3]))


@query("""WITH a AS (SELECT o_orderkey AS record FROM orders) SELECT 'r' || record || '/1' AS title, 'r' || record || '/2' AS mate_title, repeat('A', CAST(record % 5 + 1 AS INTEGER)) AS seq, repeat('C', CAST(record % 4 + 1 AS INTEGER)) AS mate_seq FROM a""", over_tree=False)
def mate_pairs(spark, sf):
    """Two files of mates, paired by their records' numbers."""
    rows = T.table(spark, sf, "orders").selectExpr("o_orderkey AS record")
    paths = []
    for mate, letter, size in ((1, "A", 5), (2, "C", 4)):
        own = rows.selectExpr("record", f"concat('r', record, '/{mate}') AS title", f"repeat('{letter}', int(record % {size} + 1)) AS seq", f"repeat('I', int(record % {size} + 1)) AS qual")
        paths.append(folder(spark, f"mates{mate}"))
        own.coalesce(1).sortWithinPartitions("record").drop("record").select(F.concat_ws("\n", F.concat(F.lit("@"), "title"), "seq", F.lit("+"), "qual").alias("value")).write.text(paths[-1])
    return sequence_files.mates(*(sequence_files.fastq(spark, p) for p in paths)).select("title", "mate_title", "seq", "mate_seq")


@query("""WITH r AS (SELECT o_orderkey AS record, 'a' || o_orderkey || ' protein' AS title, repeat('ACGT', CAST(o_orderkey % 5 + 1 AS INTEGER)) AS seq FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 5 AND o_orderkey % 3 > 0)
SELECT title, seq FROM r""", over_tree=False)
def accession_extract(spark, sf):
    """Records whose accession is mapped to a node of some nations."""
    orders = T.table(spark, sf, "orders")
    mapped = orders.filter("o_orderkey % 3 > 0").selectExpr("concat('a', o_orderkey) AS a", "concat('C', o_custkey) AS t")
    accessions = sequence_files.accessions(spark, _file(mapped, "map", " ", header=False))
    path = folder(spark, "proteins")
    # Sequences of more than one line.
    lines = orders.selectExpr("concat('>a', o_orderkey, ' protein\n', regexp_replace(repeat('ACGT', int(o_orderkey % 5 + 1)), '(.{6})', '$1\n')) AS value")
    lines.select(F.rtrim("value").alias("value")).write.text(path)
    ids = tree.selected_ids(T.ontology(spark, sf), [f"N{k}" for k in range(5)], [])
    return sequences.accession_records(sequence_files.fasta(spark, path), accessions, ids).select("title", "seq")


@query("""WITH picked AS (SELECT o_orderkey AS record FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 AND o_orderkey < 40000)
SELECT record FROM (SELECT record, row_number() OVER (ORDER BY record) AS n FROM picked) WHERE n <= 300""", over_tree=False)
def limited_records(spark, sf):
    """The first so many records, of so many that are looked at, whose reads are of one nation."""
    records = T.table(spark, sf, "orders").selectExpr("o_orderkey AS record", "concat('r', o_orderkey, '/1 x') AS title")
    ids = tree.selected_ids(T.ontology(spark, sf), ["N3"], [])
    wanted = T.reads(spark, sf).join(ids, "tid", "left_semi").select(F.concat(F.lit("r"), F.col("read_id").cast("string")).alias("read_id"))
    return sequences.matched_records(records, wanted, limit=300, maxreads=40_000).select("record")


@query("""WITH records AS (SELECT o_orderkey AS record, o_custkey FROM orders), found AS (SELECT record FROM records JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3)
SELECT (SELECT count(*) FROM found) AS matched, (SELECT count(*) FROM records) AS scanned, (SELECT count(*) FROM found) / (SELECT count(*) FROM records) AS rate""", over_tree=False)
def match_rate(spark, sf):
    records = T.table(spark, sf, "orders").selectExpr("o_orderkey AS record", "concat('r', o_orderkey, '/1 x') AS title")
    ids = tree.selected_ids(T.ontology(spark, sf), ["N3"], [])
    wanted = T.reads(spark, sf).join(ids, "tid", "left_semi").select(F.concat(F.lit("r"), F.col("read_id").cast("string")).alias("read_id"))
    return sequences.match_rate(sequences.matched_records(records, wanted), records)


_SHEET_ROWS = "SELECT o_custkey % 40 + 1 AS t, o_orderpriority AS sample, count(*) AS n FROM orders GROUP BY ALL"
_DRAW = "CAST(('0x' || substr(md5(concat_ws(':', {}, '{}')), 1, 8)) AS BIGINT) / 4294967296.0"


def _sheet(spark, sf) -> str:
    """Numbers of reads by node and sample as a sheet, with sums in its last line."""
    rows = T.table(spark, sf, "orders").selectExpr("o_custkey % 40 + 1 AS t", "o_orderpriority AS p")
    cells = rows.groupBy("t").pivot("p", PRIORITIES).count()
    body = cells.select(F.concat(F.lit('name, of "'), F.col("t").cast("string")).alias("names"), F.col("t").cast("string").alias("ids"), *(F.col(f"`{p}`").cast("string") for p in PRIORITIES))
    sums = cells.agg(*(F.sum(f"`{p}`").cast("string").alias(p) for p in PRIORITIES)).select(F.lit("sum").alias("names"), F.lit("").alias("ids"), "*")
    path = folder(spark, "sheet")
    ordered = body.withColumn("o", F.lit(0)).unionByName(sums.withColumn("o", F.lit(1)))
    ordered.coalesce(1).sortWithinPartitions("o", "ids").drop("o").write.option("escape", '"').csv(path, header=True)  # a sheet is one file
    return path


@query(f"""WITH cells AS ({_SHEET_ROWS}) SELECT sample, CAST(t AS VARCHAR) AS tid, n FROM cells""", over_tree=False)
def mock_sheet_layout(spark, sf):
    return sequence_files.mock_sheet(spark, _sheet(spark, sf))


@query(f"""WITH cells AS ({_SHEET_ROWS}), tops AS (SELECT sample, CAST(t AS VARCHAR) AS tid, n, 16 + CAST(floor({_DRAW.format("sample, CAST(t AS VARCHAR)", 18490)} * 135) AS BIGINT) AS top FROM cells),
reads AS (SELECT *, unnest(range(1, n + 1)) AS k FROM tops), hits AS (SELECT *,
  16 + CAST(floor({_DRAW.format("sample, tid, CAST(k AS VARCHAR)", 18491)} * (top - 15)) AS BIGINT) AS hit FROM reads)
SELECT sample, 'test_' || tid || '_' || k AS read_id, tid, CAST((hit - 15) * (hit - 15) AS DOUBLE) AS score, CAST(200 AS BIGINT) AS length FROM hits""", over_tree=False)
def mock_sheet_reads(spark, sf):
    """Reads made up by a sheet: draws depend on the sample, the node and the read's number alone."""
    return sequences.mock_reads(sequence_files.mock_sheet(spark, _sheet(spark, sf)), keys=["sample"])


# --------------------------------------------------------------------------------------------------- ontologies


@query("""SELECT tid, parent, rank, name FROM (SELECT tid, parent, CASE rank WHEN 'ROOT' THEN 'NO_RANK' ELSE rank END AS rank, name FROM tree
UNION ALL SELECT 'P' || s_suppkey, 'N' || s_nationkey, 'UNCLASSIFIED', 'Plasmid ' || CASE s_suppkey % 3 WHEN 0 THEN 'pX' || s_suppkey ELSE 'loose words ' || s_suppkey END FROM supplier WHERE s_suppkey % 10 > 0)""")
def plasmid_nodes(spark, sf):
    """A taxonomy with plasmids: known ids and lines that are their own parent are left out, names are taken from descriptions."""
    path, nodes = folder(spark, "plasmids"), T.nodes(spark, sf)
    ranks = F.when(F.col("rank") == "ROOT", "no rank").otherwise(F.lower("rank"))
    rows = nodes.select(F.concat_ws("\t|\t", "tid", "parent", ranks, F.lit("XX")).alias("value"))
    rows.write.text(f"{path}/nodes.dmp")
    nodes.select(F.concat_ws("\t|\t", "tid", "name", F.lit(""), F.lit("scientific name")).alias("value")).write.text(f"{path}/names.dmp")
    text = "case s_suppkey % 3 when 0 then concat('gi|1|Some strain \"pX', s_suppkey, '\"') else concat('gi|2|loose words ', s_suppkey) end"
    lines = T.table(spark, sf, "supplier").selectExpr(f"concat_ws('\t', if(s_suppkey % 10 = 0, concat('N', s_nationkey), concat('P', s_suppkey)), concat('N', s_nationkey), 'x', {text}) AS value")
    lines.write.text(f"{path}/plasmids.txt")
    return O.load_ncbi(spark, path, f"{path}/plasmids.txt").nodes.select("tid", "parent", "rank", "name")


@query("SELECT tid, CASE rank WHEN 'ROOT' THEN 'GO0' WHEN 'FAMILY' THEN 'GO1' WHEN 'GENUS' THEN 'GO2' ELSE 'GO3' END AS rank FROM tree")
def depth_ranks(spark, sf):
    """Ranks of a gene ontology's nodes by their depth."""
    tops = T.ontology(spark, sf)
    return O.with_depth(tops.nodes, tops.closure()).select("tid", go_rank(F.col("depth")).alias("rank"))


@query("""WITH g AS (SELECT o_orderpriority AS sample, 'GO:N' || (o_custkey % 25) AS tid, count(*) AS n, avg(o_orderkey % 200) AS score FROM orders GROUP BY ALL),
kept AS (SELECT * FROM g WHERE n >= 2), names AS (SELECT count(DISTINCT sample) AS all_samples FROM g)
SELECT 'SHARED' AS kind, 'GO2' AS rank, NULL::VARCHAR AS raw_sample, tid, CAST(sum(n) // max(all_samples) AS BIGINT) AS count, round(sum(n * score) / sum(n), 6) AS score FROM kept, names GROUP BY tid HAVING count(*) = max(all_samples)""", over_tree=False)
def go_comparison(spark, sf):
    """Annotations compared at the depths of a gene ontology, which are found without being named; what all samples share at one of them."""
    path = folder(spark, "go-one-call")
    orders, files = T.table(spark, sf, "orders"), []
    for priority in PRIORITIES:
        rows = orders.filter(F.col("o_orderpriority") == priority).selectExpr("string(o_orderkey) AS a", "'x' AS b", "concat('GO:N', o_custkey % 25) AS c", "string(100 + o_orderkey % 50) AS d", "concat('1e-', o_orderkey % 200) AS e")
        files.append(_file(rows, "go", inside=f"/{priority}.out"))
    nations = T.table(spark, sf, "nation").selectExpr("concat('GO:N', n_nationkey) AS tid", "'GO:0003674' AS parent")
    nations.coalesce(1).write.csv(f"{path}/nodes.dmp", sep="\t", header=True)
    nations.selectExpr("tid", "'x' AS activity", "tid AS name").coalesce(1).write.csv(f"{path}/names.dmp", sep="\t", header=True)
    found = analysis.analyse(spark, "go", files, O.load_go(spark, path), summaries="AVOID").derived
    return found.filter("kind = 'SHARED' and rank = 'GO2' and count > 0").select("kind", "rank", "raw_sample", "tid", "count", F.round("score", 6).alias("score"))


@query(None)
def analysis_summaries_only(spark, sf):
    """The one call when only summaries are asked for."""
    found = _analysed(spark, sf, "SHEL", "ONLY")
    return found.everything().select("sample", "kind", "tid", "acc", "count")


# ------------------------------------------------------------------------------------- scores of each reader


def _grouped_scores(reads: DataFrame, scoring: str, minscore: float) -> DataFrame:
    """Reads that pass by the scoring's own measure, and their group score, by node."""
    kept = classified.passing(reads, scoring, minscore)
    score = F.round(group_score(scoring, F.col("score"), F.col("length")), 6)
    return kept.groupBy("tid").agg(F.count("*").alias("n"), score.alias("score"))


def _of_orders(spark, sf, *columns: str) -> DataFrame:
    return T.table(spark, sf, "orders").selectExpr(*(f"string({c}) AS f{n}" for n, c in enumerate(columns)))


@query("""WITH r AS (SELECT o_custkey + 1 AS tid, 100.0 * (o_orderkey % 7 + 1) / (o_orderkey % 7 + o_orderkey % 5 + 2) AS share FROM orders)
SELECT CAST(tid AS VARCHAR) AS tid, count(*) AS n, round(avg(share), 6) AS score FROM r WHERE share >= 40 GROUP BY tid""", over_tree=False)
def scoring_kraken(spark, sf):
    """Shares of k-mers, in per cent, that also decide which reads pass."""
    lines = _of_orders(spark, sf, "'C'", "o_orderkey", "o_custkey + 1", "100", "concat(o_custkey + 1, ':', o_orderkey % 7 + 1, ' 0:', o_orderkey % 5 + 1)")
    return _grouped_scores(classified.kraken(spark, _file(lines, "kraken", header=False)), "KRAKEN", 40)


def _clark(spark, sf) -> DataFrame:
    lines = _of_orders(spark, sf, "o_orderkey", "100", "o_orderkey % 9 / 10", "if(o_orderkey % 4 = 0, 'NA', string(o_custkey))", "5", "o_custkey", "3", "o_orderkey % 11 / 10")
    return classified.clark(spark, _file(lines, "clark", ","))


@query("""WITH r AS (SELECT o_custkey AS tid, CASE WHEN o_orderkey % 4 = 0 THEN 1 - o_orderkey % 11 / 10.0 ELSE o_orderkey % 11 / 10.0 END AS conf FROM orders)
SELECT CAST(tid AS VARCHAR) AS tid, count(*) AS n, CAST(round(avg(100.0 * conf), 6) AS DOUBLE) AS score FROM r WHERE conf >= 0.35 GROUP BY tid""", over_tree=False)
def scoring_clark_c(spark, sf):
    """Confidences from 0 to 1 decide which reads pass; scores are in per cent. The rest of it counts for a second assignment."""
    return _grouped_scores(_clark(spark, sf), "CLARK_C", 0.35)


@query("""SELECT CAST(o_custkey AS VARCHAR) AS tid, count(*) AS n, CAST(round(avg(o_orderkey % 9 / 10.0), 6) AS DOUBLE) AS score FROM orders WHERE o_orderkey % 9 / 10.0 >= 0.45 GROUP BY o_custkey""", over_tree=False)
def scoring_clark_g(spark, sf):
    return _grouped_scores(_clark(spark, sf), "CLARK_G", 0.45)


@query("SELECT CAST(o_custkey + 1 AS VARCHAR) AS tid, count(*) AS n, round(avg(o_orderkey % 100), 6) AS score FROM orders WHERE o_orderkey % 100 >= 20 GROUP BY o_custkey", over_tree=False)
def scoring_lmat(spark, sf):
    lines = _of_orders(spark, sf, "o_orderkey", "'ACGT'", "'0 0 0'", "'-1 -1'", "concat(o_custkey + 1, ' ', o_orderkey % 100, ' DirectMatch')")
    return _grouped_scores(classified.lmat(spark, _file(lines, "lmat", header=False)), "LMAT", 20)


@query("SELECT CAST(o_custkey + 1 AS VARCHAR) AS tid, count(*) AS n, round(avg(o_orderkey % 100), 6) AS score FROM orders WHERE o_orderkey % 100 >= 20 GROUP BY o_custkey", over_tree=False)
def scoring_generic(spark, sf):
    lines = _of_orders(spark, sf, "o_custkey + 1", "100", "o_orderkey % 100")
    form = classified.GenericFormat.parsed("TYP:tsv,TID:1,LEN:2,SCO:3,UNC:0")
    return _grouped_scores(classified.generic(spark, _file(lines, "generic"), form), "GENERIC", 20)


@query("SELECT o_orderkey AS read_id, o_orderpriority AS sample FROM orders WHERE o_orderstatus = 'P'", over_tree=False)
def unclassified_extract(spark, sf):
    """The reads that no node was found for."""
    return sequences.extracted(T.reads(spark, sf), T.nodes(spark, sf).select("tid"), 5, unclassified=True).select("read_id", "sample")


@query("SELECT doc_id AS record, CASE WHEN length(coalesce(text, '')) < 300 THEN 'short' WHEN length(coalesce(text, '')) > 4000 THEN 'long' ELSE 'pass' END AS class, t AS n FROM documents, (VALUES (1), (2)) v(t)", over_tree=False)
def length_filter_expanded(spark, sf):
    """Sequences by length, once for each of the titles that are joined in one."""
    title = "concat('>A', doc_id, ' one >B', doc_id, ' two')"
    rows = T.table(spark, sf, "documents").selectExpr("doc_id AS record", f"{title} AS title", "coalesce(text, '') AS seq")
    found = sequences.length_filtered(rows, 300, 4000, expand=True)
    return found.select(F.regexp_extract("title", r"(\d+)", 1).cast("long").alias("record"), "class", F.when(F.col("title").startswith(">A"), 1).otherwise(2).alias("n"))
