"""Queries over readers and loaders: orders as classifiers' files and the tree as taxonomy files, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ontology as O
from ..checkpoints import folder
from ..sources import classified, sequence_files
from . import driver_tables as T
from .catalog import query


def _file(df: DataFrame, name: str, sep: str = "\t", header: bool = True, inside: str = "") -> str:
    """The rows as text files of one folder, each with the header."""
    path = f"{folder(df.sparkSession, name)}{inside}"
    df.write.options(quote="", emptyValue="").csv(path, sep=sep, header=header)
    return path


def _lines(spark, sf, *columns: str) -> DataFrame:
    """Columns of text from orders: k is the order, c its customer (from 1), open whether it has no class, odd one in a hundred."""
    orders = T.table(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_custkey + 1 AS c", "o_orderstatus = 'P' AS open", "o_orderkey % 100 = 0 AS odd")
    return orders.select(*(F.expr(x).cast("string").alias(f"f{n}") for n, x in enumerate(columns)))


_ORDERS = "WITH o AS (SELECT o_orderkey AS k, o_custkey + 1 AS c, o_orderstatus = 'P' AS open, o_orderkey % 100 = 0 AS odd FROM orders)\n"


def _read_back(columns: str, unclassified: str, bad: str, **values: str) -> str:
    """SQL of a reader's rows: bad lines have no values, unclassified ones a length only."""
    found = [f"CASE WHEN NOT bad{'' if n == 'length' else ' AND NOT unclassified'} THEN {values[n]} END AS {n}" for n in columns.split()]
    return f"{_ORDERS}, m AS (SELECT *, {bad} AS bad, {unclassified} AND NOT {bad} AS unclassified FROM o) SELECT {', '.join(found)}, unclassified, bad FROM m"


@query(_read_back("tid length score", "open", "odd", tid="CAST(c AS VARCHAR)", length="100 + k % 50", score="sqrt(CAST(c % 997 AS DOUBLE)) + 15"), over_tree=False)
def centrifuge_reads(spark, sf):
    path = _file(_lines(spark, sf, "k", "'s'", "if(open, '0', string(c))", "if(odd, 'x', string(c % 997))", "0", "60", "100 + k % 50", "1"), "centrifuge")
    return classified.centrifuge(spark, path).select("tid", "length", "score", "unclassified", "bad")


@query(_read_back("tid length score share", "open", "(odd AND NOT open)", tid="CAST(c AS VARCHAR)", length="CASE WHEN k % 3 = 0 THEN 150 ELSE 100 + k % 50 END", score="CAST(k % 7 + 38 AS DOUBLE)", share="100.0 * (k % 7 + 3) / (k % 7 + k % 5 + 6)"), over_tree=False)
def kraken_reads(spark, sf):
    """Nodes as numbers or in names, mates' lengths, and k-mers of the node, of none and of ambiguous bases on both mates."""
    parts = "concat(c, ':', k % 7 + 1, ' 0:', k % 5, ' |:| ', c, ':2 A:3')"
    lines = _lines(spark, sf, "if(open, 'U', 'C')", "k", "if(k % 2 = 0, string(c), concat('x (taxid ', c, ')'))", "if(k % 3 = 0, '100|50', string(100 + k % 50))", f"if(odd, '', {parts})")
    return classified.kraken(spark, _file(lines, "kraken", header=False)).select("tid", "length", "score", "share", "unclassified", "bad")


@query(_read_back("tid length score conf gamma", "k % 8 = 0", "k % 100 = 1", tid="CAST(CASE WHEN k % 4 = 0 THEN c + 1 ELSE c END AS VARCHAR)", length="100 + k % 50", score="CAST(31 + CASE WHEN k % 4 = 0 THEN k % 20 ELSE k % 50 END AS DOUBLE)", conf="CASE WHEN k % 4 = 0 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END", gamma="0.5::DOUBLE"), over_tree=False)
def clark_reads(spark, sf):
    """The second assignment where the first is NA, neither for unclassified reads."""
    lines = _lines(spark, sf, "k", "if(k % 100 = 1, 'x', string(100 + k % 50))", "'0.5'", "if(k % 4 = 0, 'NA', string(c))", "k % 50", "if(k % 8 = 0, 'NA', string(c + 1))", "k % 20", "'0.75'")
    return classified.clark(spark, _file(lines, "clark", ",")).select("tid", "length", "score", "conf", "gamma", "unclassified", "bad")


@query(_read_back("tid length score", "k % 3 = 2", "odd", tid="CAST(c AS VARCHAR)", length="k % 30 + 1", score="CAST(c % 100 AS DOUBLE)"), over_tree=False)
def lmat_reads(spark, sf):
    lines = _lines(spark, sf, "k", "repeat('A', int(k % 30 + 1))", "'0 0 0'", "'-1 -1'", "concat(c, ' ', c % 100, ' ', case when odd then 'Odd' when k % 3 = 0 then 'DirectMatch' when k % 3 = 1 then 'MULTI' else 'NoDbHits' end)")
    return classified.lmat(spark, _file(lines, "lmat", header=False)).select("tid", "length", "score", "unclassified", "bad")


@query("""WITH o AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'DIRECTMATCH' WHEN 1 THEN 'MULTIMATCH' WHEN 2 THEN 'READTOOSHORT' ELSE 'LOWSCORE' END AS match FROM orders)
SELECT match, count(*) / CAST((SELECT count(*) FROM o) AS DOUBLE) AS share FROM o GROUP BY match""", over_tree=False)
def lmat_match_rates(spark, sf):
    lines = _lines(spark, sf, "k", "'ACGT'", "'0 0 0'", "'-1 -1'", "concat(c, ' 1 ', element_at(array('DIRECT', 'MultiMatch', 'ReadTooShort', 'LOWSCORE'), int(k % 4 + 1)))")
    found = classified.match_rates(spark, _file(lines.coalesce(1), "lmat", header=False))  # one file, as a sample is one
    return found.select("match", "share")


@query(_read_back("tid length score", "open", "odd", tid="CAST(c AS VARCHAR)", length="100 + k % 50", score="CAST(c % 100 AS DOUBLE)"), over_tree=False)
def generic_reads(spark, sf):
    lines = _lines(spark, sf, "if(open, '0', concat('\"', c, '\"'))", "c % 100", "if(odd, 'x', string(100 + k % 50))")
    return classified.generic(spark, _file(lines, "generic", ","), classified.GenericFormat.parsed("TYP:csv,TID:1,LEN:3,SCO:2,UNC:0")).select("tid", "length", "score", "unclassified", "bad")


@query(_read_back("tid length score", "false", "odd", tid="'GO:' || c", length="100 + k % 50", score="CASE WHEN k % 7 = 0 THEN 308.0::DOUBLE ELSE CAST(k % 200 AS DOUBLE) END"), over_tree=False)
def go_reads(spark, sf):
    lines = _lines(spark, sf, "k", "'x'", "concat('GO:', c)", "if(odd, 'x', string(100 + k % 50))", "if(k % 7 = 0, '0.0', concat('1e-', k % 200))")
    found = classified.go(spark, _file(lines, "go"))
    return found.select("tid", "length", F.round("score", 9).alias("score"), "unclassified", "bad")


@query("WITH o AS (SELECT CAST(o_custkey + 1 AS VARCHAR) AS tid, o_orderpriority LIKE '1%' AS is_control, sqrt(CAST(o_custkey % 997 AS DOUBLE)) + 15 AS score FROM orders) SELECT is_control, tid, count(*) AS n FROM o WHERE score >= CASE WHEN is_control THEN 40 ELSE 30 END GROUP BY ALL", over_tree=False)
def control_minscore(spark, sf):
    """Reads of a control and of other samples, each above its own least score."""
    rows = T.table(spark, sf, "orders").selectExpr("o_orderpriority LIKE '1%' AS is_control", "o_orderkey AS k", "o_custkey + 1 AS c")
    reads = None
    for control in (True, False):
        own = rows.filter(F.col("is_control") == control).selectExpr("k", "'s' AS s", "c", "(c - 1) % 997 AS score", "0 AS z", "60 AS h", "100 AS n", "1 AS m")
        found = classified.centrifuge(spark, _file(own, "control")).withColumn("sample", F.lit("control" if control else "plain"))
        reads = found if reads is None else reads.union(found)
    kept = classified.passing(reads, "SHEL", 30, 40, ["control"])
    return kept.groupBy((F.col("sample") == "control").alias("is_control"), "tid").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------------------------- sequence files


def _records(spark, sf) -> DataFrame:
    size = "int(o_orderkey % 5 + 1)"
    return T.table(spark, sf, "orders").selectExpr("o_orderkey AS record", "concat('r', o_orderkey, ' x') AS title", f"repeat('ACGT', {size}) AS seq", f"repeat('IIII', {size}) AS qual")


@query("SELECT 'r' || o_orderkey || ' x' AS title, repeat('ACGT', CAST(o_orderkey % 5 + 1 AS INTEGER)) AS seq, repeat('IIII', CAST(o_orderkey % 5 + 1 AS INTEGER)) AS qual FROM orders", over_tree=False)
def fastq_round_trip(spark, sf):
    path = folder(spark, "fastq")
    sequence_files.write_fastq(_records(spark, sf), path, "gzip")
    return sequence_files.fastq(spark, path).select("title", "seq", "qual")


@query("SELECT 'r' || o_orderkey || ' x' AS title, repeat('ACGT', CAST(o_orderkey % 5 + 1 AS INTEGER)) AS seq FROM orders", over_tree=False)
def fasta_round_trip(spark, sf):
    path = folder(spark, "fasta")
    sequence_files.write_fasta(_records(spark, sf), path)
    return sequence_files.fasta(spark, path).select("title", "seq")


@query("SELECT 'A' || o_orderkey AS accession, 'C' || o_custkey AS tid FROM orders", over_tree=False)
def accession_map(spark, sf):
    rows = T.table(spark, sf, "orders").selectExpr("concat('A', o_orderkey) AS a", "concat('C', o_custkey) AS t")
    return sequence_files.accessions(spark, _file(rows, "accessions", " ", header=False))


@query("SELECT 'C' || o_custkey AS tid, count(*) AS n FROM orders GROUP BY o_custkey", over_tree=False)
def mock_layout(spark, sf):
    """Reads a node, as lines of a layout with comments."""
    rows = T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).selectExpr("concat('C', o_custkey) AS t", "n", "'# reads' AS note")
    return sequence_files.layout(spark, _file(rows, "layout", "\t", header=False))


# --------------------------------------------------------------------------------------------------- ontologies


def _dump_lines(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.concat_ws("\t|\t", *df.columns), F.lit("\t|")).alias("value")).write.text(path)


@query("SELECT tid, parent, CASE rank WHEN 'ROOT' THEN 'NO_RANK' ELSE rank END AS rank, name FROM tree")
def ncbi_nodes(spark, sf):
    path, nodes = folder(spark, "taxonomy"), T.nodes(spark, sf)
    _dump_lines(nodes.select("tid", "parent", F.when(F.col("rank") == "ROOT", "no rank").otherwise(F.lower("rank")).alias("rank"), F.lit("XX").alias("code")), f"{path}/nodes.dmp")
    known = nodes.select("tid", "name", F.lit("").alias("unique"), F.lit("scientific name").alias("kind"))
    _dump_lines(known.union(nodes.select("tid", F.concat(F.lit("other "), "name"), F.lit(""), F.lit("synonym"))), f"{path}/names.dmp")
    return O.load_ncbi(spark, path).nodes.select("tid", "parent", "rank", "name")


@query("SELECT tid, count(*) AS n_ancestors, CAST(sum(dist) AS BIGINT) AS all_dist FROM paths GROUP BY tid")
def doubled_closure(spark, sf):
    """The ancestor closure by path doubling, with the depth unknown."""
    return O.closure(T.nodes(spark, sf)).groupBy("tid").agg(F.count("*").alias("n_ancestors"), F.sum("dist").alias("all_dist"))


_TOPS = ", ".join(f"('{x}')" for x in O.GO_TOP)


@query(f"""WITH t(tid) AS (VALUES {_TOPS}),
g AS (SELECT 'GO:ROOT' AS tid, 'GO:ROOT' AS parent, NULL AS name UNION ALL SELECT tid, 'GO:ROOT', NULL FROM t
 UNION ALL SELECT 'GO:N' || n_nationkey, 'GO:0003674', 'n' || n_nationkey FROM nation UNION ALL SELECT 'GO:C' || c_custkey, 'GO:N' || c_nationkey, 'c' || c_custkey FROM customer)
SELECT tid, parent, name FROM g""", over_tree=False)
def go_nodes(spark, sf):
    """Terms of a gene ontology; a term's last parent counts."""
    path = folder(spark, "terms")
    nations = T.table(spark, sf, "nation").selectExpr("concat('GO:N', n_nationkey) AS tid", "'GO:0003674' AS parent", "concat('n', n_nationkey) AS name")
    nodes = nations.union(T.table(spark, sf, "customer").selectExpr("concat('GO:C', c_custkey)", "concat('GO:N', c_nationkey)", "concat('c', c_custkey)"))
    # One file each: the format has one header and its lines an order.
    twice = nodes.select("tid", F.lit("GO:0008150").alias("parent"), F.lit(0).alias("n")).union(nodes.select("tid", "parent", F.lit(1)))
    twice.coalesce(1).sortWithinPartitions("n").drop("n").write.csv(f"{path}/nodes.dmp", sep="\t", header=True)
    nodes.select("tid", F.lit("x").alias("activity"), "name").coalesce(1).write.csv(f"{path}/names.dmp", sep="\t", header=True)
    return O.load_go(spark, path).nodes.select("tid", "parent", "name")
