"""Queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import written
from .. import ontology as O
from ..functions.ranks import RANK_VALUES
from ..functions.scores import auto_mintaxa, group_score, length_text
from ..operators import counters, cross, sequences, stats, summary, tree, views
from ..sources import sinks
from . import driver_tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LEAST = 3
SPECIES, GENUS, FAMILY = (RANK_VALUES[x] for x in ("SPECIES", "GENUS", "FAMILY"))
#: Limits of the decision list that suit 25 nations, whose shares lie around 4 %.
SEVERE, MILD = 0.044, 0.039

_TREE = """
WITH tree AS (
  SELECT '1' AS tid, '1' AS parent, 'ROOT' AS rank, 'root' AS name
  UNION ALL SELECT 'R' || r_regionkey, '1', 'FAMILY', r_name FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'GENUS', n_name FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'SPECIES', c_name FROM customer),
up AS (SELECT tid, parent FROM tree WHERE tid <> '1'),
paths AS (
  SELECT tid, tid AS anc, 0 AS dist FROM tree
  UNION ALL SELECT tid, parent, 1 FROM up
  UNION ALL SELECT a.tid, b.parent, 2 FROM up a JOIN up b ON a.parent = b.tid
  UNION ALL SELECT a.tid, c.parent, 3 FROM up a JOIN up b ON a.parent = b.tid JOIN up c ON b.parent = c.tid),
reads AS (
  SELECT o_orderpriority AS sample, o_orderkey AS read_id, 'C' || o_custkey AS tid,
         CAST(round(o_totalprice * 100) AS BIGINT) AS score, o_orderstatus = 'P' AS unclassified, o_orderkey % 100 = 0 AS bad
  FROM orders),
counts AS (
  SELECT sample, tid, count(*) AS count, CAST(sum(score) AS BIGINT) AS total FROM reads GROUP BY sample, tid),
acc AS (
  SELECT sample, anc AS tid, CAST(sum(count) AS BIGINT) AS acc, CAST(sum(total) AS BIGINT) AS total
  FROM counts JOIN paths USING (tid) GROUP BY sample, anc),
anchor AS (
  SELECT sample, p.anc AS tid, t.rank, CAST(sum(count) AS BIGINT) AS count, CAST(sum(total) AS BIGINT) AS total
  FROM counts JOIN paths p USING (tid) JOIN tree t ON t.tid = p.anc WHERE t.rank <> 'ROOT' GROUP BY sample, p.anc, t.rank),
samples AS (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS ord FROM (SELECT DISTINCT sample FROM reads)),
whole AS (SELECT sample, acc AS all_reads FROM acc WHERE tid = '1')"""


def query(sql: str | None = None, over_tree: bool = True):
    """Registers a query by its function's name, with its SQL; `over_tree` puts the common tables in front."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = f"{_TREE}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().removeprefix('+')}" if over_tree else sql
        return function

    return register


# ------------------------------------------------------------------------------------------------ roll-ups


@query("SELECT sample, tid, acc, CAST(total AS DOUBLE) / acc AS score FROM acc")
def rollup_acc(spark, sf):
    return tree.with_scores(tree.accumulated(T.counts(spark, sf), T.ontology(spark, sf))).select("sample", "tid", "acc", "score")


_FOLDED = """+kept AS (SELECT * FROM acc WHERE acc >= 3 OR tid = '1'),
below AS (SELECT sample, parent AS tid, sum(acc) AS b FROM kept JOIN up USING (tid) GROUP BY sample, parent),
fact AS (SELECT k.sample, k.tid, k.acc, CAST(k.acc - coalesce(b, 0) AS BIGINT) AS count, k.total FROM kept k LEFT JOIN below USING (sample, tid))
"""


def _fact(spark, sf, **options):
    return tree.rollup(T.counts(spark, sf), T.ontology(spark, sf, **options), LEAST)


@query(_FOLDED + "SELECT sample, tid, acc, count, CAST(total AS DOUBLE) / acc AS score FROM fact")
def fold_mintaxa(spark, sf):
    return tree.with_scores(_fact(spark, sf)).select("sample", "tid", "acc", "count", "score")


@query("SELECT sample, anc AS tid, CAST(sum(count) AS BIGINT) AS acc FROM counts JOIN paths p USING (tid) WHERE tid IN (SELECT tid FROM paths WHERE anc IN ('R1', 'N3')) GROUP BY sample, anc")
def include_subtree(spark, sf):
    tops = T.ontology(spark, sf, include=("R1", "N3"))
    return tree.accumulated(tree.selected(T.counts(spark, sf), tops), tops).select("sample", "tid", "acc")


@query("SELECT sample, anc AS tid, CAST(sum(count) AS BIGINT) AS acc FROM counts JOIN paths p USING (tid) WHERE tid NOT IN (SELECT tid FROM paths WHERE anc IN ('R2', 'N5', 'C7')) GROUP BY sample, anc")
def exclude_subtree(spark, sf):
    tops = T.ontology(spark, sf, exclude=("R2", "N5", "C7"))
    return tree.accumulated(tree.selected(T.counts(spark, sf), tops), tops).select("sample", "tid", "acc")


@query("SELECT p.tid, count(*) AS depth_nodes, string_agg(t.rank || ':' || anc || ':' || t.name, '>' ORDER BY dist DESC) AS path FROM paths p JOIN tree t ON t.tid = p.anc GROUP BY p.tid")
def lineage_path(spark, sf):
    steps = O.lineage(T.ontology(spark, sf))
    path = F.array_join(F.transform("lineage", lambda s: F.concat_ws(":", s["rank"], s["tid"], s["name"])), ">")
    return steps.select("tid", F.size("lineage").cast("long").alias("depth_nodes"), path.alias("path"))


@query("SELECT tid, count(*) AS n_ancestors, CAST(sum(dist) AS BIGINT) AS all_dist FROM paths GROUP BY tid")
def ancestor_closure(spark, sf):
    return T.ontology(spark, sf).closure().groupBy("tid").agg(F.count("*").alias("n_ancestors"), F.sum("dist").alias("all_dist"))


# -------------------------------------------------------------------------------------- reads and statistics

_LENGTHS = """+lengths AS (SELECT l_orderkey AS read_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS length FROM lineitem GROUP BY l_orderkey),
long AS (SELECT r.*, coalesce(length, 1) AS length FROM reads r LEFT JOIN lengths USING (read_id))
"""


@query(_LENGTHS + """, marked AS (SELECT *, NOT bad AND NOT unclassified AS passes, NOT bad AND NOT unclassified AND score >= 5000000 AS kept FROM long)
SELECT sample, count(*) FILTER (NOT bad) AS seqs_read, count(*) FILTER (NOT bad AND unclassified) AS seqs_unclassified,
       count(*) FILTER (passes) AS seqs_classified, count(*) FILTER (kept) AS seqs_filtered, count(*) FILTER (bad) AS seqs_bad,
       count(DISTINCT tid) FILTER (passes) AS ids_classified, count(DISTINCT tid) FILTER (kept) AS ids_filtered,
       CAST(coalesce(sum(length) FILTER (NOT bad), 0) AS BIGINT) AS nt_read, min(length) FILTER (kept) AS length_min,
       CAST(floor(avg(length) FILTER (kept)) AS BIGINT) AS length_mean, max(length) FILTER (kept) AS length_max,
       min(score) FILTER (kept) AS score_min, avg(score) FILTER (kept) AS score_mean, max(score) FILTER (kept) AS score_max,
       count(*) FILTER (NOT bad AND unclassified) / count(*) FILTER (NOT bad) AS unclassified_ratio,
       (count(*) FILTER (passes) - count(*) FILTER (kept)) / count(*) FILTER (passes) AS reject_ratio,
       CAST(round_even(log10(count(*) FILTER (kept)), 0) AS INTEGER) AS mintaxa
FROM marked GROUP BY sample""")
def sample_stats(spark, sf):
    return stats.sample_stats(T.reads(spark, sf, lengths=True), 5_000_000).drop("nt_text")


def _scored(scoring: str):
    def run(spark, sf):
        rows = T.reads(spark, sf, lengths=True).filter("not bad and not unclassified")
        return rows.groupBy("sample", "tid").agg(F.round(group_score(scoring, F.col("score"), F.col("length")), 3).alias("score"))

    run.__name__ = f"scoring_{scoring.lower()}"
    return run


for _name, _sql in (("SHEL", "avg(score)"), ("LENGTH", "avg(length)"), ("LOGLENGTH", "log10(avg(length))"), ("NORMA", "100.0 * avg(score) / avg(length)")):
    query(_LENGTHS + f"SELECT sample, tid, round({_sql}, 3) AS score FROM long WHERE NOT bad AND NOT unclassified GROUP BY sample, tid")(_scored(_name))


@query("SELECT sample, tid, count(*) AS count FROM reads WHERE NOT bad AND NOT unclassified AND score >= 10000000 GROUP BY sample, tid")
def minscore_filter(spark, sf):
    kept = T.reads(spark, sf).filter("not bad and not unclassified").filter(F.col("score") >= 10_000_000)
    return kept.groupBy("sample", "tid").agg(F.count("*").alias("count"))


@query("SELECT sample, acc AS filtered, CAST(round_even(log10(acc), 0) AS INTEGER) AS mintaxa FROM acc WHERE tid = '1'")
def automatic_mintaxa(spark, sf):
    return T.counts(spark, sf).groupBy("sample").agg(F.sum("count").alias("filtered")).withColumn("mintaxa", auto_mintaxa(F.col("filtered")))


@query("""SELECT sample, CASE WHEN sum(score) > 1e12 THEN printf('%.2f Tnt', sum(score) / 1e12) WHEN sum(score) > 1e9 THEN printf('%.2f Gnt', sum(score) / 1e9)
 WHEN sum(score) > 1e6 THEN printf('%.2f Mnt', sum(score) / 1e6) WHEN sum(score) > 1e3 THEN printf('%.2f knt', sum(score) / 1e3) ELSE sum(score) || ' nt' END AS nt_text FROM reads GROUP BY sample""")
def si_lengths(spark, sf):
    return T.reads(spark, sf).groupBy("sample").agg(F.sum("score").alias("nt")).select("sample", length_text(F.col("nt")).alias("nt_text"))


_HALF = "+half AS (SELECT * FROM tree WHERE tid <> 'N4' AND tid <> 'R3'), rooted AS (SELECT p.tid FROM paths p WHERE NOT EXISTS (SELECT 1 FROM paths q WHERE q.tid = p.tid AND q.anc IN ('N4', 'R3')) GROUP BY p.tid)\n"


def _cut(spark, sf):
    whole = T.ontology(spark, sf)
    return O.Ontology(whole.nodes.filter(~F.col("tid").isin("N4", "R3")), depth=T.DEPTH)


@query(_HALF + "SELECT sample, count(*) AS orphan_ids, CAST(sum(count) AS BIGINT) AS orphan_reads FROM counts WHERE tid NOT IN (SELECT tid FROM rooted) GROUP BY sample")
def orphan_stats(spark, sf):
    return stats.orphan_stats(T.counts(spark, sf), _cut(spark, sf))


@query(_HALF + "SELECT sample, CAST(sum(CASE WHEN tid IN (SELECT tid FROM rooted) THEN 0 ELSE count END) AS BIGINT) AS lost FROM counts GROUP BY sample")
def lost_reads(spark, sf):
    cut, counts = _cut(spark, sf), T.counts(spark, sf)
    return stats.lost_reads(counts, tree.accumulated(counts, cut), O.ROOT)


@query("SELECT sample, tid, acc FROM acc WHERE acc < 3 AND tid <> '1'")
def fold_report(spark, sf):
    acc = tree.accumulated(T.counts(spark, sf), T.ontology(spark, sf))
    return stats.fold_report(acc, tree.folded(acc, T.ontology(spark, sf), LEAST))


@query("SELECT rank, count(*) AS n_ids FROM tree WHERE tid IN (SELECT tid FROM acc) GROUP BY rank")
def ids_per_rank(spark, sf):
    used = tree.accumulated(T.counts(spark, sf), T.ontology(spark, sf)).select("tid").distinct()
    return stats.ids_per_rank(used, T.ontology(spark, sf))


@query(_FOLDED + "SELECT min(CAST(total AS DOUBLE) / acc) AS score_min, max(CAST(total AS DOUBLE) / acc) AS score_max FROM fact WHERE count > 0")
def score_extent(spark, sf):
    return stats.score_extent(tree.with_scores(_fact(spark, sf)))


# --------------------------------------------------------------------------------------------- cross analysis

_AT = """+own AS (SELECT * FROM anchor WHERE rank = '{rank}' AND count >= 3),
t AS (SELECT sample, anc AS tid, CAST(sum(count) AS BIGINT) AS acc, CAST(sum(total) AS BIGINT) AS total FROM own JOIN paths USING (tid) GROUP BY sample, anc)
SELECT t.sample, t.tid, t.acc, coalesce(own.count, 0) AS count, CAST(t.total AS DOUBLE) / t.acc AS score FROM t LEFT JOIN own USING (sample, tid)"""


def _at_rank(name: str, value: int):
    def run(spark, sf):
        return tree.with_scores(tree.at_rank(T.counts(spark, sf), T.ontology(spark, sf), value, LEAST)).select("sample", "tid", "acc", "count", "score")

    run.__name__ = f"at_rank_{name.lower()}"
    return run


for _name, _value in (("SPECIES", SPECIES), ("GENUS", GENUS), ("FAMILY", FAMILY)):
    query(_AT.format(rank=_name))(_at_rank(_name, _value))

_PRESENT = _FOLDED + ", present AS (SELECT sample, f.tid FROM fact f JOIN tree t ON t.tid = f.tid WHERE t.rank = 'SPECIES' AND acc > 0)\n"
_PRESENT_N = "+present AS (SELECT sample, a.tid FROM acc a JOIN tree t ON t.tid = a.tid WHERE t.rank = 'GENUS' AND acc >= 3)\n"


@query(_PRESENT + "SELECT sample, tid FROM present")
def presence(spark, sf):
    return cross.presence(_fact(spark, sf), T.ontology(spark, sf), SPECIES)


def _study(spark, sf):
    """What a comparison of samples starts from, each made once: counts, the samples' trees, the samples, the ontology."""
    tops, counts = T.ontology(spark, sf), written(T.counts(spark, sf), "counts")
    return counts, written(tree.rollup(counts, tops, LEAST), "trees"), T.samples(spark, sf, LEAST), tops


def _setting(spark, sf, value: int):
    counts, fact, samples, tops = _study(spark, sf)
    return counts, cross.presence(fact, tops, value), samples, tops


_TREE_OF = """, t AS (SELECT sample, anc AS tid, CAST(sum(count) AS BIGINT) AS acc, CAST(sum(total) AS BIGINT) AS total FROM own JOIN paths USING (tid) GROUP BY sample, anc)
SELECT t.sample, t.tid, t.acc, coalesce(own.count, 0) AS count, CAST(t.total AS DOUBLE) / t.acc AS score FROM t LEFT JOIN own USING (sample, tid)"""


def _shown(fact: DataFrame) -> DataFrame:
    return tree.with_scores(fact).select("sample", "tid", "acc", "count", "score")


@query(_PRESENT + ", own AS (SELECT sample, tid, count, total FROM anchor a WHERE rank = 'SPECIES' AND count >= 3 AND NOT EXISTS (SELECT 1 FROM present p WHERE p.tid = a.tid AND p.sample <> a.sample))" + _TREE_OF)
def exclusive(spark, sf):
    return _shown(cross.exclusive(*_setting(spark, sf, SPECIES), SPECIES))


_SHARED = """, common AS (SELECT tid, CAST(sum(count) // {n} AS BIGINT) AS count FROM own GROUP BY tid HAVING count(*) = {n}),
sums AS (SELECT anc AS tid, CAST(sum(count) AS BIGINT) AS acc FROM common JOIN paths USING (tid) GROUP BY anc),
big AS (SELECT * FROM sums WHERE (acc >= 3 OR tid = '1') AND acc > 0),
b AS (SELECT parent AS tid, sum(acc) AS b FROM big JOIN up USING (tid) GROUP BY parent)
SELECT big.tid, acc, CAST(acc - coalesce(b, 0) AS BIGINT) AS count FROM big LEFT JOIN b USING (tid)"""


@query("+own AS (SELECT * FROM anchor WHERE rank = 'SPECIES' AND count >= 3)" + _SHARED.replace("{n}", "(SELECT count(*) FROM samples)"))
def shared(spark, sf):
    return cross.shared_by_all(T.counts(spark, sf), T.samples(spark, sf, LEAST), T.ontology(spark, sf), SPECIES).select("tid", "acc", "count")


@query(_PRESENT + ", own AS (SELECT sample, tid, count, total FROM anchor WHERE rank = 'SPECIES' AND count >= 3 AND sample <> (SELECT min(sample) FROM samples) AND tid NOT IN (SELECT tid FROM present WHERE sample = (SELECT min(sample) FROM samples)))" + _TREE_OF)
def strict_control(spark, sf):
    return _shown(cross.strict_control(*_setting(spark, sf, SPECIES), SPECIES))


_FREQ = _PRESENT_N + """, candidates AS (SELECT DISTINCT tid FROM present WHERE sample = (SELECT min(sample) FROM samples)),
freq AS (SELECT c.tid, s.sample, s.ord, s.ord = 0 AS is_ctrl, coalesce(CAST(a.acc AS DOUBLE) / w.all_reads, 0.0) AS freq
  FROM candidates c CROSS JOIN samples s JOIN whole w USING (sample) LEFT JOIN acc a ON a.sample = s.sample AND a.tid = c.tid)
"""


def _freq(spark, sf, study=None):
    _, fact, samples, tops = study or _study(spark, sf)
    return cross.frequencies(fact, cross.presence(fact, tops, GENUS), samples, O.ROOT)


@query(_FREQ + "SELECT tid, sample, is_ctrl, freq FROM freq")
def relative_frequency(spark, sf):
    return _freq(spark, sf).select("tid", "sample", "is_ctrl", "freq")


_QN = """, n AS (SELECT tid, count(*) AS n, median(freq) AS med FROM freq GROUP BY tid),
pairs AS (SELECT a.tid, abs(a.freq - b.freq) AS d FROM freq a JOIN freq b ON a.tid = b.tid AND a.ord < b.ord),
ranked AS (SELECT tid, d, row_number() OVER (PARTITION BY tid ORDER BY d) AS k FROM pairs),
scale AS (SELECT r.tid, 3.4760 * d AS qn, med FROM ranked r JOIN n USING (tid) WHERE k = greatest(1, CAST(floor(n * (n / 2.0 + 1) / 4) AS INTEGER)))
"""


@query(_FREQ + _QN + "SELECT tid, med AS median, qn FROM scale")
def qn_scale(spark, sf):
    lists = _freq(spark, sf).groupBy("tid").agg(F.collect_list("freq").alias("f"))
    return lists.select("tid", cross.median(F.col("f")).alias("median"), cross.qn_scale(F.col("f")).alias("qn"))


_LABELS = _FREQ + _QN + f""", labels AS (SELECT f.tid, CASE WHEN max(freq) FILTER (NOT is_ctrl) < 1e-14 THEN 'just-ctrl'
   WHEN min(freq) FILTER (is_ctrl) > {SEVERE} THEN 'critical' WHEN max(freq) FILTER (is_ctrl) > {SEVERE} THEN 'severe' WHEN min(freq) FILTER (is_ctrl) > {MILD} THEN 'mild'
   WHEN count(*) FILTER (NOT is_ctrl AND freq > med + 5 * qn AND freq > 1000 * (SELECT max(freq) FROM freq g WHERE g.tid = f.tid AND g.is_ctrl)) > 0 THEN 'crossover'
   ELSE 'other' END AS label FROM freq f JOIN scale USING (tid) GROUP BY f.tid)
"""


def _labels(spark, sf, study=None):
    return cross.contaminants(_freq(spark, sf, study), severe=SEVERE, mild=MILD)


@query(_LABELS + "SELECT tid, label FROM labels")
def contaminant_label(spark, sf):
    return _labels(spark, sf).select("tid", "label")


#: Nodes that only some labels bar, so that something is left.
_SOME = "SELECT tid FROM labels WHERE label IN ('critical', 'severe', 'mild')"


@query(_LABELS + f", own AS (SELECT sample, tid, count, total FROM anchor WHERE rank = 'GENUS' AND count >= 3 AND sample <> (SELECT min(sample) FROM samples) AND tid NOT IN ({_SOME}))" + _TREE_OF)
def ctrl_sample(spark, sf):
    counts, _, samples, tops = study = _study(spark, sf)
    some = written(_labels(spark, sf, study).filter("label != 'other'"), "labels")
    return _shown(cross.control_subtracted(counts, some, samples, tops, GENUS))


@query(_LABELS + f", own AS (SELECT * FROM anchor WHERE rank = 'GENUS' AND count >= 3 AND sample <> (SELECT min(sample) FROM samples) AND tid NOT IN ({_SOME}))" + _SHARED.replace("{n}", "(SELECT count(*) - 1 FROM samples)"))
def control_shared(spark, sf):
    counts, _, samples, tops = study = _study(spark, sf)
    some = written(_labels(spark, sf, study).filter("label != 'other'"), "labels")
    return cross.control_shared(counts, some, samples, tops, GENUS).select("tid", "acc", "count")


@query("""+c AS (SELECT sample, tid, count FROM anchor WHERE count >= 3),
s AS (SELECT sample, tid, count AS rest, count AS passed FROM c WHERE tid LIKE 'C%'),
nb AS (SELECT sample, parent AS tid, sum(passed) AS b FROM s JOIN up USING (tid) GROUP BY sample, parent),
n AS (SELECT x.sample, x.tid, CASE WHEN x.count >= coalesce(b, 0) THEN x.count - coalesce(b, 0) ELSE x.count END AS rest,
        CASE WHEN x.count >= coalesce(b, 0) THEN x.count ELSE x.count + b END AS passed FROM c x LEFT JOIN nb USING (sample, tid) WHERE x.tid LIKE 'N%'),
rb AS (SELECT sample, parent AS tid, sum(passed) AS b FROM n JOIN up USING (tid) GROUP BY sample, parent),
r AS (SELECT x.sample, x.tid, CASE WHEN x.count >= coalesce(b, 0) THEN x.count - coalesce(b, 0) ELSE x.count END AS rest FROM c x LEFT JOIN rb USING (sample, tid) WHERE x.tid LIKE 'R%'),
own AS (SELECT sample, tid, rest FROM s UNION ALL SELECT sample, tid, rest FROM n UNION ALL SELECT sample, tid, rest FROM r),
t AS (SELECT sample, anc AS tid, CAST(sum(rest) AS BIGINT) AS acc FROM own JOIN paths USING (tid) GROUP BY sample, anc HAVING sum(rest) > 0)
SELECT t.sample, t.tid, acc, CAST(coalesce(rest, 0) AS BIGINT) AS count FROM t LEFT JOIN own USING (sample, tid)""")
def summary_counts(spark, sf):
    tops, counts = T.ontology(spark, sf), T.counts(spark, sf)
    parts = None
    for rank, value in (("SPECIES", SPECIES), ("GENUS", GENUS), ("FAMILY", FAMILY)):
        own = tree.with_scores(tree.at_rank(counts, tops, value, LEAST)).filter("count > 0")
        own = own.select(F.lit("PART").alias("kind"), F.lit(rank).alias("rank"), F.col("sample").alias("raw_sample"), "tid", "count", "score")
        parts = own if parts is None else parts.union(own)
    found = summary.summarised(parts, tops, ["SPECIES", "GENUS", "FAMILY"])
    return found.select(F.col("raw_sample").alias("sample"), "tid", "acc", "count")


# ------------------------------------------------------------------------------------------ counter algebra


def _counter(spark, sf, sample: str):
    return T.counts(spark, sf).filter(F.col("sample") == sample).select("tid", F.col("count").alias("value"))


_AB = "+a AS (SELECT tid, count AS value FROM counts WHERE sample = '1-URGENT'), b AS (SELECT tid, count AS value FROM counts WHERE sample = '2-HIGH')\n"


def _algebra(name: str, sql: str, work):
    def run(spark, sf):
        return work(_counter(spark, sf, "1-URGENT"), _counter(spark, sf, "2-HIGH"))

    run.__name__ = f"counter_{name}"
    query(_AB + sql)(run)


_algebra("common_sum", "SELECT tid, a.value + b.value AS value FROM a JOIN b USING (tid)", counters.common_sum)
_algebra("product", "SELECT tid, a.value * b.value AS value FROM a JOIN b USING (tid)", counters.product)
_algebra("ratio", "SELECT tid, CAST(a.value AS DOUBLE) / b.value AS value FROM a JOIN b USING (tid)", counters.ratio)
_algebra("floor_divided", "SELECT tid, value // 3 AS value FROM a", lambda a, b: counters.floor_divided(a, 3))
_algebra("added", "SELECT tid, CAST(sum(value) AS BIGINT) AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY tid HAVING sum(value) > 0", counters.added)
_algebra("increased", "SELECT a.tid, a.value + coalesce(b.value, 0) AS value FROM a LEFT JOIN b USING (tid)", counters.increased)


# ------------------------------------------------------------------------------------------ tables and views


@query("""+pivoted AS (SELECT tid, {0} FROM acc GROUP BY tid)
SELECT p.*, t.rank, t.name FROM pivoted p JOIN tree t USING (tid)""".format(", ".join(f"max(acc) FILTER (sample = '{s}') AS \"{s}_cnt\"" for s in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))))
def wide_table(spark, sf):
    fact = tree.with_scores(tree.folded(tree.accumulated(T.counts(spark, sf), T.ontology(spark, sf)), T.ontology(spark, sf), 1))
    wide = sinks.wide(fact, T.ontology(spark, sf), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    return wide.select("tid", *(c for c in wide.columns if c.endswith("_cnt")), "rank", "name")


@query(_FOLDED + "SELECT t.rank AS sheet_rank, t.name AS sheet_name, sample, count FROM fact JOIN tree t USING (tid) WHERE count > 0")
def multi_sheet_counts(spark, sf):
    return sinks.sheets(_fact(spark, sf), T.ontology(spark, sf))


@query(_FOLDED + "SELECT sample, anc AS tid, count(*) AS hits FROM fact f JOIN tree t USING (tid) JOIN paths p USING (tid) WHERE t.name ILIKE '%nation_1%' OR t.name ILIKE '%#00000001%' GROUP BY sample, anc")
def search_subtree(spark, sf):
    tops, fact = T.ontology(spark, sf), _fact(spark, sf)
    low = F.lower("name")
    hits = tops.names.filter(low.like("%nation_1%") | low.contains("#00000001")).select("tid")
    return views.subtree_hits(fact, tops, hits)


@query(_FOLDED + """SELECT f.sample, u.parent, f.tid, f.acc, CAST(row_number() OVER w AS INTEGER) AS place, CAST(sum(f.acc) OVER w - f.acc AS BIGINT) AS before, CAST(f.acc AS DOUBLE) / g.acc AS share
FROM fact f JOIN up u USING (tid) JOIN fact g ON g.sample = f.sample AND g.tid = u.parent
WINDOW w AS (PARTITION BY f.sample, u.parent ORDER BY f.acc DESC, f.tid ROWS UNBOUNDED PRECEDING)""")
def sibling_share(spark, sf):
    return views.sibling_shares(_fact(spark, sf), T.ontology(spark, sf))


@query(_FOLDED + """SELECT sample, parent, tid, CAST(row_number() OVER (PARTITION BY sample, parent ORDER BY CAST(total AS DOUBLE) / acc DESC NULLS LAST, tid) AS INTEGER) AS place FROM fact JOIN up USING (tid)""")
def children_by_score(spark, sf):
    return views.children_by_score(tree.with_scores(_fact(spark, sf)), T.ontology(spark, sf)).drop("score")


@query("SELECT a.sample, u.parent, a.tid FROM acc a JOIN up u USING (tid) JOIN acc b ON b.sample = a.sample AND b.tid = u.parent WHERE a.acc = b.acc")
def collapse_chain(spark, sf):
    return views.chains(tree.accumulated(T.counts(spark, sf), T.ontology(spark, sf)), T.ontology(spark, sf))


@query(_FOLDED + "SELECT sample, tid, acc FROM fact f WHERE acc > 0 AND NOT EXISTS (SELECT 1 FROM fact g JOIN up u ON u.tid = g.tid WHERE g.sample = f.sample AND u.parent = f.tid AND g.acc > 0)")
def real_leaves(spark, sf):
    return views.leaves(_fact(spark, sf), T.ontology(spark, sf))


@query("SELECT sample, a.tid, acc FROM acc a JOIN paths p ON p.tid = a.tid WHERE p.anc = 'R2'")
def subtree_members(spark, sf):
    acc = tree.accumulated(T.counts(spark, sf), T.ontology(spark, sf))
    return views.members(acc, T.ontology(spark, sf), "R2").select("sample", "tid", "acc")


# ------------------------------------------------------------------------------------------------- sequences

_PICKED = "+picked AS (SELECT tid FROM tree WHERE tid IN (SELECT tid FROM paths WHERE anc = 'R1') AND tid NOT IN (SELECT tid FROM paths WHERE anc = 'N1'))\n"


@query(_PICKED + "SELECT tid FROM picked")
def select_ids(spark, sf):
    return tree.selected_ids(T.ontology(spark, sf), ["R1"], ["N1"])


@query(_PICKED + "SELECT read_id, sample, tid, score FROM reads WHERE NOT unclassified AND tid IN (SELECT tid FROM picked) AND score >= 2000000")
def semi_extract(spark, sf):
    ids = tree.selected_ids(T.ontology(spark, sf), ["R1"], ["N1"])
    return sequences.extracted(T.reads(spark, sf), ids, 2_000_000).select("read_id", "sample", "tid", "score")


@query("SELECT tid, read_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY read_id) AS place FROM reads) WHERE place <= 3")
def first_n_per_key(spark, sf):
    return sequences.first_per_key(T.reads(spark, sf), "tid", ["read_id"], 3).select("tid", "read_id", "place")


def _records(spark, sf):
    return T.table(spark, sf, "documents").select(F.col("doc_id").alias("record"), F.concat(F.lit("seq"), F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("source", F.lit(""))).alias("title"), F.coalesce("text", F.lit("")).alias("seq"))


@query("SELECT doc_id AS record, CASE WHEN length(coalesce(text, '')) < 300 THEN 'short' WHEN length(coalesce(text, '')) > 4000 THEN 'long' ELSE 'pass' END AS class FROM documents", over_tree=False)
def length_filter(spark, sf):
    return _records(spark, sf).select("record", sequences.length_class(F.length("seq"), 300, 4000).alias("class"))


@query("SELECT count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS nt, CAST(min(length(coalesce(text, ''))) AS INTEGER) AS length_min, avg(length(coalesce(text, ''))) AS length_mean, CAST(max(length(coalesce(text, ''))) AS INTEGER) AS length_max FROM documents", over_tree=False)
def length_stats(spark, sf):
    return sequences.length_stats(_records(spark, sf).select(F.length("seq").alias("length")))


@query("""WITH l AS (SELECT length(text) AS length FROM documents WHERE length(text) > 0), e AS (SELECT log10(min(length)) AS lo, log10(max(length)) AS hi FROM l)
SELECT CAST(least(99, floor((log10(length) - lo) / ((hi - lo) / 100))) AS INTEGER) AS bin, count(*) AS n FROM l, e GROUP BY 1""", over_tree=False)
def length_histogram(spark, sf):
    return sequences.length_histogram(_records(spark, sf).select(F.length("seq").alias("length")))


_TITLE = "'>A' || doc_id || '.1 ' || coalesce(source, '') || ' protein >B' || doc_id || ' other > loose >C_' || (doc_id % 5) || ' last'"


@query(f"SELECT doc_id AS record, unnest(regexp_extract_all(t, '>[A-Za-z0-9_.]+ (?:[^>]|> )*')) AS header FROM (SELECT doc_id, {_TITLE} AS t FROM documents)", over_tree=False)
def header_expand(spark, sf):
    rows = T.table(spark, sf, "documents").select(F.col("doc_id").alias("record"), F.expr(_TITLE).alias("title"))
    return rows.select("record", F.explode(sequences.headers(F.col("title"))).alias("header"))


@query("""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents),
r AS (SELECT doc_id, sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS whole FROM d)
SELECT doc_id AS record, CAST(least(6, floor(CAST(before * 7 AS DOUBLE) / whole)) AS INTEGER) AS file FROM r""", over_tree=False)
def balanced_split(spark, sf):
    return sequences.range_split(_records(spark, sf), 7).select("record", "file")


@query("""+truth AS (SELECT sample, tid, count, CAST(substr(tid, 2) AS BIGINT) % 3 = 0 AS native FROM counts),
f AS (SELECT sample, tid, count FROM counts WHERE CAST(substr(tid, 2) AS BIGINT) % 4 <> 1),
s AS (SELECT sample, sum(t.count) FILTER (native) AS p, sum(t.count) FILTER (NOT native) AS n, sum(coalesce(f.count, 0)) FILTER (native) AS tp, sum(coalesce(f.count,
  0)) FILTER (NOT native) AS fp FROM truth t LEFT JOIN f USING (sample, tid) GROUP BY sample)
SELECT sample, CAST(least(tp, p) AS DOUBLE) / p AS tpr, CAST(fp + tp - least(tp, p) AS DOUBLE) / n AS fpr FROM s""")
def recovery_rates(spark, sf):
    key = F.substring("tid", 2, 20).cast("long")
    counts = T.counts(spark, sf).select("sample", "tid", "count")
    return sequences.recovery(counts.withColumn("native", key % 3 == 0), counts.filter(key % 4 != 1))


@query("SELECT tid FROM tree t WHERE rank = 'SPECIES' AND EXISTS (SELECT 1 FROM paths p WHERE p.tid = t.tid AND p.anc IN ('R1', 'N3')) AND NOT EXISTS (SELECT 1 FROM paths p WHERE p.tid = t.tid AND p.anc = 'N1')")
def listed_species(spark, sf):
    """Nodes of one rank and a range of depths below included ones."""
    return tree.listed_ids(T.ontology(spark, sf), ["R1", "N3"], ["N1"], mindepth=4, maxdepth=5, just_rank="SPECIES")
