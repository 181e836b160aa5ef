"""Queries of whole comparisons of samples, over trees whose ranks fall and trees whose ranks do not, with SQL of the literal rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ontology as O
from ..checkpoints import written
from ..functions.ranks import RANK_VALUES
from ..operators import cross, summary, tree
from . import driver_tables as T
from .catalog import LEAST, query

KEYS = "kind, rank, target, sample"
FALLING = ["SPECIES", "GENUS", "FAMILY"]
MIXED = ["STRAIN", "SPECIES", "GENUS"]
#: Limits of the decision list under which these tables have contaminants and others.
LIMITS = {"severe": 0.002, "mild": 0.0015}

_PLAIN_TREE = """tree AS (
  SELECT '1' AS tid, '1' AS parent, 'ROOT' AS rank, 0 AS depth UNION ALL SELECT 'R' || r_regionkey, '1', 'FAMILY', 1 FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'GENUS', 2 FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'SPECIES', 3 FROM customer)"""
_MIXED_TREE = """tree AS (
  SELECT '1' AS tid, '1' AS parent, 'ROOT' AS rank, 0 AS depth UNION ALL SELECT 'R' || r_regionkey, '1', CASE WHEN r_regionkey % 2 = 0 THEN 'FAMILY' ELSE 'GENUS' END, 1 FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, CASE n_nationkey % 3 WHEN 0 THEN 'SPECIES' WHEN 1 THEN 'GENUS' ELSE 'NO_RANK' END, 2 FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, CASE c_custkey % 4 WHEN 0 THEN 'GENUS' WHEN 3 THEN 'STRAIN' ELSE 'SPECIES' END, 3 FROM customer)"""
_LEAF_READS = "reads AS (SELECT o_orderpriority AS sample, 'C' || o_custkey AS tid, CAST(round(o_totalprice * 100) AS BIGINT) AS score FROM orders)"
_SCATTERED = """reads AS (SELECT o_orderpriority AS sample, CASE WHEN o_orderkey % 7 = 0 THEN 'N' || (o_custkey % 25) WHEN o_orderkey % 31 = 0 THEN 'R' || (o_custkey % 5) ELSE 'C' || o_custkey END AS tid,
  {score} AS score FROM orders)"""


def _le(a: str, b: str, sign: str = "<=") -> str:
    return f"({a} > 0 AND {b} > 0 AND {a} {sign} {b})"


def _level(depth: int, least: str, tot: str = "tot") -> str:
    """SQL of one level: its nodes' sums, which of them are pruned, and what rises to their parents."""
    rising = f" UNION ALL SELECT {KEYS}, parent, acc, CASE WHEN pruned THEN cnt ELSE 0 END, {tot} FROM j{depth + 1} WHERE NOT pruned OR (moves AND acc > 0)" if depth < 3 else ""
    at_prune = f"({_le('i.v', 'target', '<')} OR {_le('p.v', 'target')} OR {_le('p.near', 'target')})"
    return f"""g{depth} AS (SELECT {KEYS}, tid, sum(acc) AS acc, sum(cnt) AS cnt, sum(tot) AS tot FROM (
  SELECT {KEYS}, tid, abun AS acc, abun AS cnt, tot FROM own WHERE depth = {depth}{rising}) GROUP BY ALL),
j{depth} AS (SELECT g.*, i.parent, i.depth > 0 AND (acc < {least} OR {at_prune}) AS pruned, {at_prune} AND (p.v = target OR {_le('p.near', 'target')}) AS moves
  FROM g{depth} g JOIN info i USING (tid) JOIN info p ON p.tid = i.parent)"""


_COUNTS = "counts AS (SELECT sample, tid, count(*) AS count, CAST(sum(score) AS DOUBLE) AS total FROM reads GROUP BY sample, tid)"


def _compared(tree_sql: str, reads_sql: str, ranks: list[str], log: bool = False, counts_sql: str = _COUNTS, least: str = str(LEAST), lowest: int = LEAST) -> str:
    """SQL of trees, presence, contaminants, trees at ranks by the literal rules, and what samples share: table `found`."""
    power = (lambda s: f"pow(10.0, {s} - 154)") if log else (lambda s: s)
    mean = (lambda t, n: f"(log10({t} / {n}) + 154)") if log else (lambda t, n: f"({t} / {n})")
    values = " ".join(f"WHEN '{r}' THEN {v}" for r, v in RANK_VALUES.items() if r in {"ROOT", "FAMILY", "GENUS", "SPECIES", "STRAIN", "NO_RANK"})
    targets = ", ".join(f"('{r}', {RANK_VALUES[r]})" for r in ranks)
    levels = ",\n".join(_level(d, least) for d in (3, 2, 1, 0))
    return f"""WITH {tree_sql}, {reads_sql},
ranks(rank, target) AS (VALUES {targets}),
up AS (SELECT tid, parent FROM tree WHERE tid <> '1'),
paths AS (SELECT tid, tid AS anc, 0 AS dist FROM tree UNION ALL SELECT tid, parent, 1 FROM up UNION ALL SELECT a.tid, b.parent, 2 FROM up a JOIN up b ON a.parent = b.tid
  UNION ALL SELECT a.tid, c.parent, 3 FROM up a JOIN up b ON a.parent = b.tid JOIN up c ON b.parent = c.tid),
valued AS (SELECT *, CASE rank {values} END AS v FROM tree),
nearest AS (SELECT p.tid, arg_min(CASE WHEN a.tid = '1' THEN {RANK_VALUES['ROOT']} ELSE a.v END, p.dist) AS near FROM paths p JOIN valued a ON a.tid = p.anc WHERE p.dist > 0
  AND a.rank <> 'NO_RANK' GROUP BY p.tid),
info AS (SELECT t.tid, t.parent, t.depth, t.v, coalesce(near, {RANK_VALUES['ROOT']}) AS near FROM valued t LEFT JOIN nearest USING (tid)),
samples AS (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS ord FROM (SELECT DISTINCT sample FROM reads)),
{counts_sql},
acc AS (SELECT sample, anc AS tid, sum(count) AS acc, sum(total) AS total FROM counts JOIN paths USING (tid) GROUP BY sample, anc),
kept AS (SELECT * FROM acc WHERE acc >= {least} OR tid = '1'),
below AS (SELECT sample, parent AS tid, sum(acc) AS b FROM kept JOIN up USING (tid) GROUP BY sample, parent),
fact AS (SELECT k.sample, k.tid, k.acc, k.acc - coalesce(b, 0) AS count, k.total / k.acc AS score FROM kept k LEFT JOIN below USING (sample, tid)),
present AS (SELECT rank, sample, f.tid FROM fact f JOIN tree t USING (tid) JOIN ranks USING (rank)),
candidates AS (SELECT DISTINCT rank, tid FROM present WHERE sample = (SELECT min(sample) FROM samples)),
freq AS (SELECT c.rank, c.tid, s.sample, s.ord, s.ord = 0 AS is_ctrl, coalesce(CAST(a.acc AS DOUBLE) / w.acc, 0.0) AS freq FROM candidates c CROSS JOIN samples s
  JOIN fact w ON w.sample = s.sample AND w.tid = '1' LEFT JOIN fact a ON a.sample = s.sample AND a.tid = c.tid),
n AS (SELECT rank, tid, count(*) AS n, median(freq) AS med, max(freq) FILTER (is_ctrl) AS top FROM freq GROUP BY rank, tid),
gaps AS (SELECT a.rank, a.tid, abs(a.freq - b.freq) AS d FROM freq a JOIN freq b ON a.rank = b.rank AND a.tid = b.tid AND a.ord < b.ord),
placed AS (SELECT rank, tid, d, row_number() OVER (PARTITION BY rank, tid ORDER BY d) AS k FROM gaps),
scale AS (SELECT n.*, 3.4760 * d AS qn FROM placed JOIN n USING (rank, tid) WHERE k = greatest(1, CAST(floor(n * (n / 2.0 + 1) / 4) AS INTEGER))),
source AS (SELECT rank, tid, sample, NOT is_ctrl AND freq > med + 5 * qn AND freq > 1000 * top AS is_source FROM freq JOIN scale USING (rank, tid)),
labels AS (SELECT f.rank, f.tid, CASE WHEN max(freq) FILTER (NOT is_ctrl) < 1e-14 THEN 'just-ctrl' WHEN min(freq) FILTER (is_ctrl) > {LIMITS['severe']} THEN 'critical' WHEN max(freq) FILTER (is_ctrl) > {LIMITS['severe']} THEN 'severe'
  WHEN min(freq) FILTER (is_ctrl) > {LIMITS['mild']} THEN 'mild' WHEN count(*) FILTER (is_source) > 0 THEN 'crossover' ELSE 'other' END AS label,
  count(*) FILTER (is_source) = count(*) FILTER (NOT is_ctrl) AS everywhere
  FROM freq f JOIN source USING (rank, tid, sample) GROUP BY f.rank, f.tid),
barred AS (SELECT 'EXCLUSIVE' AS kind, p.rank, s.sample, p.tid FROM present p JOIN samples s ON p.sample <> s.sample
  UNION SELECT 'CTRL', l.rank, s.sample, l.tid FROM labels l JOIN source s ON s.rank = l.rank AND s.tid = l.tid WHERE s.sample <> (SELECT min(sample) FROM samples)
  AND label <> 'just-ctrl' AND NOT (label = 'crossover' AND is_source)),
out AS (SELECT DISTINCT kind, rank, sample, p.tid FROM barred b JOIN paths p ON p.anc = b.tid),
given AS (SELECT kind, rank, target, sample, tid, count, score FROM fact CROSS JOIN ranks CROSS JOIN (VALUES ('EXCLUSIVE'), ('CTRL'), ('PARTIAL')) k(kind)
  WHERE count > 0 AND NOT (kind = 'CTRL' AND sample = (SELECT min(sample) FROM samples)) AND NOT EXISTS (SELECT 1 FROM out o WHERE o.kind = k.kind AND o.rank = ranks.rank
  AND o.sample = fact.sample AND o.tid = fact.tid)),
own AS (SELECT {KEYS}, tid, i.depth, count AS abun, count * {power('score')} AS tot FROM given JOIN info i USING (tid) WHERE {_le('i.v', 'target')} OR {_le('i.near', 'target')}),
{levels},
trees AS (SELECT * FROM ({' UNION ALL '.join(f'SELECT {KEYS}, tid, acc, cnt, tot FROM j{d} WHERE NOT pruned' for d in (0, 1, 2, 3))}) WHERE acc > 0),
partial AS (SELECT 'SHARED' AS kind, rank, sample, tid, cnt, {mean('tot', 'acc')} AS score FROM trees WHERE kind = 'PARTIAL' AND cnt > 0),
shares AS (SELECT * FROM partial UNION ALL SELECT 'CONTROL_SHARED', rank, sample, tid, cnt, score FROM partial p WHERE sample <> (SELECT min(sample) FROM samples)
  AND NOT EXISTS (SELECT 1 FROM labels l JOIN paths q ON q.anc = l.tid WHERE l.rank = p.rank AND q.tid = p.tid AND NOT (label = 'crossover' AND everywhere))),
common AS (SELECT kind, rank, tid, sum(cnt) // count(*) AS count, sum(cnt * score) / sum(cnt) AS score FROM shares GROUP BY kind, rank, tid
  HAVING count(*) = (SELECT count(*) FROM samples) - CASE WHEN kind = 'SHARED' THEN 0 ELSE 1 END),
sums AS (SELECT kind, rank, anc AS tid, sum(count) AS acc, sum(count * {power('score')}) AS tot FROM common JOIN paths USING (tid) GROUP BY kind, rank, anc),
big AS (SELECT * FROM sums WHERE (acc >= {lowest} OR tid = '1') AND acc > 0),
under AS (SELECT kind, rank, parent AS tid, sum(acc) AS b FROM big JOIN up USING (tid) GROUP BY kind, rank, parent),
found AS (SELECT kind, rank, sample AS raw_sample, tid, CAST(acc AS BIGINT) AS acc, CAST(cnt AS BIGINT) AS count, {mean('tot', 'acc')} AS score FROM trees WHERE kind <> 'PARTIAL'
  UNION ALL SELECT kind, rank, NULL, tid, CAST(acc AS BIGINT), CAST(acc - coalesce(b, 0) AS BIGINT), {mean('tot', 'acc')} FROM big LEFT JOIN under USING (kind, rank, tid))
"""


def _study(spark, sf, counts: DataFrame, tops: O.Ontology, ranks: list[str], log: bool = False, least: str | None = None) -> DataFrame:
    """The comparison of the samples' folded trees, as analysis has it."""
    samples = T.samples(spark, sf, LEAST)
    if least is not None:
        samples = samples.withColumn("mintaxa", F.expr(least))
    acc = tree.accumulated(counts, tops).join(samples.select("sample", "mintaxa"), "sample")
    fact = written(tree.folded(acc, tops, F.col("mintaxa")).drop("mintaxa"), "trees")
    folded = tree.weighed(tree.with_scores(fact).filter("count > 0"), log)
    found = cross.cross_analysis(folded, fact, samples, tops, ranks, log, **LIMITS)
    return tree.with_scores(found, log)


def _shown(found: DataFrame, digits: int = 4) -> DataFrame:
    return found.select("kind", "rank", "raw_sample", "tid", "acc", "count", F.round("score", digits).alias("score"))


_SHOW = "SELECT kind, rank, raw_sample, tid, acc, count, round(score, {}) AS score FROM found"
_FALLING = _compared(_PLAIN_TREE, _LEAF_READS, FALLING)
_INVERTED = _compared(_MIXED_TREE, _SCATTERED.format(score="CAST(round(o_totalprice * 100) AS BIGINT)"), MIXED)
_LOG = _compared(_MIXED_TREE, _SCATTERED.format(score="o_orderkey % 309"), MIXED, log=True)


@query(_FALLING + _SHOW.format(2), over_tree=False)
def cross_analysis(spark, sf):
    """All kinds at three ranks that fall along each path."""
    return _shown(_study(spark, sf, T.counts(spark, sf), T.ontology(spark, sf), FALLING), 2)


@query(_INVERTED + _SHOW.format(2), over_tree=False)
def inverted_cross_analysis(spark, sf):
    """All kinds at three ranks that rise and fall along paths, with reads at inner nodes: the literal rules, level by level."""
    return _shown(_study(spark, sf, T.scattered_counts(spark, sf), T.inverted_ontology(spark, sf), MIXED), 2)


@query(_LOG + _SHOW.format(6), over_tree=False)
def log_cross_analysis(spark, sf):
    """The same with logarithmic scores from 0 to 308, averaged as powers of ten."""
    return _shown(_study(spark, sf, T.scattered_counts(spark, sf, log=True), T.inverted_ontology(spark, sf), MIXED, log=True), 6)


#: Each sample's least number of reads, by the number that its name begins with.
_OWN_LEAST = "2 + CAST(substr(sample, 1, 1) AS INT) % 3"


def _own(tree_sql: str, reads_sql: str, ranks: list[str]) -> str:
    return _compared(tree_sql, reads_sql, ranks, least=f"({_OWN_LEAST})", lowest=2) + _SHOW.format(2)


@query(_own(_PLAIN_TREE, _LEAF_READS, FALLING), over_tree=False)
def own_mintaxa_cross_analysis(spark, sf):
    """Samples that each have a least number of reads of their own."""
    return _shown(_study(spark, sf, T.counts(spark, sf), T.ontology(spark, sf), FALLING, least=_OWN_LEAST), 2)


@query(_own(_MIXED_TREE, _SCATTERED.format(score="CAST(round(o_totalprice * 100) AS BIGINT)"), MIXED), over_tree=False)
def own_mintaxa_inverted_cross_analysis(spark, sf):
    """The same by the literal rules, on a tree whose ranks rise and fall."""
    return _shown(_study(spark, sf, T.scattered_counts(spark, sf), T.inverted_ontology(spark, sf), MIXED, least=_OWN_LEAST), 2)
