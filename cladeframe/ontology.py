"""Ontologies as tables: nodes(tid, parent, rank, rank_value, name) and their ancestor closure(tid, anc, dist)."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import written
from .functions.ranks import go_rank, rank_name, rank_value
from .sources.lines import numbered

ROOT = "1"
GO_ROOT = "GO:ROOT"
CELLULAR = "131567"
#: The gene-ontology terms that hang below the root, with other ids of the same terms.
GO_TOP = ["GO:0003674", "GO:0005554", "GO:0005575", "GO:0008372", "GO:0008150", "GO:0000004", "GO:0007582", "GO:0044699"]
#: The patterns that take a plasmid's name from its description, tried in this order.
PLASMID_NAME = r"""((?:"([\w\-\.\(\)/+=':,%\*\s]*)"$)|(?:^([\w\-\.\(\)/+=':\*\s]*(?:, (?:strain|isolate|plasmid) [\w\-/\.]*)*(?:, fragment \w*)?(?:, contig \w)?)(?:, a cloning vector)?(?=(?=(?:, (?:complete|partial) (?:plasmid |genomic )*(?:sequence|genome|cds|replicon))(?:\[sequence_id)*)|(?:, complete sequence)*, whole genome shotgun sequence|\[sequence_id)))"""
PLASMID_WORDS = r"""(^(?:[A-Za-z0-9/=\-\.{},]*(?: |.)){1,8})"""
MAX_DEPTH = 1 << 12


@dataclass
class Ontology:
    """Nodes with a root, and what of it an analysis includes and excludes. `depth`, if known, is the longest path from the root."""

    nodes: DataFrame
    root: str = ROOT
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    depth: int | None = None
    _closure: DataFrame | None = field(default=None, repr=False)
    _rooted: DataFrame | None = field(default=None, repr=False)

    def closure(self) -> DataFrame:
        """(tid, anc, dist) of each node with itself and all its ancestors; written at its first use, so that each use is a scan."""
        if self._closure is None:
            self._closure = written(closure(self.nodes, self.depth), "closure")
        return self._closure

    def rooted(self) -> DataFrame:
        """closure() of the nodes that have a path to the root, written at its first use."""
        if self._rooted is None:
            paths = self.closure()
            self._rooted = written(paths.join(paths.filter(F.col("anc") == self.root).select("tid"), "tid", "left_semi"), "rooted")
        return self._rooted

    def restricted(self, observed: DataFrame) -> Ontology:
        """The same ontology with only the nodes that are `observed` (tid) or an ancestor of one."""
        return Ontology(self.nodes.join(ancestors_of(self.nodes, observed), "tid", "left_semi"), self.root, self.include, self.exclude, self.depth)

    @functools.cached_property
    def names(self) -> DataFrame:
        return self.nodes.select("tid", F.coalesce("name", F.lit("Unnamed")).alias("name"))


def ancestors_of(nodes: DataFrame, observed: DataFrame) -> DataFrame:
    """The ids of `observed` and of all their ancestors; ids without node give nothing."""
    edges = nodes.select(F.col("tid").alias("of"), "parent")
    found = written(nodes.select("tid").join(observed.select("tid").distinct(), "tid", "left_semi"), "ancestors")
    new = found
    for _ in range(MAX_DEPTH):
        up = new.join(edges, F.col("tid") == F.col("of")).select(F.col("parent").alias("tid")).distinct()
        new = written(up.join(found, "tid", "left_anti").join(nodes.select("tid"), "tid", "left_semi"), "ancestors")
        if new.isEmpty():
            return found
        found = written(found.union(new), "ancestors")
    raise ValueError("the ontology is deeper than it can be, or has a cycle")


def closure(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(tid, anc, dist) of each node with itself and its ancestors.

    A root is its own parent, or has none. A node whose parent is not in `nodes` ends its paths there. With `depth`, the
    longest path from the root, the ancestors are looked up by so many joins in one plan. Else paths are doubled: after
    k rounds, each of which is written, all paths of up to 2**k steps are there.
    """
    if depth is not None:
        return _chained(nodes, depth)
    own = nodes.select("tid", F.col("tid").alias("anc"), F.lit(0).alias("dist"))
    up = nodes.filter("parent is not null and parent != tid").select("tid", F.col("parent").alias("anc"), F.lit(1).alias("dist"))
    up = up.join(nodes.select(F.col("tid").alias("known")), F.col("anc") == F.col("known"), "left_semi")
    paths, reach = written(up, "closure"), 1
    while reach < MAX_DEPTH:
        longest = paths.filter(F.col("dist") == reach).select(F.col("tid").alias("low"), F.col("anc").alias("mid"))
        more = written(longest.join(paths, F.col("mid") == F.col("tid")).select(F.col("low").alias("tid"), "anc", (F.col("dist") + reach).alias("dist")), "closure")
        if more.isEmpty():
            return written(own.union(paths), "closure")
        paths, reach = written(paths.union(more), "closure"), 2 * reach
    raise ValueError("the ontology is deeper than it can be, or has a cycle")


def _chained(nodes: DataFrame, depth: int) -> DataFrame:
    edges = nodes.select(F.col("tid").alias("of"), F.when(F.col("parent") != F.col("tid"), F.col("parent")).alias("up"))
    found = nodes.select("tid", F.col("tid").alias("a0"))
    for k in range(depth):
        step = edges.select(F.col("of").alias(f"of{k}"), F.col("up").alias(f"up{k}"))
        found = found.join(step, F.col(f"a{k}") == F.col(f"of{k}"), "left").drop(f"of{k}").withColumnRenamed(f"up{k}", f"a{k + 1}")
    # A parent that is no node has no edge of its own, but would be listed: it is left out by the last look-up.
    listed = F.array(*(F.struct(F.col(f"a{k}").alias("anc"), F.lit(k).alias("dist")) for k in range(depth + 1)))
    paths = found.select("tid", F.explode(F.filter(listed, lambda x: x["anc"].isNotNull())).alias("x")).select("tid", "x.anc", "x.dist")
    return paths.join(nodes.select(F.col("tid").alias("anc")), "anc", "left_semi").select("tid", "anc", "dist")


def with_depth(nodes: DataFrame, closed: DataFrame) -> DataFrame:
    """nodes with `depth`, the number of ancestors."""
    return nodes.join(closed.groupBy("tid").agg(F.max("dist").alias("depth")), "tid")


def orphans(ids: DataFrame, ontology: Ontology) -> DataFrame:
    """The rows of `ids` (tid, ...) whose ancestors do not reach the root."""
    rooted = ontology.closure().filter(F.col("anc") == ontology.root).select("tid")
    return ids.join(rooted, "tid", "left_anti")


def inversions(ontology: Ontology) -> DataFrame:
    """Pairs of a node and an ancestor that are both ranked, of which the ancestor is not the more general: (tid, anc)."""
    values = ontology.nodes.select("tid", "rank_value").filter("rank_value > 0")
    pairs = ontology.closure().filter("dist > 0").join(values, "tid")
    tops = values.select(F.col("tid").alias("anc"), F.col("rank_value").alias("anc_value"))
    return pairs.join(tops, "anc").filter("rank_value >= anc_value").select("tid", "anc")


def is_monotone(ontology: Ontology) -> bool:
    """Whether ranks strictly fall along each path, so that the set-based roll-up at a rank is exact."""
    return inversions(ontology).isEmpty()


def lineage(ontology: Ontology, ids: DataFrame | None = None, with_root: bool = True) -> DataFrame:
    """(tid, lineage) with lineage an array of (dist, rank, tid, name) from the root down to the node."""
    paths = ontology.closure() if ids is None else ontology.closure().join(ids.select("tid").distinct(), "tid", "left_semi")
    tops = ontology.nodes.select(F.col("tid").alias("anc"), "rank", F.coalesce("name", F.lit("Unnamed")).alias("name"))
    if not with_root:
        paths = paths.filter(F.col("anc") != ontology.root)
    steps = paths.join(tops, "anc").groupBy("tid").agg(F.collect_list(F.struct((-F.col("dist")).alias("up"), "rank", F.col("anc").alias("id"), "name")).alias("steps"))
    return steps.select("tid", F.transform(F.array_sort("steps"), lambda s: F.struct((-s["up"]).alias("dist"), s["rank"].alias("rank"), s["id"].alias("tid"), s["name"].alias("name"))).alias("lineage"))


def named_lineage(ontology: Ontology, ids: DataFrame | None = None) -> DataFrame:
    """(tid, ranks), with ranks a map of rank to name; nodes without rank are numbered as taxid_1, taxid_2 ... from the root."""
    steps = lineage(ontology, ids)
    ranked = F.filter("lineage", lambda s: s["rank"] != "NO_RANK")
    loose = F.filter("lineage", lambda s: s["rank"] == "NO_RANK")
    pairs = F.concat(F.transform(ranked, lambda s: F.struct(s["rank"].alias("k"), s["name"].alias("v"))), F.transform(loose, lambda s, i: F.struct(F.concat(F.lit("taxid_"), (i + 1).cast("string")).alias("k"), s["name"].alias("v"))))
    return steps.select("tid", F.map_from_entries(pairs).alias("ranks"))


# ------------------------------------------------------------------------------------------------- loaders


def _dump(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Fields between tab, bar, tab; the last field of a line may carry a closing bar."""
    parts = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    return spark.read.text(path).filter(F.trim("value") != "").select(*(F.get(parts, k).alias(c) for k, c in enumerate(columns)))


def _last_of(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the value of its last line; `place` is the line's place."""
    return df.groupBy(key).agg(F.max_by(value, "place").alias(value))


def load_ncbi(spark: SparkSession, folder: str, plasmids: str | None = None, collapse: bool = True, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Ontology:
    """nodes.dmp and names.dmp of a folder. `collapse` hangs the children of "cellular organisms" below the root."""
    nodes = _dump(spark, f"{folder}/nodes.dmp", ["tid", "parent", "rank"]).withColumn("rank", rank_name(F.col("rank")))
    names = _dump(spark, f"{folder}/names.dmp", ["tid", "name", "unique", "kind"]).withColumn("place", F.monotonically_increasing_id())
    names = _last_of(names.filter(F.concat_ws("\t", "tid", "name", "unique", "kind").contains("scientific name")), "tid", "name")
    nodes = nodes.withColumn("rank_value", rank_value(F.col("rank")))
    if unknown := nodes.filter("rank_value is null").select("rank").first():
        raise ValueError(f"unknown rank in nodes.dmp: {unknown.rank}")
    if collapse:
        nodes = nodes.withColumn("parent", F.when((F.col("parent") == CELLULAR) & (F.col("tid") != ROOT), ROOT).otherwise(F.col("parent")))
    nodes = nodes.join(names, "tid", "left")
    if plasmids:
        nodes = nodes.unionByName(_plasmids(spark, plasmids, nodes).select(nodes.columns))
    return Ontology(nodes, ROOT, include, exclude)


def _plasmids(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """Plasmid lines: id, parent, ..., description. Known ids and lines that are their own parent are rejected; there is no rank."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).select(F.get(parts, 0).alias("tid"), F.get(parts, 1).alias("parent"), F.element_at(F.split(F.element_at(parts, -1), r"\|"), -1).alias("text"))
    full = F.regexp_replace(F.regexp_replace(F.nullif(F.regexp_extract("text", PLASMID_NAME, 1), F.lit("")), '^"+|"+$', ""), "^,+|,+$", "")
    words = F.nullif(F.trim(F.regexp_extract("text", PLASMID_WORDS, 1)), F.lit(""))
    name = F.concat(F.lit("Plasmid "), F.coalesce(full, words, F.col("tid")))
    fresh = lines.filter("tid is not null and parent is not null and tid != parent").dropDuplicates(["tid"]).join(nodes.select("tid"), "tid", "left_anti")
    return fresh.select("tid", "parent", F.lit("UNCLASSIFIED").alias("rank"), F.lit(0).alias("rank_value"), name.alias("name"))


def load_go(spark: SparkSession, folder: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Ontology:
    """nodes.dmp and names.dmp of a gene ontology. A term's last parent counts; its rank is its depth."""
    def lines(name: str, columns: list[str]) -> DataFrame:
        parts = F.split("value", "\t")
        rows = numbered(spark, f"{folder}/{name}").filter((F.col("line") > 0) & (F.size(parts) == len(columns)))
        return rows.select(F.struct("file", "line").alias("place"), *(F.get(parts, k).alias(c) for k, c in enumerate(columns)))

    parents = _last_of(lines("nodes.dmp", ["tid", "parent"]), "tid", "parent")
    top = spark.createDataFrame([(t, GO_ROOT) for t in GO_TOP] + [(GO_ROOT, GO_ROOT)], "tid string, parent string")
    nodes = parents.join(top.select("tid"), "tid", "left_anti").unionByName(top)
    names = _last_of(lines("names.dmp", ["tid", "activity", "name"]), "tid", "name")
    nodes = nodes.join(names, "tid", "left")
    deep = nodes.join(closure(nodes).groupBy("tid").agg(F.max("dist").alias("depth")), "tid")
    ranked = deep.withColumn("rank", go_rank(F.col("depth"))).withColumn("rank_value", rank_value(F.col("rank"))).drop("depth")
    return Ontology(ranked.select("tid", "parent", "rank", "rank_value", "name"), GO_ROOT, include, exclude)
