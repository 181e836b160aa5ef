"""Results as tables and files: wide tables, sheets, one file a sample, and a page with the tree."""

from __future__ import annotations

import html
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import DISPLAY
from ..ontology import CELLULAR, Ontology, lineage

#: Rows of a chart that the driver writes at most; a chart with more is an error.
CHART_ROWS = 200_000
NO_SCORE = float("-inf")


def wide(fact: DataFrame, ontology: Ontology, samples: list[str]) -> DataFrame:
    """A row a node: tid, and of each sample the accumulated reads (cnt), the reads of its own (una) and the score (sco); rank, name."""
    measures = [F.first("acc").alias("cnt"), F.first("count").alias("una"), F.first("score").alias("sco")]
    rows = fact.groupBy("tid").pivot("sample", samples).agg(*measures)
    return rows.join(ontology.nodes.select("tid", "rank", F.coalesce("name", F.lit("Unnamed")).alias("name")), "tid")


def described(fact: DataFrame, ontology: Ontology) -> DataFrame:
    """fact with each node's rank (tid_rank) and name."""
    return fact.join(ontology.nodes.select("tid", F.lower("rank").alias("tid_rank"), F.coalesce("name", F.lit("Unnamed")).alias("name")), "tid")


def preorder(rows: DataFrame, ontology: Ontology) -> DataFrame:
    """rows with `place_path`, by which they sort in preorder: the ids from the root down."""
    steps = ontology.closure().groupBy("tid").agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("up"), "anc"))).alias("s"))
    return rows.join(steps.select("tid", F.transform("s", lambda x: x["anc"]).alias("place_path")), "tid").orderBy("place_path")


#: The sheet of raw samples; those of control-subtracted ones are named by kind and rank.
RAW_SHEET = "raw_samples_no_rank"


def dynomics(everything: DataFrame, ontology: Ontology) -> DataFrame:
    """Sheets of reads of their own, raw samples and control-subtracted ones by rank: (sheet, tid, rank, name, columns, counts).

    `everything` is (sample, kind, rank, raw_sample, tid, acc, count). Each sheet lists every node that any sample has. `columns` are
    a sheet's samples, found in the same pass as the counts, which are a map from sample to reads; what it lacks is 0.
    """
    sheet = F.when(F.col("kind") == "RAW", RAW_SHEET).otherwise(F.concat(F.lit("CTRL_"), F.lower("rank")))
    rows = everything.filter("kind = 'RAW' or (kind = 'CTRL' and rank is not null)").select(sheet.alias("sheet"), F.coalesce("raw_sample", "sample").alias("column"), "tid", "count")
    columns = rows.groupBy("sheet").agg(F.sort_array(F.collect_set("column")).alias("columns"))
    pairs = F.map_from_entries(F.collect_list(F.when(F.col("count") > 0, F.struct("column", "count"))))
    held = rows.groupBy("sheet", "tid").agg(pairs.alias("counts"))
    every = everything.filter("acc > 0").select("tid").distinct()
    listed = every.join(F.broadcast(columns))  # a row a sheet: at most one for each rank and one for the raw samples
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    full = listed.join(held, ["sheet", "tid"], "left").withColumn("counts", F.coalesce("counts", empty))
    return described(full, ontology).select("sheet", "tid", F.col("tid_rank").alias("rank"), "name", "columns", "counts")


def sheet_table(sheets: DataFrame, sheet: str) -> DataFrame:
    """One sheet as a wide table: tid, __Rank, __Name and a column a sample."""
    own = sheets.filter(F.col("sheet") == sheet)
    first = own.select("columns").first()
    names = first.columns if first else []
    return own.select("tid", F.col("rank").alias("__Rank"), F.col("name").alias("__Name"), *(F.coalesce(F.col("counts")[c], F.lit(0).cast("long")).alias(c) for c in names))


def publish(path: str, tables: dict[str, DataFrame]) -> None:
    """Writes tables that belong together: each below a version of its own, and last a manifest that names them.

    A reader goes by the newest manifest, so it sees the tables before all of these or all of these, whenever a writer
    or a task is lost.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    rows = []
    for name, table in tables.items():
        table.write.parquet(f"{path}/{version}/{name}")
        rows.append((version, name, table.sparkSession.read.parquet(f"{path}/{version}/{name}").count()))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(rows, "version string, name string, n long").coalesce(1).write.mode("append").json(f"{path}/manifest")


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The newest tables that were published together."""
    manifest = spark.read.schema("version string, name string, n long").json(f"{path}/manifest")
    newest = manifest.agg(F.max("version")).first()[0]
    names = manifest.filter(F.col("version") == newest).select("name").collect()  # the few tables of one version
    return {r.name: spark.read.parquet(f"{path}/{newest}/{r.name}") for r in names}


def sheets(fact: DataFrame, ontology: Ontology) -> DataFrame:
    """The reads of their own of each sample's nodes, by rank and name: (sheet_rank, sheet_name, sample, count)."""
    rows = fact.filter("count > 0").join(ontology.nodes.select("tid", "rank", F.coalesce("name", F.lit("Unnamed")).alias("name")), "tid")
    return rows.select(F.col("rank").alias("sheet_rank"), F.col("name").alias("sheet_name"), "sample", "count")


def write_table(table: DataFrame, path: str, kind: str = "csv") -> None:
    """A table as csv, tsv or parquet files; missing scores are -inf in text."""
    if kind == "parquet":
        table.write.mode("overwrite").parquet(path)
        return
    if kind not in ("csv", "tsv"):
        raise ValueError(f"no such kind of table: {kind}")
    scores = [c for c, t in table.dtypes if t == "double" and (c.endswith("_sco") or c == "score")]
    table.fillna(NO_SCORE, scores).write.mode("overwrite").csv(path, sep="\t" if kind == "tsv" else ",", header=True)


def write_lineages(counts: DataFrame, ontology: Ontology, path: str, collapse: str | None = CELLULAR) -> None:
    """Nodes' counts (tid, count) with the names from the root down, one a field, as text by tabs; `collapse` is a node that is left out."""
    steps = lineage(ontology, counts)
    kept = F.filter("lineage", lambda x: (x["tid"] != F.lit(collapse or "")) | (F.size("lineage") <= 2))
    rows = counts.join(steps, "tid").select(F.concat_ws("\t", F.col("count").cast("string"), F.array_join(F.transform(kept, lambda x: x["name"]), "\t")).alias("value"))
    rows.write.mode("overwrite").text(path)


def write_samples(fact: DataFrame, path: str) -> None:
    """One folder of csv files a sample, with the nodes that have reads of their own."""
    fact.filter("count > 0").write.mode("overwrite").partitionBy("sample").csv(path, header=True)


def encoded(values: list[str | None], threshold: float = 0.5) -> tuple[bool, str]:
    """(sparse, text) of a list: place:value pairs if under `threshold` of the values count and that is shorter, else values by comma."""
    plain = ["" if v is None else v for v in values]
    full = ",".join(plain)
    pairs = [f"{k}:{v}" for k, v in enumerate(plain) if v not in ("", "0")]
    sparse = ",".join(pairs)
    if pairs and len(pairs) < threshold * len(plain) and len(sparse) + 1 < len(full):
        return True, sparse
    return False, full


def decoded(sparse: bool, text: str, n: int) -> list[str]:
    """The list again; places that a sparse text lacks are 0."""
    if not sparse:
        return text.split(",") if n else []
    found = ["0"] * n
    for pair in text.split(",") if text else []:
        place, _, value = pair.partition(":")
        found[int(place)] = value
    return found


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif}}details{{margin-left:1em}}i{{display:inline-block;width:1em;height:1em;margin-right:.4em}}td{{padding-right:1em}}</style></head><body>
<h1>{title}</h1><label>Comparison <select id="g"></select></label> <label>Sample <select id="s"></select></label> <label>Search <input id="q"></label>
<p id="k"></p><table id="a"></table><div id="t"></div>
<script>const D={data};
const $=x=>document.getElementById(x),[g,s,q,t,a,k]=["g","s","q","t","a","k"].map($);
const unpack=x=>{{if(!Array.isArray(x))return x.split(",");const v=Array(D.samples.length).fill("0");if(x[0])x[0].split(",").forEach(p=>{{const[i,w]=p.split(":");v[+i]=w}});return v}};
D.nodes.forEach(n=>["c","u","s"].forEach(m=>n[m]=unpack(n[m])));
const groups=[...new Set(D.samples.map(x=>x.group))];groups.forEach(x=>g.add(new Option(x,x)));
function list(){{s.replaceChildren();D.samples.forEach((x,i)=>{{if(x.group===g.value)s.add(new Option(x.name,i))}});show()}}
const hue=v=>v===""||v==="0"&&D.low>0?null:Math.round(120*Math.min(1,Math.max(0,(+v-D.low)/((D.high-D.low)||1))));
function show(){{const i=+s.value,w=q.value.toLowerCase(),kids={{}};D.nodes.forEach(n=>(kids[n.p]=kids[n.p]||[]).push(n));
k.textContent=D.label+" from "+D.low+" (red) to "+D.high+" (green)";
a.replaceChildren(...Object.entries(D.samples[i].attributes||{{}}).map(([x,y])=>{{const r=document.createElement("tr");[x,y].forEach(z=>{{const d=document.createElement("td");d.textContent=z;r.append(d)}});return r}}));
const hit=n=>n.n.toLowerCase().includes(w)||(kids[n.t]||[]).some(hit);
const draw=n=>{{const d=document.createElement("details");d.open=!!w||n.p==="";const m=document.createElement("summary"),b=document.createElement("i"),h=hue(n.s[i]);
if(h!==null)b.style.background="hsl("+h+",60%,55%)";m.append(b,n.n+" ("+n.r+") "+n.c[i]+", own "+(n.u[i]||0)+(n.s[i]===""?"":", score "+n.s[i]));d.append(m);
(kids[n.t]||[]).filter(x=>+x.c[i]>0&&(!w||hit(x))).sort((x,y)=>y.c[i]-x.c[i]).forEach(x=>d.append(draw(x)));return d}};
t.replaceChildren(...(kids[""]||[]).map(draw))}}
g.onchange=list;s.onchange=q.oninput=show;list();</script></body></html>"""


def _packed(values: list[str]) -> str | list[str]:
    """Values by comma, or in a list of their own the places and values of the few that count."""
    sparse, text = encoded(values)
    return [text] if sparse else text


def chart_data(
    fact: DataFrame, ontology: Ontology, samples: list[str], kinds: dict[str, tuple[str, str | None]] | None = None, attributes: dict[str, dict[str, str]] | None = None, scoring: str = "SHEL",
) -> dict:
    """What a chart's page holds: samples in groups by kind and rank, nodes with their values of all samples, sparse where few count.

    More than CHART_ROWS nodes are an error, not cut.
    """
    table = wide(fact, ontology, samples).join(ontology.nodes.select("tid", F.when(F.col("tid") != ontology.root, F.col("parent")).otherwise("").alias("parent")), "tid")
    rows = table.limit(CHART_ROWS + 1).collect()
    if len(rows) > CHART_ROWS:
        raise ValueError(f"a chart holds {CHART_ROWS} nodes at most; fold more of them")
    number = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x or 0)
    values = lambda r, m: _packed([number(r[f"{s}_{m}"]) if m == "sco" else str(r[f"{s}_{m}"] or 0) for s in samples])
    nodes = [{"t": r.tid, "p": r.parent, "n": r["name"], "r": (r["rank"] or "").lower(), "c": values(r, "cnt"), "u": values(r, "una"), "s": values(r, "sco")} for r in rows]
    scores = [x for r in rows for s in samples if (x := r[f"{s}_sco"]) is not None and (r[f"{s}_una"] or 0) > 0]
    group = lambda s: " ".join(x.lower() for x in (kinds or {}).get(s, ("RAW", None)) if x)
    listed = [{"name": s, "group": group(s), "attributes": (attributes or {}).get(s, {})} for s in samples]
    return {"samples": listed, "nodes": nodes, "low": min(scores, default=0.0), "high": max(scores, default=0.0), "label": DISPLAY[scoring]}


def write_chart(
    fact: DataFrame, ontology: Ontology, samples: list[str], path: str, title: str = "Samples", kinds: dict[str, tuple[str, str | None]] | None = None,
    attributes: dict[str, dict[str, str]] | None = None, scoring: str = "SHEL",
) -> None:
    """A page of its own with the trees of all samples, to a local path: a choice of comparison and rank, then of its samples, colours by score."""
    data = json.dumps(chart_data(fact, ontology, samples, kinds, attributes, scoring)).replace("</", "<\\/")
    with open(path, "w", encoding="utf-8") as file:
        file.write(_PAGE.format(title=html.escape(title), data=data))
