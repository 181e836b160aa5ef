import gzip
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cladeframe import analysis
from cladeframe.functions.ranks import RANK_VALUES, rank_of_letter
from cladeframe.functions.scores import DISPLAY, SCORINGS
from cladeframe.ontology import Ontology, is_monotone, load_ncbi, named_lineage
from cladeframe.operators import cross, sequences, stats, tree
from cladeframe.sources import classified, sequence_files, sinks, sniffed
from cladeframe.streaming.counts import running_counts
from tests.test_core import counts, literal, ontology

KINDS = ["DOMAIN", "FAMILY", "GENUS", "SPECIES", "STRAIN", "NO_RANK"]


@pytest.mark.parametrize("seed", range(3))
def test_exact_trees_of_inverted_ranks_equal_recursion_for_all_groups_at_once(spark, seed):
    rng = random.Random(seed)
    nodes = [("1", "1", "NO_RANK")]
    for k in range(2, 45):
        nodes.append((str(k), rng.choice(nodes)[0], rng.choice(KINDS)))
    tops = ontology(spark, nodes)
    assert not is_monotone(tops)
    groups = {("a", "GENUS", 3): {}, ("b", "GENUS", 2): {}, ("a", "SPECIES", 1): {}}
    rows = []
    for (sample, rank, least), counted in groups.items():
        counted.update({t: rng.randint(1, 6) for t, _, _ in nodes if rng.random() < 0.6})
        rows += [(sample, rank, t, n, n, float(n), least, RANK_VALUES[rank]) for t, n in counted.items()]
    df = spark.createDataFrame(rows, "sample string, rank string, tid string, count long, scored long, total double, least int, target int")
    got = tree.exact_tree(df, tops, "least", "target", True, ["sample", "rank"]).collect()
    for (sample, rank, least), counted in groups.items():
        own = {r.tid: (r.acc, r["count"]) for r in got if (r.sample, r["rank"]) == (sample, rank) and r.acc}
        assert own == literal(nodes, counted, least, RANK_VALUES[rank])


def test_comparison_tests_the_tree(spark):
    nodes = [("1", "1", "NO_RANK"), ("g", "1", "SPECIES"), ("s", "g", "GENUS"), ("t", "s", "SPECIES")]
    tops = ontology(spark, nodes)
    rows = counts(spark, [("a", "t", 5, 2.0), ("b", "t", 7, 4.0), ("b", "g", 4, 1.0)])
    samples = spark.createDataFrame([("a", 0, False, 1), ("b", 1, False, 1)], "sample string, ord int, is_ctrl boolean, mintaxa int")
    fact = tree.rollup(rows, tops, 1)
    show = lambda exact: {(r.kind, r.tid): (r.acc, r["count"]) for r in cross.cross_analysis(rows, fact, samples, tops, ["SPECIES"], exact=exact).collect() if r["count"]}
    assert show(None) == show(True) != show(False)


def test_means_of_logarithms_neither_overflow_nor_vanish(spark):
    rows = spark.createDataFrame([("s", "x", 308.0)] * 3 + [("s", "y", 0.0)] * 2 + [("s", "z", 1.0), ("s", "z", 3.0), ("s", "n", None)], "sample string, tid string, score double")
    got = {r.tid: r.score for r in tree.with_scores(tree.counts_of(rows, log=True), log=True).collect()}
    assert got["n"] is None and math.isclose(got["x"], 308) and abs(got["y"]) < 1e-9 and math.isclose(got["z"], math.log10((10 + 1000) / 2))
    means = spark.createDataFrame([("s", "x", 10**12, 308.0), ("s", "y", 5, None)], "sample string, tid string, count long, score double")
    got = {r.tid: r.score for r in tree.with_scores(tree.weighed(means, log=True), log=True).collect()}
    assert math.isclose(got["x"], 308) and got["y"] is None


def reader_files(folder):
    """Each reader's files for two samples with three reads of a and two of b, one unclassified."""
    out = {}
    for name, a, b in (("one", 3, 2), ("two", 1, 4)):
        ids = ["11"] * a + ["12"] * b
        texts = {
            "centrifuge": "h\n" + "".join(f"r\ts\t{t}\t100\t0\t60\t90\t1\n" for t in ids) + "r\tu\t0\t0\t0\t0\t70\t1\n",
            "kraken": "".join(f"C\tr\t{t}\t90\t{t}:30 1:10\n" for t in ids) + "U\tr\t0\t70\t0:50\n",
            "clark": "h\n" + "".join(f"r,90,0.5,{t},20,8,3,0.9\n" for t in ids) + "r,70,0,NA,0,NA,0,0\n",
            "lmat": "".join(f"t\t{'A' * 90}\t1 1 2\t{t} 0.5\t{t} 0.7 DirectMatch\n" for t in ids) + f"t\t{'A' * 70}\t1 1 2\t\t0 0 NoDbHits\n",
            "generic": "tid,len,sco\n" + "".join(f"{t},90,3.5\n" for t in ids) + "0,70,0\n",
        }
        for reader, text in texts.items():
            path = folder / reader / f"{name}{'_output' if reader == 'lmat' else ''}.{'out' if reader in ('centrifuge', 'lmat') else 'csv' if reader in ('clark', 'generic') else 'krk'}"
            path.parent.mkdir(exist_ok=True)
            path.write_text(text)
            out.setdefault(reader, []).append(f"file://{path}")
    return out


def small_tree(spark):
    nodes = [(t, p, r, RANK_VALUES[r]) for t, p, r in (("1", "1", "ROOT"), ("10", "1", "GENUS"), ("11", "10", "SPECIES"), ("12", "10", "SPECIES"))]
    return Ontology(spark.createDataFrame([(*x, f"n{x[0]}") for x in nodes], "tid string, parent string, rank string, rank_value int, name string"), depth=2)


@pytest.mark.parametrize("reader", ["centrifuge", "kraken", "clark", "lmat", "generic"])
def test_one_call_for_each_reader(spark, tmp_path, reader):
    form = classified.GenericFormat.parsed("TYP:csv,TID:1,LEN:2,SCO:3,UNC:0")
    found = analysis.analyse(spark, reader, reader_files(tmp_path)[reader], small_tree(spark), mintaxa=1, summaries="AVOID", form=form)
    rows = {r.sample: r for r in found.stats.collect()}
    assert {(r.seqs_read, r.seqs_unclassified, r.seqs_classified, r.seqs_filtered, r.ids_folded, r.nt_read) for r in rows.values()} == {(6, 1, 5, 5, 2, 520)}
    assert found.summaries is None and {r["count"] for r in found.derived.filter("kind = 'SHARED' and tid = '11' and rank = 'SPECIES'").collect()} == {2}


def test_limits_of_the_one_call_and_its_results(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    for name, ids in (("c", "11 11"), ("x", "11 11 12 12 12"), ("y", "12 12 12 1 131567")):
        (path / f"{name}.out").write_text("h\n" + "".join(f"r\ts\t{t}\t{(k + 5) ** 2}\t0\t60\t90\t1\n" for k, t in enumerate(ids.split())) + "r\tu\t0\t0\t0\t0\t70\t1\n")
    (path / "notes.txt").write_text("not a sample")
    found = analysis.analyse(spark, "centrifuge", [f"file://{path}"], small_tree(spark), controls=1, minscore=21, control_minscore=20, mintaxa=1, control_mintaxa=1, take_out_root=True)
    got = {r.sample: (r.seqs_read, r.seqs_unclassified, r.seqs_classified, r.seqs_filtered, round(r.unclassified_ratio, 3), round(r.reject_ratio, 3), r.ids_classified, r.ids_filtered, r.score_limit) for r in found.stats.collect()}
    assert got == {"c": (3, 1, 2, 2, 0.333, 0.0, 1, 1, 20.0), "x": (6, 1, 5, 4, 0.167, 0.2, 2, 2, 21.0), "y": (6, 1, 5, 2, 0.167, 0.6, 3, 1, 21.0)}
    assert found.order == ["c", "x", "y"] and found.derived.filter("kind = 'CTRL' and tid = '11'").count() == 0
    for kind in analysis.OUTPUTS:
        found.write(f"file://{tmp_path}/{kind}", kind)
    full = sinks.published(spark, f"file://{tmp_path}/FULL")
    assert {r.statistic: r.x for r in full["stat"].collect()}["Seqs. filtered"] == 4.0 and full["data"].filter("tid = '12'").first()["x_cnt"] == 3
    sheets = sinks.published(spark, f"file://{tmp_path}/DYNOMICS")["sheets"]
    raw = {r.tid: (r.c, r.x, r.y) for r in sinks.sheet_table(sheets, sinks.RAW_SHEET).collect()}
    assert raw["11"] == (2, 1, 0) and raw["12"] == (0, 3, 2)
    assert spark.read.csv(f"file://{tmp_path}/CSV/data", header=True).count() == 4 and spark.read.csv(f"file://{tmp_path}/TSV/stat", header=True, sep="\t").count() == 15
    assert spark.read.csv(f"file://{tmp_path}/MULTICSV/samples", header=True).filter("sample = 'c'").count() == 1
    found.write_chart(str(tmp_path / "page.html"), "A <b>")
    page = (tmp_path / "page.html").read_text()
    data = json.loads(page.split("const D=")[1].split(";\nconst $")[0])
    assert "A &lt;b&gt;" in page and {"raw", "ctrl species", "ctrl"} <= {s["group"] for s in data["samples"]} and data["label"] == "Score (avg)"
    counted = {n["t"]: n["c"] for n in data["nodes"]}
    place = [s["name"] for s in data["samples"]].index("x")
    plain = counted["12"] if isinstance(counted["12"], list) else None
    assert sinks.decoded(bool(plain), plain[0] if plain else counted["12"], len(data["samples"]))[place] == "3"


@pytest.mark.parametrize("summaries", ["ADD", "ONLY", "AVOID"])
def test_choice_of_summaries(spark, tmp_path, summaries):
    found = analysis.analyse(spark, "centrifuge", reader_files(tmp_path)["centrifuge"], small_tree(spark), mintaxa=1, summaries=summaries)
    assert (found.derived is None) == (summaries == "ONLY") and (found.summaries is None) == (summaries == "AVOID")
    kinds = {r.kind for r in found.everything().select("kind").collect()}
    assert kinds == {"RAW", "SHARED"}
    if summaries != "AVOID":
        assert found.summaries.filter("kind = 'SHARED'").count() == 4 and "SHARED_SUMMARY" in found.names()


def test_publishing_shows_the_newest_whole_version(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    table = lambda n: spark.range(n).withColumnRenamed("id", "n")
    sinks.publish(path, {"a": table(1), "b": table(2)})
    table(9).write.parquet(f"{path}/99999999999999999999-half/a")  # a writer that was lost before its manifest
    assert {n: t.count() for n, t in sinks.published(spark, path).items()} == {"a": 1, "b": 2}
    sinks.publish(path, {"a": table(3), "b": table(4)})
    assert {n: t.count() for n, t in sinks.published(spark, path).items()} == {"a": 3, "b": 4}


def test_gzip_is_told_by_bytes(spark, tmp_path):
    records = "".join(f"@r{k}\nACGT\n+\nIIII\n" for k in range(50_000))
    (tmp_path / "zipped.fq").write_bytes(gzip.compress(records[: len(records) // 2].encode()) + gzip.compress(records[len(records) // 2 :].encode()))
    (tmp_path / "plain.fq").write_text("@p\nAC\n+\nII\n")
    (tmp_path / "known.fq.gz").write_bytes(gzip.compress(b"@k\nAC\n+\nII\n"))
    (tmp_path / "empty.fq").write_text("")
    plain, hidden = sniffed.sniffed(spark, f"file://{tmp_path}")
    assert [p.rsplit("/", 1)[-1] for p in hidden] == ["zipped.fq"] and len(plain) == 2  # an empty file has no lines, and Spark does not list it
    found = sequence_files.fastq(spark, f"file://{tmp_path}", sniff=True)
    assert found.count() == 50_002 and found.filter("title = 'r49999'").first().record == 49_999
    (tmp_path / "f").write_bytes(gzip.compress(b">a x\r\nAC\nGT\n>b\nAA\n"))
    assert sorted((r.title, r.seq) for r in sequence_files.fasta(spark, f"file://{tmp_path}/f", sniff=True).collect()) == [("a x", "ACGT"), ("b", "AA")]


def test_lmat_folders_prefixes_and_records(spark, tmp_path):
    line = lambda t, m="DirectMatch": f"r {t}\tACGT\t1.5 0.5 7\t{t} 0.5 9 -1\t{t} 0.7 {m}\n"
    for name, text in (("a1_output.out", line(1) + "bad\n" + line(2)), ("a2_output.out", line(3)), ("b_output.out", line(4, "NoDbHits")), ("x_output.canVfin.out", line(5)), ("other.txt", line(6))):
        (tmp_path / name).write_text(text)
    ids = lambda p: sorted(r.tid for r in classified.lmat(spark, f"file://{tmp_path}{p}").filter("not unclassified").collect())
    assert ids("") == ["1", "3"] and ids("/a") == ["1", "3"] and ids("/a2") == ["3"] and ids("/a1_output.out") == ["1"]
    record = classified.lmat_records(spark, f"file://{tmp_path}/a2_output.out").first()
    assert (record.read_id, record.average, record.kmers, record.match) == ("r", 1.5, 7, "DIRECTMATCH") and [tuple(x) for x in record.candidates] == [("3", 0.5), ("9", -1.0)]


def test_mock_sheets_and_reads(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text('taxon,id,s1,s2\n"One, x",11,2,0\nTwo,12,,3\nsum,,2,3\n')
    layout = sequence_files.mock_sheet(spark, f"file://{tmp_path}/sheet.csv")
    assert sorted(map(tuple, layout.collect())) == [("s1", "11", 2), ("s2", "12", 3)]
    reads = [sorted(map(tuple, sequences.mock_reads(layout.repartition(n), keys=["sample"]).collect())) for n in (1, 5)]
    assert reads[0] == reads[1] and len(reads[0]) == 5 and all(1 <= r[3] <= 135**2 for r in reads[0])


def test_limits_and_splits_of_sparse_records(spark):
    rows = spark.createDataFrame([(k * k * 10_007, "A" * (k % 5 + 1)) for k in range(300)], "record long, seq string").repartition(5)
    assert sorted(r.record for r in sequences.first_rows(rows, 77, "record").collect()) == [k * k * 10_007 for k in range(77)]
    assert sequences.first_rows(rows.limit(0), 5, "record").count() == 0 and sequences.first_rows(rows, 1000, "record").count() == 300
    files = [(r.record, r.file) for r in sequences.range_split(rows, 4).orderBy("record").collect()]
    assert [f for _, f in files] == sorted(f for _, f in files) and {f for _, f in files} == {0, 1, 2, 3}
    rate = sequences.match_rate(rows.limit(1), rows).first()
    assert (rate.matched, rate.scanned) == (1, 300) and math.isnan(sequences.match_rate(rows.limit(0), rows.limit(0)).first().rate)


def test_records_are_written_and_read_back(spark, tmp_path):
    rows = [("r1", "ACGT", 1.5, 0.25, 7, [("3", 0.5), ("9", -1.0)], "3", 0.5, "DIRECTMATCH"), ("r2", "A", 0.0, 0.0, 0, [], "0", 0.0, "NODBHITS")]
    schema = "read_id string, sequence string, average double, deviation double, kmers long, candidates array<struct<tid:string,score:double>>, tid string, score double, match string"
    records = spark.createDataFrame(rows, schema)
    classified.write_lmat(records, f"file://{tmp_path}/a_output.out")
    got = classified.lmat_records(spark, f"file://{tmp_path}/a_output.out").select(records.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, records.collect()))
    text = "readID\tseqID\n" + "r1 x\ts\t9\t25\t4\t60\t90\t2\n" + "r2\ts\t9\t25\n" + "r3\ts\t9\t25\t4\t60\t90\t2\n"
    (tmp_path / "c.out").write_text(text)
    found = classified.centrifuge_records(spark, f"file://{tmp_path}/c.out").collect()
    assert [(r.read_id, r.score, r.second_score, r.matches) for r in found] == [("r1", 20.0, 17.0, 2)]


def test_names_of_results():
    assert sequences.extraction_name("x/a.fastq.gz", ["9", "10"], ["3"], compress=True) == "x/a_rxtr_incl_10_9_excl_3.fastq.gz"
    assert sequences.extraction_name("a.fq", unclassified=True) == "a_rxtr_unclass.fq" and sequences.extraction_name("a", mark="rxnt") == "a_rxnt"
    assert analysis.output_name("in/S1_mhl25_x.out") == "S1" and analysis.output_name("S1_go.out", go=True) == "S1" and analysis.sample_name("in/a.b.krk.gz") == "a.b"


def test_lineage_file(spark, tmp_path):
    tops = ontology(spark, [("1", "1", "NO_RANK"), ("131567", "1", "NO_RANK"), ("2", "131567", "DOMAIN")])
    sinks.write_lineages(spark.createDataFrame([("2", 5)], "tid string, count long"), tops, f"file://{tmp_path}/lineages")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/lineages").collect()] == ["5\tn1\tn2"]


def test_mates_and_accessions(spark, tmp_path):
    for mate in (1, 2):
        (tmp_path / f"m{mate}.fq").write_text("".join(f"@r{k}/{mate}\n{'AC'[mate - 1] * 3}\n+\nIII\n" for k in range(3)))
    pairs = sequence_files.mates(*(sequence_files.fastq(spark, f"file://{tmp_path}/m{m}.fq") for m in (1, 2))).collect()
    assert sorted((r.title, r.mate_title, r.seq, r.mate_seq) for r in pairs) == [(f"r{k}/1", f"r{k}/2", "AAA", "CCC") for k in range(3)]


def test_ranks_names_and_reparenting(spark, tmp_path):
    assert [r[0] for r in spark.createDataFrame([("S",), ("-",), ("x",)], "l string").select(rank_of_letter(F.col("l"))).collect()] == ["SPECIES", "NO_RANK", None]
    assert set(DISPLAY) == set(SCORINGS)
    dump = [("1", "1", "no rank"), ("131567", "1", "no rank"), ("2", "131567", "domain"), ("20", "2", "no rank"), ("21", "20", "clade")]
    (tmp_path / "nodes.dmp").write_text("".join(f"{t}\t|\t{p}\t|\t{r}\t|\tXX\t|\n" for t, p, r in dump))
    (tmp_path / "names.dmp").write_text("".join(f"{t}\t|\tname {t}\t|\t\t|\tscientific name\t|\n" for t, _, _ in dump))
    parents = lambda collapse: {r.tid: r.parent for r in load_ncbi(spark, f"file://{tmp_path}", collapse=collapse).nodes.collect()}
    assert parents(True)["2"] == "1" and parents(False)["2"] == "131567"
    named = {r.tid: r.ranks for r in named_lineage(load_ncbi(spark, f"file://{tmp_path}")).collect()}
    assert named["21"] == {"DOMAIN": "name 2", "taxid_1": "name 1", "taxid_2": "name 20", "taxid_3": "name 21"}


def test_statistics_as_tables_and_attributes(spark):
    reads = spark.createDataFrame([("s", "a", 10, 5.0, False, False), ("s", "1", 20, 7.0, False, False), ("s", None, 30, None, True, False), ("s", None, None, None, False, True)], "sample string, tid string, length long, score double, unclassified boolean, bad boolean")
    got = stats.sample_stats(reads, F.lit(6.0), without="1")
    row = got.first()
    assert (row.seqs_read, row.seqs_filtered, row.ids_filtered, row.mintaxa, row.nt_read) == (3, 0, 0, 0, 60)
    table = {r.statistic: r.s for r in stats.statistics_table(got, ["s"]).collect()}
    assert table["Total nt read"] == 60 and table["Seqs. class."] == 2
    assert stats.chart_attributes(got).first().attributes["sread"] == "3"


def test_running_counts_of_a_stream(spark, tmp_path):
    source = spark.createDataFrame([("s", "a", 1.0), ("s", "a", 2.0), ("t", "b", None)], "sample string, tid string, score double")
    source.write.parquet(str(tmp_path / "in"))
    stream = running_counts(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.sample, r.tid): (r["count"], r.scored, r.total) for r in spark.table("running").collect()} == {("s", "a"): (2, 2, 3.0), ("t", "b"): (1, 0, None)}


def test_a_first_line_lost_as_by_habit_and_ids_chosen_as_by_habit(spark, tmp_path):
    (tmp_path / "a.krk").write_text("C\tr1\t9\t100\t9:30\nC\tr2\t8\t100\t8:30\n")
    ids = lambda parity: sorted(r.tid for r in classified.kraken(spark, f"file://{tmp_path}/a.krk", parity).collect())
    assert ids(False) == ["8", "9"] and ids(True) == ["8"]
    tops = ontology(spark, [("1", "1", "NO_RANK"), ("a", "1", "GENUS"), ("b", "a", "SPECIES"), ("c", "1", "GENUS")])
    chosen = lambda parity: sorted(r.tid for r in tree.selected_ids(tops, [], ["a"], parity).collect())
    assert chosen(False) == ["1", "c"] and chosen(True) == ["1", "b", "c"]
