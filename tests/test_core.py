import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cladeframe.functions.ranks import RANK_VALUES, at_or_below, below
from cladeframe.functions.scores import auto_mintaxa
from cladeframe.ontology import Ontology, inversions
from cladeframe.operators import cross, sequences, tree
from cladeframe.plans import catalog
from cladeframe.sources import classified, sequence_files, sinks

SF = "/root/testdata/sf0.001"
NODES = [("1", "1", "NO_RANK"), ("2", "1", "DOMAIN"), ("100", "2", "FAMILY"), ("110", "100", "GENUS"), ("115", "110", "NO_RANK"), ("111", "115", "SPECIES"), ("112", "110", "SPECIES"), ("1121", "112", "SUBSPECIES"), ("11211", "1121", "STRAIN"), ("113", "110", "STRAIN"), ("999", "888", "SPECIES")]


def ontology(spark, nodes=NODES, **options):
    return Ontology(spark.createDataFrame([(t, p, r, RANK_VALUES[r], f"n{t}") for t, p, r in nodes], "tid string, parent string, rank string, rank_value int, name string"), **options)


def counts(spark, rows):
    return spark.createDataFrame([(s, t, n, n, float(n * x)) for s, t, n, x in rows], "sample string, tid string, count long, scored long, total double")


@pytest.mark.parametrize("name", ["rollup_acc", "fold_mintaxa", "exclusive", "shared", "contaminant_label", "header_expand", "balanced_split"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer orders lineitem documents".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(con.execute(f"select {', '.join(names)} from ({catalog.SQL[name]})").fetchall())


def test_ranks_are_a_partial_order(spark):
    rows = spark.createDataFrame([(-1, -1), (0, 58), (58, 58), (56, 58), (66, 58)], "a int, b int")
    assert [tuple(r) for r in rows.select(at_or_below(F.col("a"), F.col("b")), below(F.col("a"), F.col("b"))).collect()] == [(False, False), (False, False), (True, False), (True, True), (False, False)]


def test_closure_by_chain_and_by_doubling(spark):
    both = [sorted(map(tuple, ontology(spark, depth=d).closure().collect())) for d in (None, 8)]
    assert both[0] == both[1]
    assert ("11211", "1", 6) in both[0] and [x for x in both[0] if x[0] == "999"] == [("999", "999", 0)]


def literal(nodes, counted, m, rank=None):
    """The tree by recursion: node -> (acc, count)."""
    kids, ranks = {}, {t: RANK_VALUES[r] for t, p, r in nodes}
    for t, p, _ in nodes:
        if t != p:
            kids.setdefault(p, []).append(t)
    out = {}
    le = lambda a, b: a > 0 and b > 0 and a <= b
    lt = lambda a, b: a > 0 and b > 0 and a < b

    def go(t, above):
        rank_t = 99 if t == "1" else ranks[t]
        count = counted.get(t, 0) if rank is None or le(rank_t, rank) or le(above, rank) else 0
        acc = count
        for k in kids.get(t, []):
            a, c = go(k, rank_t if ranks[t] != -1 or t == "1" else above)
            prune_rank = rank is not None and (lt(ranks[k], rank) or le(rank_t, rank) or le(above, rank))
            if a < m or prune_rank:
                if a and (rank is None or prune_rank and (rank_t == rank or le(above, rank))):
                    acc, count = acc + a, count + c
            else:
                acc += a
                out[k] = (a, c)
        return acc, count

    out["1"] = go("1", 99)
    return {t: x for t, x in out.items() if x[0]}


@pytest.mark.parametrize("seed", range(3))
def test_closed_forms_equal_recursion(spark, seed):
    random.seed(seed)
    order = ["DOMAIN", "FAMILY", "GENUS", "SPECIES", "STRAIN"]
    nodes, level = [("1", "1", "NO_RANK")], {"1": -1}
    for k in range(2, 40):
        parent = random.choice([t for t, _, _ in nodes if level[t] < 4])
        rank = random.randint(level[parent] + 1, 4)
        loose = random.random() < 0.2
        nodes.append((str(k), parent, "NO_RANK" if loose else order[rank]))
        level[str(k)] = level[parent] if loose else rank
    counted = {t: random.randint(1, 6) for t, _, _ in nodes if random.random() < 0.6}
    tops = ontology(spark, nodes)
    assert inversions(tops).isEmpty()
    rows = counts(spark, [("s", t, n, 1) for t, n in counted.items()])
    got = {r.tid: (r.acc, r["count"]) for r in tree.rollup(rows, tops, 4).collect() if r.acc}
    assert got == literal(nodes, counted, 4)
    got = {r.tid: (r.acc, r["count"]) for r in tree.at_rank(rows, tops, RANK_VALUES["GENUS"], 3).collect() if r.acc}
    assert got == literal(nodes, counted, 3, RANK_VALUES["GENUS"])
    got = {r.tid: (r.acc, r["count"]) for r in tree.exact_tree(rows, tops, 3, RANK_VALUES["GENUS"], just_rank=True).collect() if r.acc}
    assert got == literal(nodes, counted, 3, RANK_VALUES["GENUS"])


def test_all_six_labels(spark):
    freq = {"just-ctrl": ([0.002] * 3, [0.0] * 3), "critical": ([0.02] * 3, [0.01] * 3), "severe": ([0.02, 0, 0], [0.1] * 3), "mild": ([0.002] * 3, [0.1] * 3), "crossover": ([1e-6, 0, 0], [0.2, 1e-6, 0]), "other": ([1e-4, 0, 0], [1e-4] * 3)}
    rows = [(label, f"{'c' if k < 3 else 's'}{k}", k, k < 3, x) for label, (c, s) in freq.items() for k, x in enumerate([*c, *s])]
    df = spark.createDataFrame([(t, s, k, c, float(x)) for t, s, k, c, x in rows], "tid string, sample string, ord int, is_ctrl boolean, freq double")
    got = {r.tid: (r.label, r.sources) for r in cross.contaminants(df).collect()}
    assert {t: x[0] for t, x in got.items()} == {t: t for t in freq} and got["crossover"][1] == ["s3"]


def test_half_to_even_mintaxa(spark):
    assert [r[0] for r in spark.createDataFrame([(0,), (3,), (1000,), (3163,)], "n long").select(auto_mintaxa(F.col("n"))).collect()] == [1, 0, 3, 4]


def test_readers(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    show = lambda df: {tuple(r) for r in df.select("tid", "length", "score", "unclassified", "bad").collect()}
    rows = show(classified.centrifuge(spark, file("a.out", "readID\ts\tt\tsc\t2\thl\tql\tn\nr1\tx\t9606\t4225\t0\t80\t200\t1\nr2\tu\t0\t0\t0\t0\t150\t1\nbroken\n")))
    assert rows == {("9606", 200, 80.0, False, False), (None, 150, None, True, False), (None, None, None, False, True)}
    rows = show(classified.kraken(spark, file("b.krk", "C\tr1\tHomo (taxid 9606)\t100|101\t9606:30 1:10 |:| 9606:20\nU\tr2\t0\t90\t0:50\nC\tr3\t5\t10\t\n")))
    assert rows == {("9606", 201, 85.0, False, False), (None, 90, None, True, False), (None, None, None, False, True)}
    rows = show(classified.clark(spark, file("c.csv", "h\nr1,100,0.5,7,20,8,3,0.9\nr2,90,0.1,NA,0,8,3,0.4\nr3,80,0,NA,0,NA,0,0\n")))
    assert rows == {("7", 100, 51.0, False, False), ("8", 90, 34.0, False, False), (None, 80, None, True, False)}
    rows = show(classified.lmat(spark, file("d_output.out", "t\tACGT\t1 1 2\t9 0.5\t9 0.7 DirectMatch\nt\tAC\t1 1 2\t\t0 0 NoDbHits\nend\nt\tACGT\t1 1 2\t9 0.5\t9 0.7 MultiMatch\n")))
    assert rows == {("9", 4, 0.7, False, False), (None, 2, None, True, False)}
    form = classified.GenericFormat.parsed("TYP:csv,TID:2,LEN:3,SCO:1,UNC:0")
    assert show(classified.generic(spark, file("e.csv", "score,tid,len\n3.5,\"7\",10\n0,0,12\nx,y,z\n"), form)) == {("7", 10, 3.5, False, False), (None, 12, None, True, False), (None, None, None, False, True)}
    assert show(classified.go(spark, file("f.out", "h\n1\tg\tGO:1\t50\t1e-10\n1\tg\tGO:2\t60\t0\n"))) == {("GO:1", 50, 10.0, False, False), ("GO:2", 60, 308.0, False, False)}
    with pytest.raises(ValueError):
        classified.GenericFormat.parsed("TYP:csv,TID:1,LEN:1,SCO:2,UNC:0")


def test_sequence_files(spark, tmp_path):
    (tmp_path / "x.fq").write_text("".join(f"@r{k}/1 more\nACGT\n+\n@@@@\n" for k in range(5)))
    records = sequence_files.fastq(spark, str(tmp_path / "x.fq"))
    assert sorted((r.record, r.title, r.qual) for r in records.collect())[4] == (4, "r4/1 more", "@@@@")
    wanted = spark.createDataFrame([("r1",), ("r3",), ("r3",)], "read_id string")
    assert [r.record for r in sequences.matched_records(records, wanted).orderBy("record").collect()] == [1, 3]
    assert sequences.matched_records(records, wanted, maxreads=3).count() == 1 and sequences.matched_records(records, wanted, limit=1).first().record == 1
    (tmp_path / "x.fa").write_text(">a one\nAC\nGT\n>b two\nAAAA\n")
    assert [(r.title, r.seq) for r in sequence_files.fasta(spark, str(tmp_path / "x.fa")).orderBy("record").collect()] == [("a one", "ACGT"), ("b two", "AAAA")]


def test_greedy_split_takes_the_last_of_equal_files(spark):
    rows = spark.createDataFrame([(0, "AAA"), (1, "A"), (2, "A"), (3, "A"), (4, "A")], "record long, seq string")
    assert [r.file for r in sequences.greedy_split(rows, 2).orderBy("record").collect()] == [1, 0, 0, 0, 1]


def test_sparse_codec_round_trip():
    for values in (["0"] * 9 + ["5"], ["1", "2", "3"], ["0", "0"], []):
        sparse, text = sinks.encoded(values)
        assert sinks.decoded(sparse, text, len(values)) == values
    assert sinks.encoded(["0"] * 9 + ["5"]) == (True, "9:5")


def test_cross_analysis_of_nothing_and_of_two(spark):
    tops = ontology(spark)
    rows = counts(spark, [("c", "111", 5, 2.0), ("s", "111", 7, 4.0), ("s", "112", 4, 1.0)])
    fact = tree.rollup(rows, tops, 1)
    samples = spark.createDataFrame([("c", 0, True, 1), ("s", 1, False, 1)], "sample string, ord int, is_ctrl boolean, mintaxa int")
    got = {(r.kind, r.raw_sample, r.tid): r["count"] for r in cross.cross_analysis(rows, fact, samples, tops, ["SPECIES"]).collect() if r["count"]}
    assert got == {("EXCLUSIVE", "s", "112"): 4, ("SHARED", None, "111"): 6, ("CTRL", "s", "112"): 4, ("CONTROL_SHARED", None, "112"): 4}


def test_scorings_fall_back_as_each_reader_has_it():
    from cladeframe.functions.scores import checked_scoring

    assert [checked_scoring("kraken", x) for x in (None, "LMAT", "NORMA")] == ["SHEL", "KRAKEN", "NORMA"]
    assert [checked_scoring("generic", x) for x in (None, "NORMA", "SHEL")] == ["GENERIC", "NORMA", "GENERIC"]
    assert [checked_scoring("lmat", x) for x in ("LENGTH", "LMAT")] == ["LMAT", "LMAT"]
    assert checked_scoring("clark", "KRAKEN") == checked_scoring("centrifuge", "LMAT") == "SHEL"
    with pytest.raises(ValueError):
        checked_scoring("go", "no such")


def test_generic_files_abort_by_short_lines_and_by_half_of_the_good_ones(spark, tmp_path):
    from cladeframe.sources.classified import GenericFormat, generic

    form = GenericFormat.parsed("TYP:csv,TID:1,LEN:2,SCO:3,UNC:0")
    good = ["tid,len,score"] + [f"{k},10,1.5" for k in range(1, 121)]
    for name, lines, fails in (("a", good, False), ("b", good + ["x,y,z"] * 60, False), ("c", good + ["x,y,z"] * 61, True), ("d", good + ["1,2"], True), ("e", ["header", *good[1:]], False)):
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
        path = f"file://{tmp_path}/{name}.csv"
        if fails:
            with pytest.raises(ValueError):
                generic(spark, path, form)
        else:
            assert generic(spark, path, form).filter("not bad").count() == 120


def test_listed_ids_by_depth_and_rank(spark):
    from cladeframe.ontology import Ontology
    from cladeframe.operators.tree import listed_ids

    rows = [("1", "1", "ROOT", 99), ("a", "1", "GENUS", 66), ("b", "a", "SPECIES", 58), ("c", "b", "STRAIN", 50), ("d", "1", "SPECIES", 58), ("lost", "no", "SPECIES", 58)]
    tops = Ontology(spark.createDataFrame([(*r, r[0]) for r in rows], "tid string, parent string, rank string, rank_value int, name string"))
    ids = lambda **o: sorted(r.tid for r in listed_ids(tops, **o).collect())
    assert ids() == ["1", "a", "b", "c", "d"] and ids(mindepth=3) == ["b", "c"] and ids(maxdepth=3) == ["1", "a", "d"] and ids(maxdepth=1) == []
    assert ids(just_rank="SPECIES") == ["b", "d"] and ids(include=["a"], exclude=["c"]) == ["a", "b"]


def test_one_call_from_files_to_tables(spark, tmp_path):
    import pytest

    from cladeframe import analysis
    from cladeframe.ontology import Ontology

    nodes = [(t, p, r, RANK_VALUES[r]) for t, p, r in (("1", "1", "ROOT"), ("g", "1", "GENUS"), ("a", "g", "SPECIES"), ("b", "g", "SPECIES"))]
    tops = Ontology(spark.createDataFrame([(*x, x[0]) for x in nodes], "tid string, parent string, rank string, rank_value int, name string"))
    for name, found in (("c1", "aaa0"), ("s1", "aaaabbbbb"), ("s2", "bbbbbb"), ("void", "0")):
        lines = ["h"] + [f"r{k}\ts\t{t}\t100\t0\t60\t90\t1" for k, t in enumerate(found)]
        (tmp_path / f"{name}.out").write_text("\n".join(lines))
    paths = [f"file://{tmp_path}/{n}.out" for n in ("c1", "s1", "s2", "void")]
    with pytest.warns(UserWarning, match="void"):
        got = analysis.analyse(spark, "centrifuge", paths, tops, controls=1, mintaxa=2, control_mintaxa=2, ranks=["SPECIES"])
    assert {(r.sample, r.tid): r.acc for r in got.trees.collect() if r.tid in "ab1"} == {("c1", "a"): 3, ("c1", "1"): 3, ("s1", "a"): 4, ("s1", "b"): 5, ("s1", "1"): 9, ("s2", "b"): 6, ("s2", "1"): 6}
    ctrl = {(r.raw_sample, r.tid): r["count"] for r in got.derived.filter("kind = 'CTRL' and count > 0").collect()}
    assert ctrl == {("s1", "b"): 5, ("s2", "b"): 6}
    assert {(r.raw_sample, r.tid): r["count"] for r in got.summaries.filter("kind = 'CTRL' and count > 0").collect()} == ctrl
    assert all(abs(r.score - 25.0) < 1e-9 for r in got.trees.collect())
    with pytest.raises(ValueError, match="controls without reads"):
        analysis.analyse(spark, "centrifuge", [paths[3], paths[1]], tops, controls=1)
