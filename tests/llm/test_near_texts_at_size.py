import random
import time

import pytest

pytest.importorskip("cladeframe.llm")
from cladeframe.llm import _shared, near_texts  # noqa: E402


def counting(monkeypatch, keep=()):
    """Rows of each table that near_texts writes, in lists by name, and the tables named in `keep`."""
    rows, kept = {}, {}

    def counted(df, name, written=near_texts.written):
        found = written(df, name)
        rows.setdefault(name, []).append(found.count())
        if name in keep:
            kept[name] = found
        return found

    monkeypatch.setattr(near_texts, "written", counted)
    return rows, kept


def test_the_sample_grows_with_the_texts():
    steps = [near_texts.sample_step(n, near_texts.HOT) for n in (0, 1, 10_000, 51_000, 256_000, 3_000_000, 10**9)]
    assert steps == [1, 1, 1, 6, 8, 8, 8]  # a shingle of more than HOT texts is in LEAST_COMMON of the sample


def test_repeated_lines_stay_rare_in_prefixes_however_many_texts(spark, monkeypatch):
    # Lines that each stand in 100 of 400 texts: a sample of four texts knows none of them, and all their texts go to cells.
    rng = random.Random(21)
    lines = [[f"l{k}w{i}" for i in range(30)] for k in range(4)]
    texts = [[*lines[k % 4], *(f"s{rng.randint(0, 10**9)}" for _ in range(90))] for k in range(400)]
    texts += [[*x[:100], "other", *x[101:]] for x in texts[:20]]
    monkeypatch.setattr(near_texts, "SAMPLE", 4)
    rows, kept = counting(monkeypatch, ("near-pairs",))
    table = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_texts.similar_groups(table).collect()}
    assert got == dict(enumerate([*range(400), *range(20)]))
    assert kept["near-pairs"].filter("key is not null").count() == 0 and "near-marked" not in rows


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = {found.apply(k).getName() for k in range(found.size())}
        return {x for x in names if x.startswith("shuffle_")}

    rows = spark.range(200_000).selectExpr("id % 70001 as k").groupBy("k").count().repartition(3, "count", "k")
    before = files()
    freed = _shared.written(rows, "freed")
    until = time.time() + 10
    while (left := files() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert freed.count() == rows.count() == rows.agg({"k": "count"}).first()[0] == 70001
