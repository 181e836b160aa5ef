import math
import random
import re

import pytest

pytest.importorskip("cladeframe.llm")
from cladeframe.llm import lexical_search  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, best):
    """All documents scored for each item by the definition."""
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(d, terms(t)) for d, t in docs]
    n_docs, words = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    out = []
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    for item, own in wanted.items():
        df = {t: sum(t in d for _, d in held) for t in own}
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own}
        found = []
        for d, have in held:
            m = 50 + (50 * len(have) * n_docs) // max(words, 1)
            score = sum(w[t] * (10**9 * have.count(t) // (1000 * have.count(t) + 20 * m)) for t in own if t in have)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if void else d, -s) for k, (s, void, d) in enumerate(sorted(found)[:best])]
    return out


def tables(spark, docs, items):
    rows = spark.createDataFrame([(d, t, 1, 2, "x", 3.0) for d, t in docs], "doc_id long, text string, item long, rank int, term string, score double")
    return rows.repartition(3), spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, n long")


@pytest.mark.parametrize("seed", range(2))
def test_ranked_search_equals_plain_scoring(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(40)], k=n))
    docs = [(k, text(rng.randint(1, 30))) for k in range(150)] + [(k, "w0 w1 w1 w30") for k in range(200, 220)]
    docs += [(300, None), (301, ""), (302, "!?"), (None, "w0 w1 w2"), (303, "W0 Éa É\x80 w1_w2"), (304, "w7 " * 3000), (7, "w0 w3 w39"), (7, "w0 w3 w39")]
    items = [(k, text(12)) for k in range(6)] + [(10, "w0 w0 W1"), (11, None), (12, "nothing here"), (13, "Éa w1-w2"), (None, "w5 w6"), (10, "w30")]
    want = sorted(plain(docs, items, 5), key=repr)
    for block_terms in (1000, 7):
        got = lexical_search.ranked(*tables(spark, docs, items), best=5, block_terms=block_terms)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_ranked_search_of_nothing(spark):
    assert lexical_search.ranked(*tables(spark, [], [(1, "a")])).count() == 0
    assert lexical_search.ranked(*tables(spark, [(1, "a")], [])).count() == 0
    assert lexical_search.ranked(*tables(spark, [(1, None)], [(1, "a")])).count() == 0


def test_thresholds_and_bounds_prune_terms(spark):
    items = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 2)], "item int, term int")
    bounds = spark.createDataFrame([(0, 10, 0), (1, 20, 5), (2, 90, 40)], "term int, top long, kth long")
    got = {(r.item, r.term): (r.threshold, r.raises) for r in lexical_search.seeded(items, bounds).collect()}
    assert got == {(0, 0): (40, False), (0, 1): (40, False), (0, 2): (40, True), (1, 2): (40, True)}
