import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("cladeframe.llm")
import corpus_pipeline  # noqa: E402
from cladeframe.llm import gray_index, language_id, packing, token_counts, toxicity  # noqa: E402

ODD = ["Ünï cödé, два слова 漢字", "", "12 34", "a", "Ab--ba\n\nBa", "x y z", "é" * 50]


def grams(text):
    """The feature numbers of a text by order, place by place."""
    chars, before = [], False
    for c in text.lower() + "\n":
        if c.isalpha():
            chars.append(ord(c))
        elif before:
            chars.append(32)
        before = c.isalpha()
    if not text or not text.lower()[-1].isalpha():
        chars.append(32)
    out = []
    for order in language_id.ORDERS:
        own = []
        for k in range(len(chars) - order + 1):
            h = order
            for j in range(order):
                h = (h + chars[k + j] * int(language_id._FACTORS[j])) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
            own.append(h >> 17)
        out.append(own)
    return out


def test_language_scores_equal_plain_sums():
    rng = np.random.default_rng(1)
    weights = np.vstack([rng.normal(size=(language_id.FEATURES, 3)), np.zeros((1, 3))]).astype(np.float32)
    model = language_id.LanguageModel(["de", "en", "fr"], weights, np.array([0.1, -0.2, 0.0]))
    names, scores = model.predict(ODD)
    for text, name, score in zip(ODD, names, scores):
        logits = np.array([0.1, -0.2, 0.0])
        for own in grams(text):
            if own:
                logits = logits + np.mean([weights[g] for g in own], axis=0)
        p = np.exp(logits - logits.max())
        p /= p.sum()
        if any(map(str.isalpha, text)):
            assert name == model.langs[int(p.argmax())] and math.isclose(score, p.max(), abs_tol=1e-5)
        else:
            assert (name, score) == ("und", 0.0)


def test_leader_equals_its_plain_rule():
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), np.array(sorted(rng.sample(range(6), 3))), np.array([rng.random() for _ in range(3)])) for _ in range(30)]
    got = language_id.ftrl(rows, 2, epochs=2)
    z, n = {}, {}

    def weight(i, c):
        zi, ni = z.get((i, c), 0.0), n.get((i, c), 0.0)
        if abs(zi) <= language_id.L1:
            return 0.0
        return -(zi - math.copysign(language_id.L1, zi)) / ((language_id.BETA + math.sqrt(ni)) / language_id.ALPHA + language_id.L2)

    for _ in range(2):
        for label, at, values in rows:
            items = [*zip(at.tolist(), values.tolist()), (language_id.FEATURES, 1.0)]
            logits = [sum(v * weight(i, c) for i, v in items) for c in (0, 1)]
            e = [math.exp(x - max(logits)) for x in logits]
            old = {(i, c): weight(i, c) for i, _ in items for c in (0, 1)}
            for i, v in items:
                for c in (0, 1):
                    g = v * (e[c] / sum(e) - (c == label))
                    was = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / language_id.ALPHA * old[i, c]
                    n[i, c] = was + g * g
    for i in [*range(6), language_id.FEATURES]:
        assert np.allclose(got[i], [weight(i, 0), weight(i, 1)], atol=1e-9)


def maximal(scores, first=0):
    """All maximal scoring segments by the recursive definition: the best one (of equal ones the shortest), then what is left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    a, b = -best[2], -best[2] - best[1]
    return maximal(scores[:a], first) + [(round(best[0], 9), first + a, first + b - 1)] + maximal(scores[b:], first + b)


def test_segments_equal_the_recursive_definition():
    rng = random.Random(3)
    for _ in range(300):
        scores = np.array([rng.choice([-1.37, -0.51, 0.73, 1.19, 2.03]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 25))])
        got = [(round(s, 9), a, b) for s, a, b in toxicity.segments(scores, np.flatnonzero(scores > 0))]
        assert [x[1:] for x in got] == [x[1:] for x in maximal(scores.tolist())]


def test_decay_and_odds_by_their_equations():
    rng = np.random.default_rng(4)
    for _ in range(20):
        scores, shares = np.r_[rng.uniform(0.5, 3, 3), -1.0], np.r_[rng.uniform(0.001, 0.05, 3), 0]
        shares[-1] = 1 - shares.sum()
        decay = toxicity.decay_of(scores, shares)
        assert math.isclose(sum(p * math.exp(decay * s) for p, s in zip(shares, scores)), 1.0, rel_tol=1e-6)
    odds, z = toxicity.log_odds(np.array([5.0]), np.array([2.0]), np.array([0.01]), 100.0, 400.0)
    prior = toxicity.PRIOR_WORDS * 0.01 + toxicity.PRIOR_FLOOR
    want = math.log((5 + prior) / (100 + toxicity.PRIOR_WORDS - 5)) - math.log((2 + prior) / (400 + toxicity.PRIOR_WORDS - 2))
    assert math.isclose(odds[0], want) and math.isclose(z[0], want / math.sqrt(1 / (5 + prior) + 1 / (2 + prior)))


def test_stages_equal_plain_versions(spark, tmp_path):
    rng = random.Random(5)
    syllables = {"en": ["the", "ing", "wh", "ea", "ly", "ou"], "de": ["ü", "sch", "ei", "ß", "ung", "ä"]}
    words = {x: ["".join(rng.choices(y, k=rng.randint(2, 4))) for _ in range(150)] for x, y in syllables.items()}
    text = lambda lang, toxic: " ".join(rng.choices(words[lang], k=40) + (["vilest", "scumbag", "vermin"] * 2 if toxic else []))
    rows = [(k, text(lang, k % 5 == 0), lang, "s", 1) for k in range(1200) for lang in [rng.choice(["en", "de"])]]
    rows += [(4000, None, "en", "s", 1), (4001, "12 34", None, "s", 1), (None, "theing wheaing", None, "s", 1), (7,  "theing wheaing", "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(1200)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    kept = corpus_pipeline.known_language(spark, docs, f"file://{tmp_path}")
    model = language_id.train(docs)
    plain = [r for r in rows if (lambda n, s: n[0] != "und" and s[0] >= corpus_pipeline.LEAST_LANGUAGE_SCORE)(*model.predict([r[1] or ""]))]
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted(plain, key=repr)
    clean = corpus_pipeline.not_toxic(spark, docs, f"file://{tmp_path}")
    scores = {(r.doc_id, r.text): r.toxicity for r in toxicity.toxicity(docs.select("doc_id", "text"), toxicity.train(docs, spark.read.parquet(f"file://{tmp_path}/labels.parquet"))).collect()}
    assert sorted(map(tuple, clean.collect()), key=repr) == sorted((r for r in rows if scores[r[:2]] < toxicity.THRESHOLD), key=repr)
    left = {r.doc_id for r in clean.collect()}
    assert sum(k % 5 == 0 for k in left if k is not None and k < 1200) <= 12 and sum(k % 5 > 0 for k in left if k is not None and k < 1200) >= 940
    packed = corpus_pipeline.packed(spark, docs, "").groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(packed) == len({r[0] for r in rows})


def test_repeated_and_null_ids_keep_their_rows(spark, tmp_path):
    rows = [(1, "one text here"), (1, "another text"), (None, "no id"), (None, None), (2, "one text here")]
    docs = spark.createDataFrame([(*r, "en", 5) for r in rows], "doc_id long, text string, lang string, n_tokens long")
    assert token_counts.count_tokens(docs, f"file://{tmp_path}/cache").count() == 5
    assert gray_index.near_groups(docs).count() == 5
    assert language_id.identify(docs, language_id.train(docs)).count() == 5
    assert {r.doc_id for r in packing.pack(docs).collect()} == {1, 2, None}


def test_short_labelled_texts_all_teach(spark):
    rows = [(k, float(k % 2), f"w{k} v") for k in range(20)] + [(20, 1.0, "w1 v"), (21, 0.0, "w1 v")]
    got = toxicity.one_of_copies(spark.createDataFrame(rows, "doc_id long, toxic double, text string")).collect()
    assert sorted(r.x.doc_id for r in got) == [*range(20), 21]
