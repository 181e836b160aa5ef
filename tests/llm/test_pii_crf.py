import hashlib
import itertools
import random
import re

import numpy as np
import pytest

pytest.importorskip("cladeframe.llm")
from cladeframe.llm import pii_crf  # noqa: E402

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def plain(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                found.append((list(PLAIN).index(kind) + 1, m.start(), m.end()))
    return found


def card(rng):
    digits = "".join(rng.choices("0123456789", k=15))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices(["1", "22", "256", ".", "..", "@", "a", "b-c", "_", "+", " ", "-", "(", ")", "é", "\n", "4041894974608795", "255", "é9"], k=rng.randint(0, 25)))
        assert pii_crf.base_spans(text) == plain(text), text
    for text in ("a@b.c@d.e@f.g", "@b.c@d.e", "1.2.3.4.5.6.7.8", "0000000255.1.1.1", "+1 (918) 555-3922x", "4041-8949 7460 8795", "9" * 5000 + ".1.1.1"):
        assert pii_crf.base_spans(text) == (plain(text) if len(text) < 4000 else []), text


@pytest.mark.parametrize("text", ["1" * 2_000_000, "a." * 500_000, "@a" * 500_000, "+1" + " (" * 500_000, "1.2." * 300_000 + "x"])
def test_patterns_take_linear_time(text):
    assert isinstance(pii_crf.base_spans(text), list)


def corpus(rng, n):
    """Texts of made words with one or two mentions each."""
    word = lambda: "".join(rng.choices("aeinorst", k=rng.randint(2, 8)))
    out = []
    for _ in range(n):
        mentions = [f"{word()}.{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), card(rng), f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"]
        words = [word() for _ in range(rng.randint(30, 90))] + rng.sample(mentions, rng.randint(0, 2)) + [str(rng.randint(1, 10**6)) for _ in range(3)]
        rng.shuffle(words)
        out.append(" ".join(words) + ".")
    return out


@pytest.fixture(scope="module")
def field(spark):
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(corpus(random.Random(1), 600))], "doc_id long, text string, spans string")
    return pii_crf.learned(rows)


def test_looser_mentions_are_found_and_look_alikes_are_not(field):
    caught, made_n, wrong, n = 0, 0, 0, 0
    for text in corpus(random.Random(2), 300):
        base = pii_crf.base_spans(text)
        wrong += len(pii_crf.added_spans(field, text, base))
        taught, certain, made = pii_crf.taught(text, base)
        assert [taught[a:b] for _, a, b in certain] == [text[a:b] for _, a, b in base]
        got = pii_crf.added_spans(field, taught, pii_crf.base_spans(taught))
        made_n += len(made)
        caught += sum(any(k == x[0] and x[1] < b and a < x[2] for x in got) for k, a, b in made)
        n += sum(not any(a < x[2] and x[1] < b for _, a, b in made) for x in got)
    assert caught >= 0.9 * made_n and n <= 0.1 * made_n and wrong <= 5


def test_messages_on_a_tree_give_the_exact_chances(field):
    text = "call 918.555.3922 now"
    own = pii_crf.nodes(text, [])
    assert not pii_crf.skips(own)
    alone = field.nodes(own, [])
    total = np.zeros_like(alone)
    for labels in itertools.product(range(5), repeat=len(own.words)):
        score = sum(alone[k, x] for k, x in enumerate(labels)) + sum(field.chain[kind] for i, j, kind in pii_crf.chain(own, text) if labels[i] == labels[j])
        for k, x in enumerate(labels):
            total[k, x] += np.exp(score)
    assert np.allclose(pii_crf.chances(field, own, text), total / total.sum(axis=1, keepdims=True), atol=0.02)


def test_spans_of_odd_documents(spark, field):
    odd = ["Call +1 (918) 555-3922. Again 918.555.3922 x", None, "", "no data here", "word " * 60_000 + "a@b.cd", "é é 1.2.3.4 😀 x@y.zz", "é é 1.2.3.4 😀 x@y.zz"]
    ids = [1, 2, 3, None, 5, 6, 6]
    rows = spark.createDataFrame([(d, t, "s", "k") for d, t in zip(ids, odd)], "doc_id long, text string, spans string, kind string").repartition(3)
    got = sorted(((r.doc_id, [(x.kind, r.text[x.start : x.end], x.added) for x in r.spans]) for r in pii_crf.personal_spans(rows, field).collect()), key=repr)
    twice = (6, [("email", "x@y.zz", False), ("ip", "1.2.3.4", False)])
    want = [(1, [("phone", "+1 (918) 555-3922", False), ("phone", "918.555.3922", True)]), (2, []), (3, []), (None, []), (5, [("email", "a@b.cd", False)]), twice, twice]
    assert got == sorted(want, key=repr)
    assert pii_crf.personal_spans(rows.limit(0), field).count() == 0
    assert pii_crf.learned(rows.limit(0)).shape.shape == (pii_crf.SHAPES, 5)


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.cd and 1.2.3.4"), (2, None)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii_crf.op12_skip_chain_crf(spark, f"file://{tmp_path}").collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 0) and got[1].spans.startswith("email:0:6,ip:11:18")
    assert got[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:11:18").hexdigest() and got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""
