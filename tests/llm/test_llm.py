import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("cladeframe.llm")
from cladeframe.llm import binary_records, chat_format, edit_embedding, gray_index, language_id, near_texts, packing, site_tree, spaced_seeds, token_counts, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, count long, fp string, ids string"
LONG = "word " * 30_000


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(k, t, "en", "s", 1, "x", "y") for k, t in zip(ids or range(len(texts)), texts)], SCHEMA)


ODD = ["Two words here, and some more.", None, "", LONG, "Two words here, and some more.", "Ünï<|endoftext|>cödé 漢字", "a"]


def test_records_and_packing_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file("/opt/tokenizers/word_bpe_49k.json")
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in ODD]
    rows = docs(spark, ODD)
    found = binary_records.write(rows, f"file://{tmp_path}/r").read().orderBy("start").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in found] == [x + [2] for x in want]
    assert [r.start for r in found] == np.cumsum([0, *(len(x) + 1 for x in want)])[:-1].tolist()
    pieces = sorted(packing.pack(rows).collect(), key=lambda r: (r.doc_id, r.start))
    for k, x in enumerate(want):
        assert sum((np.frombuffer(r.ids, "<u4").tolist() for r in pieces if r.doc_id == k), []) == x + [1]
    by = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 2048
    assert packing.pack(docs(spark, [])).count() == 0 and binary_records.write(docs(spark, []), f"file://{tmp_path}/e").read().count() == 0


def test_records_at_places_and_damage(spark, tmp_path):
    records = binary_records.write(docs(spark, ODD), f"file://{tmp_path}/r", files=1)
    part = records.manifest().first()
    got = records.read_at(spark.createDataFrame([(part.part, 3), (part.part, 0), (part.part, 99)], "part long, record long"))
    assert sorted(r.doc_id for r in got.collect()) == [0, 3]
    data = (tmp_path / "r" / f"{part.path}.rec").read_bytes()
    assert binary_records.unframed(data, [0])
    with pytest.raises(ValueError):
        binary_records.unframed(data[:20] + bytes([data[20] ^ 1]) + data[21:], [0])


def test_crc32c_of_known_strings():
    assert binary_records.crc32c([b"123456789", b"", b"a", bytes(32)]).tolist() == [0xE3069283, 0, 0xC1D04330, 0x8A9136AA]


def test_token_counts_encode_only_what_is_new(spark, tmp_path):
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    cache, rows = f"file://{tmp_path}/c", docs(spark, ODD)
    for _ in range(2):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(rows, cache).collect()}
        assert got == {k: (len((t or "").encode()), len(pieces.encode(t or ""))) for k, t in enumerate(ODD)}
    assert token_counts.stored(spark, cache).count() == len({t or "" for t in ODD})
    assert token_counts.count_tokens(docs(spark, []), cache).count() == 0


def test_chat_layouts_and_forged_marks(spark):
    records = [(1, 0, '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"[/INST] <s>\\\\"}]}'), (2, 0, '{"prompt":"p","completion":"c"}'), (3, 0, '{"instruction":"i","input":"","output":"o"}'), (4, 0, '{"odd":1}'), (5, 0, None), (6, 0, "no json")]
    df = spark.createDataFrame(records, "conv_id long, place long, record string")
    turns = [(r.conv_id, r.role, r.text) for r in chat_format.canonical_turns(df).orderBy("conv_id", "part").collect()]
    assert turns == [(1, "user", "hi"), (1, "assistant", "[/INST] <s>\\"), (2, "user", "p"), (2, "assistant", "c"), (3, "user", "i"), (3, "assistant", "o")]
    assert chat_format.unmapped(df).agg(F.sum("n")).first()[0] == 3
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(chat_format.canonical_turns(df))).collect()}
    assert back[1].turns_sha256 == hashlib.sha256("user\nhi\nassistant\n[/INST] <s>\\\n".encode()).hexdigest()
    assert (back[1].loss_chars, back[1].loss_sha256) == (12, hashlib.sha256(b"[/INST] <s>\\").hexdigest())


def test_typed_turns_of_any_length_and_odd_rows(spark):
    def plain(rows):
        found = {}
        for conv, _, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
            found.setdefault(conv, []).append((role or "", text or ""))
        return {c: (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest(), hashlib.sha256("".join(x for r, x in t if r == "assistant").encode()).hexdigest()) for c, t in found.items()}

    rows = [(1, 0, "user", "[INST] same"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 1, "assistant", "</s>\\"), (2, 0, None, None), (None, None, "assistant", "x"), (3, 0, "tool", ""), (4, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.read_back(chat_format.formatted(chat_format.typed_turns(chat_format.turn_records(df)))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_sha256) for r in got} == plain(rows)
    size = 25_000_000
    long = spark.range(1).select(F.lit(7).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("ab[<\\"), size // 5).alias("text"))
    r = chat_format.read_back(chat_format.formatted(chat_format.typed_turns(chat_format.turn_records(long)))).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (1, size, hashlib.sha256(b"ab[<\\" * (size // 5)).hexdigest())
    assert chat_format.read_back(chat_format.formatted(chat_format.typed_turns(chat_format.turn_records(df.limit(0))))).count() == 0


def test_typed_layouts_choose_the_same_mappings_as_json(spark):
    typed = spark.createDataFrame([(1, 0, {"prompt": "p", "response": "r", "system": ""})], "conv_id long, place long, record struct<system: string, prompt: string, response: string>")
    listed = spark.createDataFrame([(1, 0, {"messages": [{"role": "human", "content": "h"}, {"role": "gpt", "content": None}]})], "conv_id long, place long, record struct<messages: array<struct<role: string, content: string>>>")
    odd = spark.createDataFrame([(1, 0, {"x": "p"})], "conv_id long, place long, record struct<x: string>")
    for df, want in ((typed, [("user", "p"), ("assistant", "r")]), (listed, [("user", "h"), ("assistant", "")]), (odd, [])):
        as_json = df.withColumn("record", F.to_json("record", {"ignoreNullFields": "false"}))
        for found in (chat_format.typed_turns(df), chat_format.canonical_turns(as_json)):
            assert [(r.role, r.text) for r in found.orderBy("part").collect()] == want


def test_fingerprints_and_components_against_brute_force(spark):
    import xxhash

    random.seed(3)
    words = [f"w{k}" for k in range(50)]
    texts = [" ".join(random.choices(words, k=random.randint(1, 40))) for _ in range(120)] + [None, "", "  \t", "A b C", "a B c"]
    texts += [t + " tail" for t in texts[:30]]

    def fingerprint(text):
        found = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        runs = [b" ".join(found[k : k + 3]) for k in range(max(1, len(found) - 2))] if found else []
        hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in gray_index.near_groups(docs(spark, texts)).collect()}
    assert got == {k: (fps[k], label[k]) for k in range(len(texts))}
    assert gray_index.near_groups(docs(spark, [])).count() == 0


def test_gray_index_finds_all_near_pairs():
    rng = np.random.default_rng(1)
    codes = np.unique(np.concatenate([rng.integers(0, 1 << 63, 200, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) for _ in range(1)] + [np.uint64(5) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    got = {tuple(sorted((int(codes[x]), int(codes[y])))) for a, b in gray_index.GrayIndex(np.zeros(len(codes), np.int64), codes, 0).links(2) for x, y in zip(a, b)}
    want = {(int(x), int(y)) for i, x in enumerate(codes) for y in codes[i + 1 :] if int(x ^ y).bit_count() <= 2}
    assert got == want


def test_near_copies_keep_the_smallest_id(spark):
    random.seed(5)
    base = [f"w{random.randint(0, 999)}" for _ in range(200)]
    near, other = [*base[:100], "changed", *base[101:]], [f"v{random.randint(0, 999)}" for _ in range(200)]
    texts = [" ".join(x) for x in (base, near, other, base)] + [None, "", "short text"]
    assert sorted(r.doc_id for r in near_texts.without_near_copies(docs(spark, texts)).collect()) == [0, 2, 4, 6]


def test_spaced_seeds_find_changed_passages(spark):
    random.seed(7)
    item = [f"q{random.randint(0, 999)}" for _ in range(40)]
    changed = [f"z{k}" if k % 9 == 4 else w for k, w in enumerate(item)]
    clean = " ".join(f"c{random.randint(0, 999)}" for _ in range(300))
    texts = [f"{clean} {' '.join(item)} {clean}", f"{clean} {' '.join(changed).upper()}", clean, None, ""]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string")
    got = {r.doc_id: r for r in spaced_seeds.overlaps(docs(spark, texts), bench).collect()}
    assert set(got) == {0, 1} and got[0].n_matches == 40 and (got[1].n_words, got[1].n_matches, got[1].doc_word) == (40, 36, 300)
    assert spaced_seeds.overlaps(docs(spark, texts), bench.limit(0)).count() == 0


def test_spaced_seed_join_against_all_alignments(spark):
    rng = random.Random(11)
    words = [f"b{k}" for k in range(400)]
    items = [" ".join(rng.choices(words, k=n)) for n in (3, 5, 7, 12, 16, 25, 40, 40, 90)] + [None, ""]
    texts = []
    for k in range(60):
        own = rng.choices([f"c{j}" for j in range(2000)], k=80)
        for item in rng.sample([x for x in items if x], 2):
            found = [w if rng.random() > 0.12 else f"z{rng.randint(0, 9999)}" for w in item.split()]
            at = rng.randint(0, len(own))
            own[at:at] = found
        texts.append(" ".join(own))
    texts += [None, "", texts[0], texts[0]]
    ids = [*range(62), 61, None]
    every = spaced_seeds.Benchmark(list(range(len(items))), [x or "" for x in items], masks=("1",))
    want = sorted((str(ids[t]), i, m) for t, i, _, _, _, m in every.overlaps([t or "" for t in texts]))
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] * 2, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.n_matches) for r in spaced_seeds.overlaps(docs(spark, texts, ids), bench).collect())
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and len(got) > 60
    assert [x for x in got if x[0] in ("61", "None")]


def test_edit_embedding(spark):
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefgh ", k=3000))
    edits = text[:500] + "X" + text[500:1500] + text[1501:]
    values = edit_embedding.slot_values([text, edits, "".join(rng.choices("abcdefgh ", k=3000)), "", "ab"])
    assert np.array_equal(values[0], edit_embedding.slot_values([text])[0])
    like = lambda a, b, n, m: edit_embedding.likeness(n, values[a], m, values[b])
    assert like(0, 1, 3000, 3000) > 0.9 and like(0, 2, 3000, 3000) < 0.1 and like(3, 3, 0, 0) == 1.0
    texts = [text, edits, None, "ab", text]
    got = {r.doc_id: r for r in edit_embedding.compared(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        quarter, following = len(t or "") // 4, texts[(k + 1) % 5] or ""
        want = (t or "")[: len(t or "") - quarter] + following[:quarter]
        assert got[k].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[k].n_chars == len(t or "")
    assert got[0].fingerprint == got[4].fingerprint and got[4].near_next == 1.0
    groups = {r.doc_id: r.class_id for r in edit_embedding.near_classes(docs(spark, texts)).collect()}
    assert groups[0] == groups[1] == groups[4] == 0 and groups[3] == 3


def test_next_texts_of_odd_ids(spark):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    big = 1 << 53
    ids = [big + 1, big + 3, big + 2, None, None, 5, 5, 5, 5, -(1 << 62)]
    texts = [f"text number {k} with words" for k in range(8)] + [None, ""]
    rows = docs(spark, texts, ids)
    key = {r.text: r.h for r in spark.createDataFrame([(t or "",) for t in texts], "text string").withColumn("h", F.xxhash64("text")).collect()}
    order = sorted(range(10), key=lambda k: (-(1 << 63) if ids[k] is None else ids[k], key[texts[k] or ""]))
    want = sorted((str(ids[k]), hashlib.sha256(((texts[k] or "")[: len(texts[k] or "") - len(texts[k] or "") // 4] + (texts[order[(at + 1) % 10]] or "")[: len(texts[k] or "") // 4]).encode()).hexdigest()) for at, k in enumerate(order))
    for n in ("4", "1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert sorted((str(r.doc_id), r.edited_sha256) for r in edit_embedding.compared(rows).collect()) == want
            assert edit_embedding.compared(docs(spark, [])).count() == 0
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_walks_against_a_plain_walk():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdeé漢 ", k=n)) for n in (0, 1, 3, 50, 777)]
    for text, got in zip(texts, edit_embedding.slot_values(texts)):
        n, at, seen = len(text), 0, {}
        padded = text + "\0" * 4
        for step in range(edit_embedding.steps_of(n)):
            seen[step] = at
            if at < n:
                bits = int(edit_embedding.mixed(np.array([step], np.uint64) ^ edit_embedding._BIT_SEED)[0])
                at += bits >> (int(edit_embedding.mixed(np.array([ord(padded[at])], np.uint64))[0]) & 63) & 1
        factors = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]
        order = sorted(range(edit_embedding.steps_of(n)), key=lambda s: int(edit_embedding.mixed(np.array([s], np.uint64) ^ edit_embedding._STEP_SEED)[0]))[: edit_embedding.SLOTS]
        want = [0 if seen[s] >= n else int(edit_embedding.mixed(np.array([sum(ord(padded[seen[s] + w]) * f for w, f in enumerate(factors)) & (1 << 64) - 1], np.uint64))[0]) % 255 + 1 for s in order]
        assert got.tolist() == want


def test_language_and_toxicity_learn(spark):
    rng = random.Random(2)
    tongues = {"en": "the and of to in that".split(), "xx": "ñul øre wik čaj pøl".split()}
    rows = []
    for k in range(400):
        lang = ("en", "xx")[k % 2]
        bad = k % 5 == 0
        words = rng.choices(tongues[lang], k=40)
        if bad:
            words[10:14] = rng.choices(["vile", "scum", "trash"], k=4)
        rows.append((k, " ".join(words), lang, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    texts = spark.createDataFrame([(1, "the and of"), (2, "øre wik"), (3, None), (4, "123 !"), (5, "")], "id long, text string")
    got = {r.id: r.language for r in language_id.identify(texts, language_id.train(df)).collect()}
    assert [got[k].lang for k in range(1, 6)] == ["en", "xx", "und", "und", "und"] and all(0 <= x.score <= 1 for x in got.values())
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    scores = {r.id: r.toxicity for r in toxicity.toxicity(spark.createDataFrame([(1, "the and vile scum trash of"), (2, "the and of"), (3, None)], "id long, text string"), model).collect()}
    assert scores[1] > 0.5 > 0.3 > scores[2] and scores[3] < 0.3
    assert all(x in {"vile", "scum", "trash"} for r in toxicity.passages(df.filter("toxic = 1").limit(5), model).collect() for x in r.passage.split()[:1])
    empty = df.limit(0)
    assert language_id.identify(texts, language_id.train(empty)).count() == 5 and toxicity.train(empty, empty).slope == 0.0
    assert zlib.crc32(b"7") % 4 == spark.range(1).select(F.crc32(F.lit("7").cast("binary")) % 4).first()[0]


def test_segments_are_maximal():
    scores = np.array([1.0, -2, 3, -1, 2, -5, 1, 1, -9, 4])
    assert [(s, a, b) for s, a, b in toxicity.segments(scores, np.flatnonzero(scores > 0))] == [(1, 0, 0), (4, 2, 4), (2, 6, 7), (4, 9, 9)]


def test_site_tree(spark):
    def page(k):
        return f'<html><body><nav><a>menu {k}</a></nav><div class="x">All rights</div><div class="body"><p>Text {k} &amp; more</p><p>Second\n {k * 7}</p></div><div class="cookie">ok {k}</div><script>s()</script></body></html>'

    rows = [(k, "http://h.org/x", page(k)) for k in range(20)] + [(20, None, None), (21, "http://h.org/", ""), (22, "http://o.org/", "<article><h1>T<p>A<br>b</article><aside>no</aside>")]
    got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text 3 & more\n\nSecond 21" and got[20] == got[21] == "" and got[22] == "T\n\nA b"


def similar_families(rng, families, members, length=60):
    """Texts of families whose members differ by some words of a common passage, so that pairs lie on both sides of 0.8."""
    texts = []
    for f in range(families):
        base = [f"f{f}w{rng.randint(0, 9999)}" for _ in range(length)]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.choice([0, 1, length - 1, length // 2])] = f"x{rng.randint(0, 10**9)}"
            texts.append(" ".join(own))
    return texts


def groups_by_brute_force(texts, words, similarity):
    sets = [{tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if (w := t.split()) else set() for t in texts]
    label, n_links = list(range(len(texts))), 0
    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if texts[a] == texts[b] or (shared and shared >= similarity * (len(sets[a]) + len(sets[b]) - shared)):
                n_links += texts[a] != texts[b]
                low, high = sorted((label[a], label[b]))
                if low != high:
                    label = [low if x == high else x for x in label]
    return label, n_links


@pytest.mark.parametrize("families", [10, 150])
def test_similar_groups_against_brute_force(spark, families):
    texts = similar_families(random.Random(families), families, 6)
    label, n_links = groups_by_brute_force(texts, 5, 0.8)
    assert n_links > families
    got = {r.doc_id: r.component_id for r in near_texts.similar_groups(docs(spark, texts)).collect()}
    assert got == dict(enumerate(label))


def test_similar_groups_of_unlike_sizes(spark):
    rng, texts = random.Random(11), []
    for f in range(60):
        base = [f"f{f}w{k}" for k in range(rng.randint(10, 90))]
        for _ in range(5):
            own = base[rng.randint(0, len(base) // 8) :] + [f"x{rng.randint(0, 10**9)}" for _ in range(rng.randint(0, len(base) // 12))]
            own[0] = rng.choice([own[0], "passage of all texts", f"y{rng.randint(0, 10**9)}"])
            texts.append(" ".join(own))
    for similarity in (0.6, 0.8):
        label, n_links = groups_by_brute_force(texts, 5, similarity)
        assert n_links > 60
        got = {r.doc_id: r.component_id for r in near_texts.similar_groups(docs(spark, texts), similarity=similarity).collect()}
        assert got == dict(enumerate(label))


def test_strangers_with_a_passage_in_common_make_no_pairs(spark, monkeypatch):
    rng, rows = random.Random(12), {}
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([*passage, *(f"s{rng.randint(0, 10**9)}" for _ in range(140))]) for _ in range(30)]
    own = [[f"t{rng.randint(0, 10**9)}" for _ in range(200)] for _ in range(10)]
    texts += [" ".join(x) for x in own] + [" ".join([*x[:100], "other", *x[101:]]) for x in own]

    def counting(df, name, written=near_texts.written):
        found = written(df, name)
        rows[name] = found.count()
        return found

    monkeypatch.setattr(near_texts, "written", counting)
    got = {r.doc_id: r.component_id for r in near_texts.similar_groups(docs(spark, texts)).collect()}
    assert got == dict(enumerate([*range(40), *range(30, 40)]))
    assert 10 <= rows["near-pairs"] < 40  # of 30 strangers there are 435 pairs


def test_nearest_stranger_hides_no_similar_text(spark):
    # One passage in all texts, and members of two chains that are similar only to some of the others.
    rng = random.Random(4)
    texts = similar_families(rng, 2, 40, 45) + [" ".join(["shared passage of many words here"] + [f"s{rng.randint(0, 10**6)}" for _ in range(30)]) for _ in range(20)]
    label = groups_by_brute_force(texts, 5, 0.9)[0]
    got = {r.doc_id: r.component_id for r in near_texts.similar_groups(docs(spark, texts), similarity=0.9).collect()}
    assert got == dict(enumerate(label))


def test_hot_shingles_are_split_and_lose_no_link(spark):
    texts = similar_families(random.Random(6), 3, 60, 45)
    label = groups_by_brute_force(texts, 5, 0.9)[0]
    for hot_size, cell in ((256, 1 << 20), (4, 250)):
        got = {r.doc_id: r.component_id for r in near_texts.similar_groups(docs(spark, texts), similarity=0.9, hot_size=hot_size, cell=cell).collect()}
        assert got == dict(enumerate(label))


def test_near_copies_of_repeated_and_null_ids(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 999)}" for _ in range(200)]
    near, other = " ".join([*base[:100], "changed", *base[101:]]), " ".join(f"v{rng.randint(0, 999)}" for _ in range(200))
    rows = spark.createDataFrame([(3, near, "a"), (5, " ".join(base), "b"), (5, other, "c"), (5, other, "c"), (None, "alone in the world", "d"), (None, near, "e"), (None, None, "f"), (None, None, "f")], "doc_id long, text string, `near id` string")
    kept = near_texts.without_near_copies(rows)
    assert kept.columns == rows.columns
    assert sorted((r["near id"], r.doc_id) for r in kept.collect()) == [("a", 3), ("c", 5), ("d", None), ("f", None)]
    assert near_texts.without_near_copies(rows.limit(0)).count() == 0


def test_decontamination_goes_by_the_row_and_not_its_id(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    item = " ".join(f"q{rng.randint(0, 999)}" for _ in range(40))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = docs(spark, [f"before {item} after", "clean one", "clean two", f"more {item}", "clean three", None], [None, None, 7, 7, 8, 9])
    kept = corpus_pipeline.without_benchmark(spark, rows, str(tmp_path))
    assert kept.columns == rows.columns and sorted(r.text or "" for r in kept.collect()) == ["", "clean one", "clean three", "clean two"]


def test_layout_names_take_no_page_away():
    for source in ('<body class="has-sidebar"><p>Text</p></body>', '<div id="page" class="layout-no-sidebar"><p>Text</p></div>', '<article class="post comments-open"><p>Text</p></article>', '<div class="widget"><article>Text</article></div>', '<div>Text</div><div class="site-footer">no</div>'):
        assert site_tree.main_text(source, {}) == "Text"


def test_every_accepted_pattern_of_short_items_has_a_seed_hit():
    import itertools

    for n in (15, 16):
        item = [f"q{k}" for k in range(n)]
        texts = [" ".join(f"z{k}" if k in bad else w for k, w in enumerate(item)) for e in (3, 4) for bad in itertools.combinations(range(n), e)]
        every = spaced_seeds.Benchmark([1], [" ".join(item)], masks=("1",)).overlaps(texts)
        assert {x[0] for x in spaced_seeds.Benchmark([1], [" ".join(item)]).overlaps(texts)} == {x[0] for x in every}


def test_importance_against_a_plain_tree(spark, monkeypatch):
    """Hosts of plain divs: nodes are (class, text or children); importance is counted from the nested tuples themselves."""
    from math import log

    rng = random.Random(12)

    def page(k):
        rows = [("r", f"row {rng.randint(0, 10**6)}") for _ in range(rng.randint(1, 4))]
        return ("page", [("a", [("b", "same menu"), ("c", rng.choice(["one", "two", "three", "four", "five", "six"]))]), ("d", [*rows, ("s", "subscribe to us")]), ("e", "the same end"), ("f", f"odd {k}" if k == 3 else "odd")])

    def render(node):
        name, inner = node
        return f'<div class="{name}">{inner if isinstance(inner, str) else "".join(map(render, inner))}</div>'

    def walk(node, path, found):
        name, inner = node
        path = (*path, name)
        style, depth = (), 0
        if not isinstance(inner, str):
            below = [walk(x, path, found) for x in inner]
            style, depth = tuple(x[0] for x in inner), 1 + max(below)
        found.setdefault(path, []).append((style, str(inner), depth))
        return depth

    def entropy(values):
        n = len(values)
        return -sum(values.count(v) / n * log(values.count(v) / n) for v in set(values)) / log(n)

    trees = [page(k) for k in range(30)]
    seen = {}
    for tree in trees:
        own = {}
        walk(tree, (), own)
        for path, x in own.items():
            seen.setdefault(path, []).append((tuple(y[0] for y in x), tuple(y[1] for y in x), max(y[2] for y in x)))
    want = {}
    for path, x in seen.items():
        key = 0
        for name in path:
            key = site_tree.child_key(key, f"div.{name}")
        share = 1 - site_tree.GAMMA ** max(y[2] for y in x)
        want[key] = share * entropy([y[0] for y in x]) + (1 - share) * entropy([y[1] for y in x])
    rows = spark.createDataFrame([(k, "http://h.org/x", render(t)) for k, t in enumerate(trees)] * 2 + [(90, None, None)], "page_id long, url string, html string")
    once = rows.filter("page_id < 90").dropDuplicates(["page_id"])
    got = {r.key: r.importance for r in site_tree.style_tree(once).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    texts = sorted((r.page_id, r.text) for r in site_tree.extract(rows).collect())
    kept = [[t[1][0][1][1][1]] + [x[1] for x in t[1][1][1][:-1]] for t in trees]
    assert texts == sorted([(k, "\n\n".join(x)) for k, x in enumerate(kept)] * 2 + [(90, "")])
    monkeypatch.setattr(site_tree, "BROADCAST_ROWS", -1)
    assert sorted((r.page_id, r.text) for r in site_tree.extract(rows).collect()) == texts
    assert site_tree.extract(rows.limit(0)).count() == 0


def test_entropy_decides_within_articles_and_repeated_pages_stay(spark):
    def page(k, text):
        return f'<body><p>out {k}</p><article><h1>T {text}</h1><p>Some <b>bold</b> {text}</p><div class="box">Write to us</div></article></body>'

    rows = [(k, "http://a.org/", page(k, f"text {k}")) for k in range(20)] + [(100 + k, "http://b.org/", page(k, "one text")) for k in range(20)]
    got = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T text 3\n\nSome bold text 3" and got[103] == "T one text\n\nSome bold one text\n\nWrite to us"


def test_deep_pages_take_linear_time():
    assert site_tree.main_text("<div>" * 30_000 + "x" + "</i>" * 30_000, {}) == "x"
    assert len(site_tree.page_nodes("<div>" * 30_000)) == 30_000


def test_edit_classes_against_brute_force(spark):
    rng = random.Random(14)
    texts = []
    for f in range(12):
        base = "".join(rng.choices("abcdefghij ", k=rng.choice([40, 300, 1000, 1040])))
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(own) // 40)):
                own[rng.randrange(len(own))] = rng.choice(["", "x", "yz"])
            texts.append("".join(own))
    texts += [None, "", texts[0], "ab"]
    values = edit_embedding.slot_values([t or "" for t in texts])
    label, n_links = list(range(len(texts))), 0
    for a in range(len(texts)):
        for b in range(a):
            if edit_embedding.likeness(len(texts[a] or ""), values[a], len(texts[b] or ""), values[b]) >= edit_embedding.NEAR:
                n_links += 1
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert n_links > 50 and len(set(label)) > 14
    for cell in (2000, 3):
        assert {r.doc_id: r.class_id for r in edit_embedding.near_classes(docs(spark, texts), cell=cell).collect()} == dict(enumerate(label))
    odd = edit_embedding.near_classes(docs(spark, ["same", "same", "other text", None, None], [None, 4, None, 9, 9])).collect()
    assert sorted(str(r.class_id) for r in odd) == ["4", "4", "9", "9", "None"]
    assert edit_embedding.near_classes(docs(spark, [])).count() == 0


def test_next_texts_are_shuffled_compressed(spark):
    texts = ["words that come again and again " * 40 + str(k) for k in range(40)] + ["", "\u00e9\U0001f600 x"]
    rows = edit_embedding.with_next(docs(spark, texts), 4).collect()
    assert {r.doc_id: edit_embedding._unpacked(r.text, r.n_bytes) for r in rows if not r.guest} == dict(enumerate(texts))
    assert sum(len(r.text) for r in rows) < sum(map(len, texts)) / 4


def test_likeness_counts_unlike_lengths_as_edits():
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    like = lambda a, b: edit_embedding.likeness(len(a), edit_embedding.slot_values([a])[0], len(b), edit_embedding.slot_values([b])[0])
    for _ in range(20):
        a = text(rng.randint(1, 12))
        assert like(a, text(1560)) < 0.05 and like(text(1560), a) < 0.05
        long = text(2000)
        assert 0.35 < like(long, long[:1000]) < 0.65 and like(long, long[:1950]) > 0.85 and like(long, text(1900)) < 0.1


def test_comments_go_however_their_classes_are_spelled():
    page = "<body><article class='post comments-open'><p>The story.</p>{0}</article>{0}</body>"
    for comment in (
        "<article class='comment'>Nice one!</article>", "<div class='comment-list'><div class='comment-body'>Nice one!</div></div>", "<ol class='commentlist'><li>Nice one!</li></ol>",
        "<section id='disqus_thread'>Nice one!</section>", "<div class='reply-text'><p>Nice one!</p></div>", "<article id='comment-17' class='byuser'><p>Nice one!</p></article>",
    ):
        assert site_tree.main_text(page.format(comment), {}) == "The story.", comment
    assert site_tree.main_text("<body class='no-comments'><div class='comments-off entry'><p>The story.</p></div></body>", {}) == "The story."


def test_fingerprints_of_repeated_ids_stay_apart(spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300))
    near, other = text(), text()
    rows = [(3, near + " x"), (5, near), (5, other), (None, other), (None, "alone again")]
    got = sorted(((r.doc_id, r.component_id) for r in gray_index.near_groups(docs(spark, [t for _, t in rows], [d for d, _ in rows])).collect()), key=repr)
    assert got == sorted([(3, 3), (5, 3), (5, 5), (None, 5), (None, None)], key=repr)


def test_rows_of_several_layouts_are_mapped_by_their_own_fingerprints(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", "a"), ("assistant", "b"), ("system", None), ("assistant", "d"), ("human", "e"), ("tool", "f"), (None, None), ("user", "h" * 100_000)])] + [(2, None, "user", "n")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat_format.mixed_records(table)
    prints = records.select(chat_format.row_fingerprint(F.col("record"), records.schema["record"].dataType)).distinct().collect()
    assert len(prints) == 4 and {r[0] for r in prints} <= {m.fingerprint for m in chat_format.MAPPINGS}
    got = sorted(((r.conv_id, r.place, r.role, r.text) for r in chat_format.mixed_turns(records).collect()), key=repr)
    assert got == sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=repr)
    odd = records.withColumn("record", F.struct(F.lit(1).alias("score"), F.col("record.rows").alias("rows")))
    assert chat_format.mixed_turns(odd).count() == 0 and chat_format.mixed_turns(records.limit(0)).count() == 0
