"""Personal data by a skip-chain conditional random field.

Patterns find the base spans, which are certain. A document with any digit or at-sign is cut into tokens, and those that could be
personal data, or stand by such, are the field's nodes, with the labels none, email, ip, card and phone. Tokens that repeat, or that
resemble each other by half or a quarter of a long number, share skip potentials wherever in the document they are, so that
what is certain in one place makes a looser mention of it elsewhere known ("+1 (918) 555-3922" makes "918.555.3922" a phone);
neighbours, and like tokens that are both uncertain, are drawn to the same label. Loopy message passing gives each node's chances;
runs of tokens with one likely label are added as spans. Tokens of base spans are observed.

No labels exist, so the potentials are learned piece by piece from mentions that are made: for each base span, its text
is written once more into its document in a looser form, besides look-alikes that mean nothing. The weights of nodes and of
skips from certain tokens are a multinomial regression over the counts of feature sets; how strongly uncertain pairs agree
is a logarithm of odds by kind. The counts cover all documents and reach the driver as one row for each set of features,
of which there are under a million.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import plain_text, slices, table, written

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: The patterns, written so that each takes linear time: possessive where nothing is given back.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
TRIGGER = re.compile("[0-9@]")
#: Words that stand for signs in addresses.
SIGNS = {"at", "dot"}
#: A node's label needs this chance; messages are passed so often, and mixed with the ones before.
CHANCE, ROUNDS, DAMPING = 0.7, 8, 0.4
#: Nodes lie at most so many tokens from one with a digit or an at-sign; spans' tokens at most so many characters apart.
REACH, APART = 2, 4
SMOOTH, STRONGEST = 0.5, 2.0
CHARS = 1 << 20


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in even)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind from 1, start, end) of the patterns' matches that pass their checks, by kind and start."""
    found = []
    if "@" in text:
        end = before = 0
        for m in DOMAIN.finditer(text):
            before = max(text.rfind("@", before, m.start()) + 1, before, end)
            head = text[before : m.start()]
            start = m.start() - len(head) + len(head.rstrip(LOCAL))
            if start < m.start():
                found.append((1, start, m.end()))
                end = m.end()
    if TRIGGER.search(text):
        found += [(2, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() > 15:
                digits = re.sub("[ -]", "", m.group())
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    found.append((3, m.start(), m.end()))
        if "+" in text:
            found += [(4, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdecimal, m.group())) <= 15]
    return found


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k - 1]}:{a}:{b}" for k, a, b in sorted(spans))


class Tokens(NamedTuple):
    """The nodes of one text, in order: their spans, place among all tokens, feature set, and the label that is certain (-1: none is)."""

    starts: list[int]
    ends: list[int]
    places: list[int]
    features: list[tuple[int, int, int]]
    known: list[int]
    words: list[str]


#: Classes of the characters beside a token.
_BESIDE = {c: k for k, group in enumerate(("\x20\t\n\r\x0b\x0c", ".", "@", "-", "+(", ")", "/_:", "\"'=[]<>"), 1) for c in group}
SHAPES, SIDES = 24, 10


def _beside(text: str, at: int) -> int:
    return _BESIDE.get(text[at], 9) if 0 <= at < len(text) else 0


def _shape(word: str) -> int:
    digits = sum(map("0123456789".__contains__, word))
    if digits == len(word):
        return min(digits, 4) + (digits > 4) + (digits > 7) + (digits > 12) + (digits > 19)
    if digits:
        return 9 if digits * 2 > len(word) and len(word) > 8 else 10 if len(word) > 12 else 11
    return 12 if word in SIGNS else 13 if len(word) < 4 else 14


def nodes(text: str, certain: list[tuple[int, int, int]]) -> Tokens:
    """The nodes of a text, with the labels of its certain spans (kind, start, end)."""
    spans = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    words = [text[a:b].lower() for a, b in spans]
    sure = [-1] * len(spans)
    at = 0
    for kind, a, b in sorted(certain, key=lambda x: x[1]):
        while at and spans[at - 1][1] > a:
            at -= 1
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        while at < len(spans) and spans[at][0] < b:
            if sure[at] < 0:
                sure[at] = kind
            at += 1
    within = {w for w, k in zip(words, sure) if k > 0 and len(w) > 3}
    chosen = set()
    for k, (a, b) in enumerate(spans):
        if sure[k] >= 0 or (b < len(text) and text[b] == "@") or (a and text[a - 1] == "@") or words[k] in within or TRIGGER.search(words[k]):
            chosen.update(range(max(0, k - REACH), min(len(spans), k + REACH + 1)))
    found = Tokens([], [], [], [], [], [])
    for k in sorted(chosen):
        a, b = spans[k]
        row = (a, b, k, (_shape(words[k]), _beside(text, a - 1), _beside(text, b)), sure[k], words[k])
        for column, value in zip(found, row):
            column.append(value)
    return found


def chain(own: Tokens, text: str) -> list[tuple[int, int, int]]:
    """(node, node, kind) of neighbours: kinds by what lies between them, one sign, a space, or more."""
    out = []
    for k in range(len(own.places) - 1):
        if own.places[k + 1] == own.places[k] + 1:
            gap = text[own.ends[k] : own.starts[k + 1]] if own.starts[k + 1] - own.ends[k] <= APART else "\n"
            out.append((k, k + 1, 0 if len(gap) == 1 and not gap.isspace() else 1 if gap == " " else 3 if "\n" in gap else 2))
    return out


SKIPS = 5


def skips(own: Tokens) -> list[tuple[int, int, int]]:
    """(node, node, kind) of like tokens: each with the last one like it, and with the first certain one.

    Kinds: the same with three digits or more; the same with fewer; the same word; numbers with one half in common; a number of
    four to seven digits that is an aligned part of a long one.
    """
    last: dict[tuple, int] = {}
    sure: dict[tuple, int] = {}
    out = []
    for k, word in enumerate(own.words):
        digits = sum(map(str.isdecimal, word))
        if digits:
            keys = [((0 if digits > 2 else 1, word))]
        else:
            keys = [(2, word)] if len(word) > 3 else []
        if word.isdecimal() and digits > 3:
            if digits > 7:
                half = digits // 2
                keys += [(3, digits, 0, word[:half]), (3, digits, 1, word[half:])]
                keys += [(4, "whole", word[at : at + 4]) for at in range(0, digits - 3, 4)]
            else:
                keys += [(4, "part", word[:4])]
        near = set()
        for key in keys:
            look = (4, "whole" if key[1] == "part" else "part", key[2]) if key[0] == 4 else key
            for other in (last.get(look), sure.get(look)):
                if other is not None and other not in near and other != k:
                    near.add(other)
                    out.append((other, k, key[0]))
        for key in keys:
            last[key] = k
            if own.known[k] > 0:
                sure.setdefault(key, k)
    return out


# --------------------------------------------------------------------------------------------------- learning


def _loose(kind: int, mention: str, rng: random.Random) -> str:
    """A mention in a form that no pattern matches."""
    if kind == 1:
        at, dot = rng.choice(((" at ", " dot "), ("[at]", "."), (" at ", "."), ("(at)", "(dot)")))
        return mention.replace("@", at).replace(".", dot) if at != " at " or dot != "." else mention.replace("@", at)
    parts = re.findall("[0-9]+", mention)
    if kind == 2:
        return rng.choice(("-", " ", " . ", "_")).join(parts)
    if kind == 3:
        digits = "".join(parts)
        if rng.random() < 0.4:  # one digit wrong
            at = rng.randrange(len(digits))
            return digits[:at] + str((int(digits[at]) + rng.randint(1, 9)) % 10) + digits[at + 1 :]
        return rng.choice((".", "/", "_", " . ")).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    return rng.choice(("-", ".", " ", "/")).join(parts[1:] if len(parts) > 2 and rng.random() < 0.7 else parts)


def _other(mention: str, rng: random.Random) -> str:
    """The same shape with other digits and letters."""
    return re.sub("[0-9]|[a-z]+", lambda m: str(rng.randint(0, 9)) if m.group().isdecimal() else m.group() if m.group() in ("at", "dot") else "".join(rng.choices("aeinorst", k=len(m.group()))), mention)


def taught(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(text, certain spans, made spans): the text with each certain span's looser mention and two look-alikes put between its words."""
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    pieces = []
    for kind, a, b in spans:
        loose = _loose(kind, text[a:b], rng)
        pieces += [(kind, loose), (0, _other(loose, rng)), (0, _other(_loose(kind, text[a:b], rng), rng))]
    free = [m.start() for m in re.finditer(r"(?<=\w) (?=\w)", text) if not any(a <= m.start() <= b for _, a, b in spans)]
    rng.shuffle(pieces)
    free = sorted(rng.sample(free, min(len(pieces), len(free))))
    out, made, moved, at = [], [], [], 0
    size = 0
    for spot, (kind, piece) in zip(free, pieces):
        out += [text[at:spot], " ", piece]
        size += spot - at + 1
        if kind:
            made.append((kind, size, size + len(piece)))
        size += len(piece)
        moved.append((spot, size - spot))
        at = spot
    out.append(text[at:])
    shift = lambda x: next((s for spot, s in reversed(moved) if spot <= x), 0)
    return "".join(out), [(k, a + shift(a), b + shift(a)) for k, a, b in spans], made


def evidence(own: Tokens, pairs: list[tuple[int, int, int]]) -> list[int]:
    """For each node what its strongest kind of skip from certain tokens says: 16 times the kind plus a bit a label, or 0."""
    found = [(SKIPS, 0)] * len(own.words)
    for i, j, kind in pairs:
        for a, b in ((i, j), (j, i)):
            if own.known[a] > 0 > own.known[b]:
                bit = 1 << (own.known[a] - 1)
                best, bits = found[b]
                found[b] = (kind, bit) if kind < best else (best, bits | bit) if kind == best else found[b]
    return [16 * kind + bits if bits else 0 for kind, bits in found]


def _pieces(text: str) -> Iterator[tuple[int, int, int, int, int]]:
    """Counted pieces of a taught text: nodes (0, shape, sides, evidence, label), and uncertain pairs (1 a chain, 2 a skip, kind, whether they agree, 0, 0)."""
    spans = base_spans(text)
    if not spans and not TRIGGER.search(text):
        return
    text, certain, made = taught(text, spans)
    own = nodes(text, certain)
    both = nodes(text, certain + made)
    truth = dict(zip(both.places, both.known))
    labels = [max(truth.get(p, -1), 0) for p in own.places]
    like = skips(own)
    said = evidence(own, like)
    for k, known in enumerate(own.known):
        if known < 0:
            shape, left, right = own.features[k]
            yield 0, shape, left * SIDES + right, said[k], labels[k]
    for piece, pairs in ((1, chain(own, text)), (2, like)):
        for i, j, kind in pairs:
            if own.known[i] < 0 and own.known[j] < 0 and (labels[i] or labels[j]):
                yield piece, kind, int(labels[i] == labels[j]), 0, 0


def counted(docs: DataFrame) -> DataFrame:
    """(piece, first, second, third, label, n): how often each piece occurs in the taught documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for run in slices(batch.column("text"), CHARS):
                for text in run:
                    found.update(_pieces(text))
        columns = zip(*((*key, n) for key, n in sorted(found.items()))) if found else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["piece", "first", "second", "third", "label", "n"])

    keys = ["piece", "first", "second", "third", "label"]
    return docs.select(plain_text().alias("text")).mapInArrow(task, "piece long, first long, second long, third long, label long, n long").groupBy(*keys).agg(F.sum("n").alias("n"))


@dataclass
class Field:
    """Logarithmic potentials of labels: by shape, by shape and side, by kind of skip and the certain token's label; and how strongly
    uncertain neighbours and like tokens agree, by kind."""

    shape: np.ndarray
    side: np.ndarray
    certain: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def nodes(self, own: Tokens, pairs: list[tuple[int, int, int]]) -> np.ndarray:
        shape, left, right = np.array(own.features, np.int64).reshape(-1, 3).T
        found = self.shape[shape] + self.side[shape, left] + self.side[shape, SIDES + right]
        for k, said in enumerate(evidence(own, pairs)):
            if said:
                found[k] += sum(self.certain[said >> 4, label] for label in range(len(KINDS)) if said >> label & 1)
        return found


def _agreement(rows: np.ndarray, kinds: int) -> np.ndarray:
    """For each kind of pair, the logarithm of the odds that both labels are the same where one is not none."""
    counts = np.full((kinds, 2), SMOOTH)
    np.add.at(counts, (rows[:, 1], rows[:, 2]), rows[:, 5])
    return np.clip(np.log(counts[:, 1] / counts[:, 0]), 0.0, STRONGEST)


def fitted(rows: np.ndarray, rounds: int = 600, ridge: float = 1e-4) -> Field:
    """The field of counted rows (piece, first, second, third, label, n)."""
    n = len(LABELS)
    own = rows[rows[:, 0] == 0]
    shape, left, right, said = own[:, 1], own[:, 2] // SIDES, own[:, 2] % SIDES, own[:, 3]
    at_side, at_certain = SHAPES, SHAPES * (1 + 2 * SIDES)
    width = at_certain + SKIPS * len(KINDS) + 1  # the last column is for nothing
    columns = [shape, at_side + shape * 2 * SIDES + left, at_side + shape * 2 * SIDES + SIDES + right]
    columns += [np.where(said >> k & 1, at_certain + (said >> 4) * len(KINDS) + k, width - 1) for k in range(len(KINDS))]
    columns = np.stack(columns, axis=1)
    weights, squares = np.zeros((width, n)), np.full((width, n), 1e-8)
    mass = own[:, 5] / max(own[:, 5].sum(), 1)
    for _ in range(rounds if len(own) else 0):
        scores = weights[columns].sum(axis=1)
        chance = np.exp(scores - scores.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        chance[np.arange(len(own)), own[:, 4]] -= 1
        slope = ridge * weights
        for c in range(columns.shape[1]):
            np.add.at(slope, columns[:, c], chance * mass[:, None])
        slope[-1] = 0
        squares += slope * slope
        weights -= 0.3 * slope / np.sqrt(squares)
    side = weights[at_side:at_certain].reshape(SHAPES, 2 * SIDES, n)
    certain = weights[at_certain:-1].reshape(SKIPS, len(KINDS), n)
    return Field(weights[:SHAPES], side, certain, *(_agreement(rows[rows[:, 0] == piece], kinds) for piece, kinds in ((1, 4), (2, SKIPS))))


# ------------------------------------------------------------------------------------------------- inference


def chances(field: Field, own: Tokens, text: str) -> np.ndarray:
    """Each node's chances of the labels, by loopy message passing along chains and skips."""
    like = skips(own)
    alone = field.nodes(own, like)
    known = np.array(own.known, np.int64)
    sure = np.flatnonzero(known >= 0)
    alone[sure] = -30.0
    alone[sure, known[sure]] = 0.0
    links = [(i, j, field.chain[kind]) for i, j, kind in chain(own, text)] + [(i, j, field.skip[kind]) for i, j, kind in like]
    links = [x for x in links if known[x[0]] < 0 and known[x[1]] < 0]
    belief = alone.copy()
    if links:
        a, b = (np.array([x[k] for x in links]) for k in (0, 1))
        source, target, size = np.r_[a, b], np.r_[b, a], len(a)
        pair = np.eye(len(LABELS)) * np.tile([x[2] for x in links], 2)[:, None, None]
        back = np.r_[np.arange(size, 2 * size), np.arange(size)]
        sent = np.zeros((2 * size, len(LABELS)))
        for _ in range(ROUNDS):
            out = np.logaddexp.reduce((belief[source] - sent[back])[:, :, None] + pair, axis=1)
            out -= np.logaddexp.reduce(out, axis=1, keepdims=True)
            sent = DAMPING * sent + (1 - DAMPING) * out
            belief = alone.copy()
            np.add.at(belief, target, sent)
    chance = np.exp(belief - belief.max(axis=1, keepdims=True))
    return chance / chance.sum(axis=1, keepdims=True)


def added_spans(field: Field, text: str, certain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans (kind, start, end) that the field adds to the certain ones: runs of near tokens with one likely label."""
    if not TRIGGER.search(text):
        return []
    own = nodes(text, certain)
    if not own.words:
        return []
    chance = chances(field, own, text)
    label, sure = chance.argmax(axis=1), chance.max(axis=1) >= CHANCE
    found: list[list[int]] = []
    last = -2
    for k in range(len(own.words)):
        if own.known[k] >= 0 or not sure[k] or not label[k]:
            continue
        a, b = own.starts[k], own.ends[k]
        joined = found and last == k - 1 and own.places[k] == own.places[k - 1] + 1 and found[-1][0] == label[k] and a - found[-1][2] <= APART
        if joined and "\n" not in text[found[-1][2] : a]:
            found[-1][2] = b
        else:
            found.append([int(label[k]), a, b])
        last = k
    return [tuple(x) for x in found]


def learned(docs: DataFrame) -> Field:
    """The field of the documents (text); the driver gets one row for each set of features or labels, whatever the number of documents."""
    rows = written(counted(docs), "pii-counts").toArrow()
    return fitted(np.stack([rows.column(c).to_numpy() for c in ("piece", "first", "second", "third", "label", "n")], axis=1) if rows.num_rows else np.empty((0, 6), np.int64))


SCHEMA = "spans array<struct<kind: string, start: long, end: long, added: boolean>>"


def personal_spans(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, text and `spans` of each document (doc_id, text): kind, start, end (code points, end exclusive), and whether the field added it.

    Spans are ordered by kind (email, ip, card, phone) and start. Null texts are empty and have none; repeated rows and null ids are
    rows of their own; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for run in slices(batch.column("text"), CHARS):
                out = []
                for text in run:
                    base = base_spans(text)
                    both = sorted([(*x, False) for x in base] + [(*x, True) for x in added_spans(shared.value, text, base)])
                    out.append([{"kind": KINDS[k - 1], "start": a, "end": b, "added": new} for k, a, b, new in both])
                part = batch.slice(at, len(run))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(out, kind)], names=["doc_id", "text", "spans"])
                at += len(run)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    return rows.mapInArrow(task, f"doc_id long, text string, {SCHEMA}")


def op12_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest are of base spans; `spans` has all, n_added those of the field."""
    docs = table(spark, sf_dir, "documents")
    found = personal_spans(docs, learned(docs))
    base = F.filter("spans", lambda x: ~x["added"])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(F.filter(base, lambda x: x["kind"] == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    added = F.size(F.filter("spans", lambda x: x["added"])).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), added)


QUERIES = {"op12_skip_chain_crf": op12_skip_chain_crf}
SQL: dict[str, str] = {}
