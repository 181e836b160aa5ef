"""Verified near-duplicates: all pairs whose sets of word shingles are similar, joined to groups.

Texts are known by a 64-bit hash (the owner), so that copies are one and no text is shuffled. First links come from
the Gray-order index over the texts' SimHashes. That index alone misses similar texts whose fingerprints differ in
more bits, so the remaining candidates come from a prefix filter, which loses none. All shingles have one fixed
order, those common in a sample of the texts last. Two sets whose Jaccard similarity is at least t share one of the first
n - ceil(t n) + 1 shingles of each, n being its size, so every text is dealt by these alone, and candidates are the
texts that meet at one; sizes and places rule most of them out. That holds for any number of texts and any order: the
sample decides the cost only. It grows with the texts, so that a shingle which it doesn't know to be common has few
texts however many there are. Shingle sets are made again for the texts of candidate pairs alone.

How many texts meet at each key is counted before any pair is made, and each prefix is put in order of these counts, keys of no
other text first. Similar sets share not one but many keys of their prefixes, so the first one that they share lies
early in that order, which strangers with a passage in common don't reach. A pair whose keys just before are one key, too, has
met there, so that a run of shared keys makes one row. What is written before pairs is a row for each key of each text at most.

A shingle at which more than HOT texts meet (a passage, or a family of near copies) goes another way, because its pairs
grow with the square. Its texts are first compared with the smallest owner met at such shingles, and with their next
ones in Gray order of the fingerprints, turned by several numbers of bits. These verified links make components, and then
only pairs of different components are compared, in cells of texts that have about CELL shingles on each side. By prefixes, a cell
first tells which of its texts have a pair that can be similar. These come to the cell again with their whole sets, and pairs are verified
there, unless their ends are joined already; only links that join two components leave it: fewer than it has texts. So what is written
of a family grows with its texts and never with its pairs. Shingles that the sample knows to be hot are dealt with a salt.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BitFilter, partitions, plain_text, release_encoders, small_batches, written
from .components import components
from .gray_index import fingerprint_links, gray_rank, majority, rotated, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
#: Texts at least from which the common shingles are learned (one in HOT / LEAST_COMMON if that is more), texts of these that make one common, and shingles kept at most.
SAMPLE, LEAST_COMMON, MOST_COMMON = 10_000, 4, 1 << 20
#: Texts of a shingle above which not all their pairs are compared, and shingles of the texts on each side of a cell.
HOT, CELL = 32, 1 << 20
#: Bits by which fingerprints of first links differ at most.
FIRST_DIFF = 2
#: Turns of a fingerprint's bits, and places ahead in the Gray order of each, at which texts of hot shingles are compared first.
TURNS, AHEAD, NEAR_BITS = (0, 8, 16, 24, 32, 40, 48, 56), 3, 18
#: Rows that a task holds at a time, and pairs that it makes at a time.
ROWS, OPEN = 1 << 16, 1 << 18
#: Texts with their whole sets that a task holds at a time, and those of the cell it works on.
WHOLE_ROWS = 1 << 11
#: Bits of the filter that tells the texts of candidate pairs before their sets are made; with very many such texts it lets others pass, too.
FILTER_BITS = 1 << 26


def prefix_size(n: int, similarity: float) -> int:
    """Shingles of a set of n that a similar set must share one of."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def possible(sizes_a, places_a, sizes_b, places_b, similarity: float):
    """Whether sets that share a shingle at these places of their order can be similar: shared ones lie before both or after both."""
    least = similarity / (1 + similarity) * (sizes_a + sizes_b) - 1e-6
    return np.minimum(places_a, places_b) + np.minimum(sizes_a - places_a, sizes_b - places_b) >= least


def least_shared(sizes_a, sizes_b, similarity: float):
    """How many keys at least the prefixes of two similar sets share: all that the one which ends first has in common with the other set."""
    overlap = np.ceil(similarity / (1 + similarity) * (sizes_a + sizes_b) - 1e-6).astype(np.int64)
    return np.maximum(1, overlap - np.ceil(similarity * np.maximum(sizes_a, sizes_b) - 1e-9).astype(np.int64) + 1)


def pairs_within(keys: np.ndarray, owners: np.ndarray, at: np.ndarray, spot: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Possible pairs of owners, larger first, that meet at these keys and at none before; keys are in order, `spot` is that of placed()."""
    n = len(keys)
    ends = np.searchsorted(keys, keys, side="right")
    later = ends - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(later)])
    k = 0
    while k < n:
        to = max(k + 1, int(np.searchsorted(total, total[k] + OPEN, side="right")) - 1)
        a = np.repeat(np.arange(k, to), later[k:to])
        b = a + 1 + np.arange(len(a)) - (total[a] - total[k])
        yield _fitting(owners, at, spot, a, b, similarity)
        k = to


def _fitting(owners, at, spot, a, b, similarity):
    sizes, places = at >> 32, at & 0xFFFFFFFF
    order = np.where(spot < 0, ~spot, spot) >> 32
    ok = possible(sizes[a], places[a], sizes[b], places[b], similarity) & (owners[a] != owners[b])
    ok &= (spot[a] < 0) | (spot[b] < 0) | ((spot[a] ^ spot[b]) & 0xFFFFFFFF != 0)
    a, b = a[ok], b[ok]
    # After the first shared key in order of counts there are all the others.
    shared = least_shared(sizes[a], sizes[b], similarity)
    ok = (order[a] + shared <= prefix_size(sizes[a], similarity)) & (order[b] + shared <= prefix_size(sizes[b], similarity))
    u, v = owners[a[ok]], owners[b[ok]]
    once = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1) if len(u) else np.empty((2, 0), np.int64)
    return once[0], once[1]


def whole_keys(batches: Iterator[pa.RecordBatch], by: list[str], least: int = ROWS) -> Iterator[pa.Table]:
    """Batches in order of `by` as tables in which each key is whole."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        rows = pa.Table.from_batches(held)
        last = np.ones(n, bool)
        for c in by:
            values = rows.column(c).to_numpy()
            last &= values == values[-1]
        cut = n - int(np.count_nonzero(last))
        if cut:
            yield rows.slice(0, cut)
        held, n = rows.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held)


def _pair_batch(u, v):
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _found_batch(key, u, v):
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["key", "u", "v"])


def shingle_sets(texts: list[str], words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The different shingles of each text as ints, and its SimHash."""
    hashes = [np.unique(shingle_hashes(t, words)) for t in texts]
    return [np.unique(h.astype(np.uint32)).view(np.int32) for h in hashes], majority(hashes).view(np.int64)


def sets_of(texts: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """owner and shingles of those texts (owner, text) whose owner `chosen` has."""
    spark = texts.sparkSession

    shared = spark.sparkContext.broadcast(BitFilter.of(chosen.select("owner"), FILTER_BITS))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            owners = batch.column("owner").to_numpy()
            known = shared.value.may_hold(owners)
            new = [k for k in np.flatnonzero(known).tolist() if int(owners[k]) not in seen and not seen.add(int(owners[k]))]
            for at in range(0, len(new), 256):
                part = new[at : at + 256]
                sets = shingle_sets(batch.column("text").take(pa.array(part, pa.int64())).to_pylist(), words)[0]
                yield pa.RecordBatch.from_arrays([pa.array(owners[part]), pa.array(sets, pa.list_(pa.int32()))], names=["owner", "shingles"])

    made = texts.mapInArrow(task, "owner long, shingles array<int>")
    return made.join(chosen.select("owner").distinct(), "owner", "left_semi").dropDuplicates(["owner"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    left = pairs.join(sets.withColumnsRenamed({"owner": "u", "shingles": "a"}), "u")
    both = left.join(sets.withColumnsRenamed({"owner": "v", "shingles": "b"}), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(shared >= similarity * (F.size("a") + F.size("b") - shared)).select("u", "v")


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def sample_step(n: int, hot_size: int) -> int:
    """Of so many texts one is in the sample. A sample of fixed size would take shingles of ever more texts for rare ones, and the cells of these grow with their square."""
    return max(1, min(-(-n // SAMPLE), hot_size // LEAST_COMMON))


def prefixed(texts: DataFrame, words: int, similarity: float, hot_size: int) -> tuple[DataFrame, np.ndarray]:
    """owner, fp (SimHash), size and keys (the prefix in order) of each text that has words, written; equal texts may come more than once.

    Besides, the keys that the sample knows to be hot.
    """
    spark = texts.sparkSession
    of = sample_step(texts.count(), hot_size)
    some = texts.filter(F.pmod(F.xxhash64("owner"), F.lit(of)) == 0).dropDuplicates(["owner"])

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = shingle_sets(batch.column("text").slice(at, 256).to_pylist(), words)[0]
                yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int32()))], names=["shingles"])

    sample = written(some.select("text").mapInArrow(prepared, "shingles array<int>"), "near-sample")
    seen = sample.select(F.explode("shingles").alias("key")).groupBy("key").count().filter(F.col("count") >= LEAST_COMMON)
    common = written(seen, "near-common").orderBy(F.desc("count"), "key").limit(MOST_COMMON).orderBy("key").toArrow()
    ranks = spark.sparkContext.broadcast((common.column("key").to_numpy(), common.column("count").to_numpy()))

    def prefixes(sets: list[np.ndarray]) -> list[np.ndarray]:
        known, counts = ranks.value
        values = np.concatenate([*sets, np.empty(0, np.int32)])
        rank = np.zeros(len(values), np.uint64)
        if len(known):
            spot = np.minimum(np.searchsorted(known, values), len(known) - 1)
            rank = np.where(known[spot] == values, counts[spot], 0).astype(np.uint64)
        ordered = np.split(rank << np.uint64(32) | values.view(np.uint32).astype(np.uint64), np.cumsum([len(x) for x in sets])[:-1]) if sets else []
        return [np.sort(x)[: prefix_size(len(x), similarity) if len(x) else 0].astype(np.uint32).view(np.int32) for x in ordered]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("shingles")
            keys = prefixes([x.values.to_numpy() for x in column])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int32), *keys]))], names=["key"])

    expected = sample.mapInArrow(sampled, "key int").groupBy("key").count().filter(F.col("count") >= max(LEAST_COMMON, hot_size // of))
    expected = written(expected.select("key"), "near-expected").toArrow()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()
        seen: set[int] = set()
        for batch in batches:
            owners = batch.column("owner").to_numpy()
            new = [k for k, owner in enumerate(owners.tolist()) if owner not in seen and not seen.add(owner)]
            for start in range(0, len(new), 256):
                part = np.array(new[start : start + 256])
                sets, fps = shingle_sets(batch.column("text").take(pa.array(part)).to_pylist(), words)
                sizes = np.array([len(x) for x in sets])
                full = np.flatnonzero(sizes)
                keys = prefixes([sets[k] for k in full])
                yield pa.RecordBatch.from_arrays([pa.array(owners[part][full]), pa.array(fps[full]), pa.array(sizes[full]), pa.array(keys, pa.list_(pa.int32()))], names=["owner", "fp", "size", "keys"])

    return written(texts.mapInArrow(task, "owner long, fp long, size long, keys array<int>"), "near-prefixes"), np.sort(expected.column("key").to_numpy())


def postings(posted: DataFrame, early: np.ndarray) -> DataFrame:
    """A row for each key of each text: key, salt (of keys known to be hot), owner, at (size and place)."""
    salts = partitions(posted.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("keys")
            lengths = np.diff(column.offsets.to_numpy())
            keys = column.flatten().to_numpy()
            owners = np.repeat(batch.column("owner").to_numpy(), lengths)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            salt = np.where(np.isin(keys, early), owners % salts, 0).astype(np.int32)
            columns = [keys, salt, owners, np.repeat(batch.column("size").to_numpy(), lengths) << 32 | place]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "salt", "owner", "at"])

    return posted.select("owner", "size", "keys").mapInArrow(task, "key int, salt int, owner long, at long")


class Prefixes(NamedTuple):
    """Texts of a cell: keys of their prefixes with the number of the text and the place there, and by text the owner, label and size of the set."""

    keys: np.ndarray
    row: np.ndarray
    place: np.ndarray
    owner: np.ndarray
    label: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Prefixes:
        column = rows.column("keys").combine_chunks()
        lengths = np.diff(column.offsets.to_numpy())
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return cls(column.flatten().to_numpy(), row, place, *(rows.column(c).to_numpy() for c in ("owner", "label", "size")))


def promising_cell(home: Prefixes, guest: Prefixes, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As promising(), for all pairs of a home and a guest of different labels that share a key of their prefixes."""
    order = np.argsort(home.keys, kind="stable")
    keys, row, place = home.keys[order], home.row[order], home.place[order]
    low, high = np.searchsorted(keys, guest.keys), np.searchsorted(keys, guest.keys, side="right")
    made = np.concatenate([[0], np.cumsum(high - low)])
    ends = np.searchsorted(guest.row, np.arange(1, len(guest.owner) + 1))  # a guest's keys lie together
    long_home, long_guest = np.bincount(home.row, minlength=len(home.owner)), np.bincount(guest.row, minlength=len(guest.owner))
    g = 0
    while g < len(guest.owner):
        begin = int(ends[g - 1]) if g else 0
        to = max(g + 1, int(np.searchsorted(made[ends], made[begin] + OPEN, side="right")))
        to = min(to, g + max(1, OPEN // len(home.owner)))
        k = np.arange(begin, int(ends[to - 1]))
        # By place, so that the last shared key of a pair is the one that stays.
        k = k[np.argsort(guest.place[k], kind="stable")]
        count = (high - low)[k]
        key = np.repeat(k, count)
        at = np.repeat(low[k], count) + np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
        pair = (guest.row[key] - g) * len(home.owner) + row[at]
        shared = np.bincount(pair, minlength=(to - g) * len(home.owner))
        last_home, last_guest = np.zeros(len(shared), np.int64), np.zeros(len(shared), np.int64)
        last_home[pair], last_guest[pair] = place[at], guest.place[key]
        met = np.flatnonzero(shared)
        u, v = g + met // len(home.owner), met % len(home.owner)
        n, m = guest.size[u], home.size[v]
        rest = np.minimum(np.minimum(n - last_guest[met], m - last_home[met]) - 1, np.maximum(n - long_guest[u], m - long_home[v]))
        ok = (shared[met] + rest >= similarity / (1 + similarity) * (n + m) - 1e-6) & (guest.label[u] != home.label[v])
        if ok.any():
            yield guest.owner[u[ok]], home.owner[v[ok]]
        g = to


class Joined:
    """Labels that links have joined, by the smallest one reached."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def top(self, label: int) -> int:
        while (up := self.above.get(label, label)) != label:
            self.above[label] = self.above.get(up, up)
            label = up
        return label

    def join(self, a: int, b: int) -> bool:
        """Whether two labels were apart so far."""
        a, b = self.top(a), self.top(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


def joining_links(home: pa.Table, guest: pa.Table, similarity: float) -> Iterator[tuple[int, int]]:
    """Verified pairs of a guest's and a home's owner in one cell that join labels which were apart, so that all similar pairs are joined."""
    joined = Joined()
    places = [dict(zip(x.column("owner").to_numpy().tolist(), range(x.num_rows))) for x in (guest, home)]
    columns = [x.column("shingles").combine_chunks() for x in (guest, home)]
    offsets, values = [x.offsets.to_numpy() for x in columns], [x.values.to_numpy() for x in columns]
    labels = [x.column("label").to_numpy() for x in (guest, home)]
    for found in promising_cell(Prefixes.of(home), Prefixes.of(guest), similarity):
        for u, v in zip(*(x.tolist() for x in found)):
            i, j = places[0][u], places[1][v]
            if joined.top(a := int(labels[0][i])) == joined.top(b := int(labels[1][j])):
                continue
            x, y = values[0][offsets[0][i] : offsets[0][i + 1]], values[1][offsets[1][j] : offsets[1][j + 1]]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            if shared >= similarity * (len(x) + len(y) - shared) and joined.join(a, b):
                yield u, v


def neighbours(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of owners of one home that lie close together in Gray order of their turned fingerprints and differ in NEAR_BITS at most; `rows` has owner, home and fp."""

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for turn in TURNS:
                rank = (gray_rank(rotated(fps, turn)) ^ np.uint64(1 << 63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rank), turn, np.int32)), batch.column("home"), pa.array(rank), batch.column("owner"), batch.column("fp")], names=["turn", "home", "rank", "owner", "fp"])

    by = ["turn", "home", "rank", "owner"]
    ranged = rows.mapInArrow(turned, "turn int, home long, rank long, owner long, fp long").repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.empty(0, np.int64)] * 4
        for batch in batches:
            turn, home, owner, fp = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(last, ("turn", "home", "owner", "fp")))
            for ahead in range(1, AHEAD + 1):
                at = np.flatnonzero((turn[ahead:] == turn[:-ahead]) & (home[ahead:] == home[:-ahead]))
                at = at[at + ahead >= len(last[0])]
                at = at[np.bitwise_count((fp[at] ^ fp[at + ahead]).view(np.uint64)) <= NEAR_BITS]
                yield _pair_batch(owner[at], owner[at + ahead])
            last = [x[-AHEAD:] for x in (turn, home, owner, fp)]

    return ranged.mapInArrow(linked, "u long, v long")


def promising(pairs: DataFrame, posted: DataFrame, similarity: float) -> DataFrame:
    """The pairs that can be similar by their whole prefixes.

    Keys that both prefixes reach are counted as shared or not. Further shared ones come after the last shared key in
    both texts, and after the end of the prefix that ends first.
    """
    prefix = posted.dropDuplicates(["owner"])
    left = pairs.join(prefix.select(F.col("owner").alias("u"), F.col("keys").alias("a"), F.col("size").alias("n")), "u")
    both = left.join(prefix.select(F.col("owner").alias("v"), F.col("keys").alias("b"), F.col("size").alias("m")), "v")
    shared = both.withColumn("shared", F.array_intersect("a", "b")).filter(F.size("shared") > 0).withColumn("last", F.element_at("shared", -1))
    rest = F.least(F.col("n") - F.array_position("a", F.col("last")), F.col("m") - F.array_position("b", F.col("last")))
    rest = F.least(rest, F.greatest(F.col("n") - F.size("a"), F.col("m") - F.size("b")))
    return shared.filter(F.size("shared") + rest >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-6).select(*pairs.columns)


def whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], early: np.ndarray, hot_size: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Runs of rows that come in order of key and owner (the first two names): columns, how many texts meet at each row's key, and the first owner met there.

    A key at which more than hot_size texts meet, or that is known to be hot, counts as hot_size + 1 and may come in several runs.
    """
    held: list[np.ndarray] = []
    open_key, open_first = None, 0

    def worked(last: bool):
        nonlocal held, open_key, open_first
        again = np.r_[False, (held[0][1:] == held[0][:-1]) & (held[1][1:] == held[1][:-1])]  # a copy that another task has dealt
        held = [x[~again] for x in held]
        keys, owners = held[:2]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.diff(np.r_[starts, len(keys)])
        firsts, large = owners[starts].copy(), (counts > hot_size) | np.isin(keys[starts], early)
        if open_key is not None and keys[0] == open_key:
            large[0], firsts[0] = True, open_first
        cut = len(keys) if last or large[-1] else int(starts[-1])
        open_key, open_first = (keys[-1], firsts[-1]) if large[-1] else (None, 0)
        run, held = [x[:cut] for x in held], [x[cut:] for x in held]
        if cut:
            yield run, np.repeat(np.where(large, hot_size + 1, counts), counts)[:cut], np.repeat(firsts, counts)[:cut]

    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in names]
        held = [np.concatenate(x) for x in zip(held, columns)] if held else columns
        if len(held[0]) >= ROWS:
            yield from worked(False)
    if held and len(held[0]):
        yield from worked(True)


def counted(dealt: DataFrame, early: np.ndarray, hot_size: int) -> DataFrame:
    """Those rows of postings() at whose keys several texts meet, with how many: key, owner, salt, at, met."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "owner", "salt", "at"]
        for run, count, _ in whole_groups(batches, tuple(names), early, hot_size):
            several = count > 1
            yield pa.RecordBatch.from_arrays([*(pa.array(x[several]) for x in run), pa.array(count[several].astype(np.int32))], names=[*names, "met"])

    return dealt.mapInArrow(task, "key int, owner long, salt int, at long, met int")


def placed(rows: DataFrame, similarity: float) -> DataFrame:
    """The rows of counted() with spot: in the upper half how many keys of the text's prefix come before, in order of counts; in the lower half the key
    just before of those at which several texts meet. Where there is none, all bits are turned.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, ["owner"]):
            key, owner, salt, at = (table.column(c).to_numpy() for c in ("key", "owner", "salt", "at"))
            once = np.r_[True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])]
            key, owner, salt, at = key[once], owner[once], salt[once], at[once]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            counts = np.diff(np.r_[starts, len(owner)])
            order = np.arange(len(owner)) - np.repeat(starts, counts) + prefix_size(at >> 32, similarity) - np.repeat(counts, counts)
            spot = order << 32 | np.r_[0, key[:-1]].astype(np.int64) & 0xFFFFFFFF
            spot[starts] = ~spot[starts]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, owner, salt, at, spot)], names=["key", "owner", "salt", "at", "spot"])

    by = rows.repartition(partitions(rows.sparkSession), "owner").sortWithinPartitions("owner", "met", "key")
    return by.mapInArrow(task, "key int, owner long, salt int, at long, spot long")


def met_pairs(dealt: DataFrame, early: np.ndarray, similarity: float, hot_size: int) -> DataFrame:
    """Candidate pairs u, v; of hot keys instead their members: key, u (owner) and v (the first owner met). `dealt` has the rows of placed() in order of key and owner."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (keys, owners, at, spot), count, firsts in whole_groups(batches, ("key", "owner", "at", "spot"), early, hot_size):
            hot = count > hot_size
            if hot.any():
                yield _found_batch(keys[hot], owners[hot], firsts[hot])
            own = ~hot & (count > 1)
            for u, v in pairs_within(keys[own], owners[own], at[own], spot[own], similarity):
                if len(u):
                    yield _found_batch([None] * len(u), u, v)

    return dealt.mapInArrow(met, "key int, u long, v long")


def similar_links(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, hot_size: int = HOT, cell: int = CELL) -> DataFrame:
    """Verified links (u, v) that join just those owners which some chain of similar sets joins; `texts` has owner (a hash of the text) and text."""
    small_batches(texts.sparkSession)
    parts = partitions(texts.sparkSession)
    posted, early = prefixed(texts, words, similarity, hot_size)
    prints = posted.groupBy("fp").agg(F.min("owner").alias("owner"))
    same = posted.select(F.col("owner").alias("u"), "fp").join(prints.withColumnRenamed("owner", "v"), "fp").select("u", "v")
    by_key = lambda rows: rows.repartition(parts, "key", "salt").sortWithinPartitions("key", "owner")
    shared = placed(counted(by_key(postings(posted, early)), early, hot_size), similarity)
    found = written(met_pairs(by_key(shared), early, similarity, hot_size), "near-pairs")
    members = found.filter("key is not null").select("key", F.col("u").alias("owner"), F.col("v").alias("first"))
    stars = members.groupBy(F.col("owner").alias("u")).agg(F.min("first").alias("v"))
    centres = members.select("key", "first").distinct()
    lowest = centres.groupBy("key").agg(F.min("first").alias("least"))
    between = centres.join(lowest, "key").groupBy(F.col("first").alias("u")).agg(F.min("least").alias("v"))
    homes = stars.join(posted.select(F.col("owner").alias("u"), "fp").distinct(), "u").select(F.col("u").alias("owner"), F.col("v").alias("home"), "fp")
    near = neighbours(homes)
    first = ordered_pairs(same.union(fingerprint_links(prints, FIRST_DIFF)).union(stars).union(between).union(near)).withColumn("first", F.lit(True))
    cold = found.filter("key is null").select("u", "v", F.lit(False).alias("first"))
    every = first.union(cold).groupBy("u", "v").agg(F.max("first").alias("first"))
    likely = written(promising(every, posted, similarity), "near-likely")
    sets = written(sets_of(texts, likely.select(F.col("u").alias("owner")).union(likely.select("v")), words), "near-sets")
    links = written(verified(likely.filter("first").select("u", "v"), sets, similarity), "near-links")
    label = components(links).select(F.col("u").alias("owner"), F.col("v").alias("label"))
    rest = _apart(likely.filter("not first").select("u", "v"), label)
    links = written(links.union(verified(rest, sets, similarity)), "near-links")
    if members.isEmpty():
        return links

    # Hot keys of the same smallest owner, or of owners that meet at a hot key with a smaller one, make a cluster. In
    # each, all pairs of different components: each has a member outside the cluster's largest component.
    label = components(links).select(F.col("u").alias("owner"), F.col("v").alias("label"))
    inside = members.join(lowest, "key").select("least", "owner").distinct()
    hubs = inside.groupBy(F.col("owner").alias("least")).agg(F.min("least").alias("cluster"))
    inside = inside.join(hubs, "least").select("cluster", "owner").distinct()
    marked = written(inside.join(label, "owner", "left").select("cluster", "owner", F.coalesce("label", "owner").alias("label")), "near-marked")
    labels = marked.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    largest = labels.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n")).filter("most.n < n").select("cluster", "most.label")
    open_rows = marked.join(largest.withColumnRenamed("label", "most"), "cluster").join(posted.select("owner", "size", "keys").dropDuplicates(["owner"]), "owner")
    weights = open_rows.groupBy("cluster").agg(F.sum("size").alias("all"), F.sum(F.when(F.col("label") != F.col("most"), F.col("size"))).alias("outside"))
    cuts = weights.select("cluster", F.ceil(F.col("all") / cell).cast("long").alias("rows"), F.ceil(F.col("outside") / cell).cast("long").alias("columns"))
    open_rows = open_rows.join(cuts, "cluster")
    spot, what = F.xxhash64("owner"), ("owner", "label", "size", "keys")
    homes = open_rows.select("cluster", F.pmod(spot, F.col("rows")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("j"), F.lit(0).alias("side"), *what)
    guests = open_rows.filter("label != most").select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("i"), F.pmod(F.shiftright(spot, 20), F.col("columns")).alias("j"), F.lit(1).alias("side"), *what)

    def cells_of(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[pa.Table, pa.Table]]:
        for rows in whole_keys(batches, ["cluster", "i", "j"], least):
            cluster, i, j, side = (rows.column(c).to_numpy() for c in ("cluster", "i", "j", "side"))
            new = np.flatnonzero(np.r_[True, (cluster[1:] != cluster[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            for start, end in zip(new.tolist(), [*new[1:].tolist(), len(cluster)]):
                home, guest = start + np.flatnonzero(side[start:end] == 0), start + np.flatnonzero(side[start:end] == 1)
                if len(home) and len(guest):
                    yield rows.take(pa.array(home)), rows.take(pa.array(guest))

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, guest in cells_of(batches, WHOLE_ROWS):
            met = [np.zeros(x.num_rows, bool) for x in (guest, home)]
            owners = [x.column("owner").to_numpy() for x in (guest, home)]
            order = [np.argsort(x) for x in owners]
            for found in promising_cell(Prefixes.of(home), Prefixes.of(guest), similarity):
                for k, own in enumerate(found):
                    met[k][order[k][np.searchsorted(owners[k], own, sorter=order[k])]] = True
            for rows, some in zip((guest, home), met):
                yield from rows.filter(pa.array(some)).to_batches()

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, guest in cells_of(batches, WHOLE_ROWS):
            u, v = np.array(list(joining_links(home, guest, similarity)), np.int64).reshape(-1, 2).T
            yield _pair_batch(np.maximum(u, v), np.minimum(u, v))

    place = ("cluster", "i", "j")
    cells = homes.union(guests).repartition(parts, *place).sortWithinPartitions(*place)
    schema = "cluster long, i long, j long, side int, owner long, label long, size long, keys array<int>"
    chosen = written(cells.mapInArrow(involved, schema), "near-involved")
    if chosen.isEmpty():
        return links
    whole = written(sets_of(texts, chosen.select("owner"), words), "near-sets")
    again = chosen.join(whole, "owner").repartition(parts, *place).sortWithinPartitions(*place)
    return links.union(written(again.mapInArrow(crossed, "u long, v long").distinct(), "near-crossed"))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose ends have different labels; an owner without one is its own."""
    named = pairs.join(label.withColumnsRenamed({"owner": "u", "label": "a"}), "u", "left").join(label.withColumnsRenamed({"owner": "v", "label": "b"}), "v", "left")
    return named.filter(F.coalesce("a", "u") != F.coalesce("b", "v")).select("u", "v")


def similar_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, **options) -> DataFrame:
    """doc_id, copy (a 64-bit hash of the text) and component_id, the smallest doc_id reachable by copies and similar texts.

    One row for each doc_id and text, so that repeated rows are one. A null text counts as empty; empty texts are copies
    of each other. A component whose ids are all null has none. Rows that share a doc_id have nothing else in common.
    Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"), _copy().alias("owner"))
    return _labelled(rows, words, similarity, **options).select("doc_id", F.col("owner").alias("copy"), "component_id")


def _labelled(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, **options) -> DataFrame:
    links = similar_links(rows.select("owner", "text"), words, similarity, **options)
    reached = components(links).select(F.col("u").alias("owner"), F.col("v").alias("label"))
    ids = written(rows.select("doc_id", "owner").distinct(), "near-ids")
    labelled = ids.join(reached, "owner", "left").select("doc_id", "owner", F.coalesce("label", "owner").alias("label"))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(least, "label")


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of similar_groups(): of the smallest doc_id, and of that one's texts the one with the smallest hash.

    All columns stay as they were, whatever their names. A group whose ids are all null keeps one row, too. Of repeated
    rows (doc_id and text) one stays.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"), _copy().alias("owner"))
    groups = written(_labelled(rows, **options).select("label", "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("owner").alias("copy")), "near-groups")
    first = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "id", "copy")).alias("x")).select("x.id", "x.copy")
    gone = written(groups.join(first, ["id", "copy"], "left_anti").select(F.col("id").alias("near id"), F.col("copy").alias("near copy")), "near-gone")
    twice = written(docs.groupBy(_id().alias("near id"), _copy().alias("near copy")).count().filter("count > 1").drop("count"), "near-twice")
    # Only rows that may go or be repeated are joined, as joins shuffle whole texts once these tables are large.
    marks = gone.union(twice).select(F.xxhash64("near id", "near copy"))
    shared = docs.sparkSession.sparkContext.broadcast(BitFilter.of(marks, FILTER_BITS))

    @F.arrow_udf("boolean")
    def marked(hashes: pa.Array) -> pa.Array:
        return pa.array(shared.value.may_hold(hashes.to_numpy()))

    row = docs.select(F.struct("*").alias("row"), _id().alias("near id"), _copy().alias("near copy"))
    row = row.withColumn("marked", marked(F.xxhash64("near id", "near copy")))
    sure = row.filter(~F.col("marked"))
    kept = row.filter("marked").join(gone, ["near id", "near copy"], "left_anti").select(*sure.columns)
    if twice.isEmpty():
        return sure.union(kept).select("row.*")
    again = kept.join(twice, ["near id", "near copy"], "left_semi").dropDuplicates(["near id", "near copy"])
    return sure.union(kept.join(twice, ["near id", "near copy"], "left_anti").select(*sure.columns)).union(again.select(*sure.columns)).select("row.*")


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _copy():
    return F.xxhash64(plain_text())
