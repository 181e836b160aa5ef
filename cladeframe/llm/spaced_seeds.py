"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over a run of words: words at its marked places are hashed together, those at its other places may
differ. The seeds of the benchmark items are joined with the seeds of every window of every document; around each
hit, the item is laid beside the document and the run of words with the best score (a match counts one, a
substitution takes one off) is the verified overlap. A document that holds an item with some words replaced keeps whole seeds
between the replaced words, and unrelated texts that share a seed by chance fail the verification.

The seeds of documents and items are equi-joined by Spark. A document's seeds are dealt only if a bit table of bounded
size says that an item may have them; both sides carry a salt, so that a seed which very many documents hold is
joined by many tasks. Texts with a hit, whole and once for all copies, are then verified with the items they hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import BitFilter, plain_text, slices, table, written
from .words import mixed, words_of

#: Masks of six marked places each; a window is as long as its mask.
MASKS = ("111111", "1101011001", "10110010111")
#: Further masks for items of fewer than SHORT words, so that every accepted overlap of them has a seed hit.
SHORT_MASKS, SHORT = ("1111", "11011", "10111"), 21
#: Fewest words that an overlap must match, and the part of its words that must match.
LEAST_MATCHES = 10
LEAST_IDENTITY = 0.75
#: Items of fewer words are too common to tell anything, and match nothing.
FEWEST = 5
#: Bits of the table of the benchmark's seeds, parts among which each seed is dealt, and items that are verified at once.
SEED_BITS, SALTS, AT_ONCE = 1 << 24, 16, 500
CHARS = 1 << 19
#: Cells of the comparison table that are held at a time.
CELLS = 1 << 21
SCHEMA = "doc_id long, item_id long, doc_word long, item_word long, n_words long, n_matches long"


def seeds(words: np.ndarray, of: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """The seed hash of each window that lies in one text, and the window's first word."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found = np.zeros(n, np.uint64)
    for k, mark in enumerate(mask):
        if mark == "1":
            found = found * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    whole = np.flatnonzero(of[:n] == of[len(mask) - 1 :])
    return mixed(found[whole]), whole


def masks_of(sizes: set[int], masks: tuple[str, ...] = MASKS) -> list[tuple]:
    """The masks that items of these sizes need, each with a test of the sizes that have it (None: all).

    An item shorter than a mask has its whole run of words as mask; those under SHORT words have the short masks, too.
    """
    own = {"1" * n: n for n in sorted(sizes) if 0 < n < max(map(len, masks)) and "1" * n not in masks}
    found = [(m, None) for m in masks] + [(m, lambda size, n=n: size == n) for m, n in own.items()]
    return found + [(m, lambda size: size < SHORT) for m in SHORT_MASKS if any(0 < n < SHORT for n in sizes)]


def keyed(keys: np.ndarray, mask: str) -> np.ndarray:
    """Seeds of all masks in one space of keys, as longs."""
    return mixed(keys ^ np.uint64(int(mask, 2) << 8 | len(mask))).view(np.int64)


class Benchmark:
    """The items' words and seeds. An item shorter than a mask has its whole run of words as seed of that length."""

    def __init__(self, ids: list, texts: list[str], masks: tuple[str, ...] = MASKS, least: int = LEAST_MATCHES, identity: float = LEAST_IDENTITY) -> None:
        self.least, self.identity = least, identity
        self.words, of = words_of(texts)[:2]
        self.sizes = np.bincount(of, minlength=len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = ids
        self.masks, lows = [], []
        for m, fits in masks_of({int(n) for n in self.sizes}, masks):
            self.masks.append(m)
            lows.append(None if fits is None else np.array([fits(int(n)) for n in self.sizes], bool))
        self.keys, self.places = [], []
        for mask, low in zip(self.masks, lows):
            keys, first = seeds(self.words, of, mask)
            if low is not None:
                own = low[of[first]]
                keys, first = keys[own], first[own]
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order])
            self.places.append(first[order])
        self.of = of

    def overlaps(self, texts: list[str]) -> list[tuple]:
        """(text number, item number, first word in the text, in the item, words, matches) of each verified overlap: the best of each text and item."""
        words, of = words_of(texts)[:2]
        found = []
        for mask, keys, places in zip(self.masks, self.keys, self.places):
            if not len(keys):
                continue
            own, first = seeds(words, of, mask)
            low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
            count = high - low
            hit = np.repeat(np.arange(len(own)), count)
            item_at = places[np.repeat(low, count) + np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)]
            item = self.of[item_at]
            # The place in the documents' words where the item's first word would lie.
            found.append(np.stack([of[first[hit]], item, first[hit] - (item_at - self.starts[item])]))
        if not found or not sum(x.shape[1] for x in found):
            return []
        text, item, at = np.unique(np.concatenate(found, axis=1), axis=1)
        width = int(self.sizes[item].max())
        best: dict[tuple, tuple] = {}
        for k in range(0, len(text), max(1, CELLS // width)):
            s = slice(k, k + max(1, CELLS // width))
            t, i, a = text[s], item[s], at[s]
            column = np.arange(width)
            spot = a[:, None] + column
            valid = (column < self.sizes[i][:, None]) & (spot >= 0) & (spot < len(words))
            spot = np.where(valid, spot, 0)
            valid &= of[spot] == t[:, None]
            same = valid & (words[spot] == self.words[np.minimum(self.starts[i][:, None] + column, len(self.words) - 1)])
            score = np.where(same, 1, np.where(valid, -1, -width - 1)).astype(np.int64)
            total = np.concatenate([np.zeros((len(t), 1), np.int64), np.cumsum(score, axis=1)], axis=1)
            lowest = np.minimum.accumulate(total, axis=1)
            end = np.argmax(total - lowest, axis=1)
            row = np.arange(len(t))
            # The latest place with the lowest total before the end gives the shortest of equally good runs.
            lows = np.maximum.accumulate(np.where(total == lowest, np.arange(width + 1), 0), axis=1)
            start = lows[row, end]
            matched = np.concatenate([np.zeros((len(t), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
            n, m = end - start, matched[row, end] - matched[row, start]
            size = self.sizes[i]
            ok = (m >= np.minimum(self.least, np.maximum(FEWEST, np.ceil(0.8 * size)))) & (m >= self.identity * n)
            for x in np.flatnonzero(ok):
                key, value = (int(t[x]), int(i[x])), (int(m[x]), -int(a[x] + start[x]), int(start[x]), int(n[x]))
                best[key] = max(best.get(key, value), value)
        first_word = np.searchsorted(of, np.arange(len(texts)))
        return [(t, i, -at - int(first_word[t]), start, n, m) for (t, i), (m, at, start, n) in sorted(best.items())]


def item_seeds(items: DataFrame) -> DataFrame:
    """key and item of each seed of the items (item, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, at = batch.column("item").to_numpy(), 0
            for run in slices(batch.column("text"), CHARS):
                index = Benchmark([], run)
                for mask, keys, places in zip(index.masks, index.keys, index.places):
                    columns = [keyed(keys, mask), numbers[at + index.of[places]]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "item"])
                at += len(run)

    return items.mapInArrow(task, "key long, item long").distinct()


def text_seeds(texts: DataFrame, masks: list[str], known: BitFilter) -> DataFrame:
    """row and key of the seeds of the texts (row, text) that `known` may hold, each once for a text."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, at = batch.column("row").to_numpy(), 0
            for run in slices(batch.column("text"), CHARS):
                words, of = words_of(run)[:2]
                rows, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for mask in masks:
                    own, first = seeds(words, of, mask)
                    own = keyed(own, mask)
                    hit = np.flatnonzero(shared.value.may_hold(own))
                    rows.append(numbers[at + of[first[hit]]])
                    keys.append(own[hit])
                once = np.unique(np.stack([np.concatenate(rows), np.concatenate(keys)]), axis=1)
                at += len(run)
                if once.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(once[0]), pa.array(once[1])], names=["row", "key"])

    return texts.mapInArrow(task, "row long, key long")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longest = max(SHORT, *map(len, MASKS))
    for batch in batches:
        texts = batch.column("text").to_pylist()
        counts = np.concatenate([np.bincount(words_of(run)[1], minlength=len(run)) for run in slices(texts, CHARS)] or [np.empty(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.minimum(counts, longest)), pa.int64())], names=["n"])


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_MATCHES, identity: float = LEAST_IDENTITY) -> DataFrame:
    """A row for each document and benchmark item that share a verified run of words, with the best such run.

    doc_id, item_id, doc_word and item_word (where the run begins), n_words, n_matches. Words are runs of letters and
    digits, whatever their case. A run needs `least` matching words (of a short item 80 % of its words, five at least) and the part
    `identity` of its words. Null or empty texts match nothing. Repeated rows of documents each count, repeated rows of the benchmark
    are one item; an item of another text is another one, even if it has the same item_id. An empty table on either
    side gives no rows. Other columns are not read. Copies of a text are told by a hash of 64 bits and are verified once.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain_text().alias("text")).filter("text != ''").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    # At most as many rows as a short item can have words.
    sizes = {x.n for x in items.select("text").mapInArrow(_sizes, "n long").distinct().collect()}
    wanted = written(item_seeds(items), "benchmark-seeds")
    known = BitFilter.of(wanted.select("key"), SEED_BITS)
    texts = docs.select(F.xxhash64(plain_text()).alias("row"), plain_text().alias("text"))
    hits = text_seeds(texts, [m for m, _ in masks_of(sizes)], known)
    salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = hits.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    pairs = written(met.select("row", "item").distinct(), "benchmark-hits")
    # Of a text with very many items, so many at once.
    runs = pairs.groupBy("row").agg(F.ceil(F.count("*") / AT_ONCE).alias("runs"))
    grouped = pairs.join(runs, "row").join(items, "item").groupBy("row", F.pmod("item", F.col("runs")).alias("run")).agg(F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("items"))
    hit_texts = texts.join(runs.select("row"), "row", "left_semi").dropDuplicates(["row"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, text, own in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "items"))):
                index = Benchmark([x["item_id"] for x in own], [x["text"] for x in own], least=least, identity=identity)
                found += [(row, index.ids[i], *rest) for _, i, *rest in index.overlaps([text])]
            if found:
                names = ["row", "item_id", "doc_word", "item_word", "n_words", "n_matches"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=names)

    checked = written(hit_texts.join(grouped, "row").mapInArrow(task, SCHEMA.replace("doc_id", "row")), "benchmark-overlaps")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(plain_text()).alias("row"))
    return ids.join(checked, "row").drop("row")


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("identity", F.col("n_matches") / F.col("n_words"))


QUERIES = {"op10_spaced_seeds": op10_spaced_seeds}
SQL: dict[str, str] = {}
