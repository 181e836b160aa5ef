"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are dealt by an equal block of bits: if two of them differ in at most d bits, one of d + 1 blocks is
equal in both, so each fingerprint goes once to each of d + 1 tables, keyed by that table's block. A task sorts what
it got by Gray rank with the block's bits in front. Fingerprints that share leading bits then lie together, and
each such run is an index node that keeps the bits shared by all its members (a masked pattern). The search walks pairs of nodes
from the top and adds up the bits in which their shared patterns conflict; once these are more than d, all pairs
below are dropped together. Links are joined to groups inside the task, so that a group of g fingerprints leaves it
as at most g - 1 links, and the links of all tasks make components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import partitions, plain_text, table, written
from .components import components

WORDS = 3
SEED = 42
MAX_DIFF = 2
BITS = 64
#: Bits by which each index level is longer than the one above.
STEP = 6
#: Node pairs that one step of the search opens at most.
OPEN = 1 << 20
#: Rows of one block value above which the block's rows are dealt again by a second block.
HOT_BLOCK = 100_000


# ---------------------------------------------------------------------------------------------- fingerprints


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of each run of so many words, repeats included; fewer words are one run, none gives nothing."""
    found = text.encode().lower().split()  # of bytes: A-Z only, and the six ASCII white space characters
    if not found:
        return np.empty(0, np.uint64)
    runs = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[k:] for k in range(words))))
    return np.fromiter((xxhash.xxh64_intdigest(run, SEED) for run in runs), np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """For each text, the bits that are set in over half of its hashes; zero where there are none."""
    found = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes])
    own = np.flatnonzero(sizes)
    if len(own):
        octets = np.concatenate([hashes[i] for i in own]).astype(">u8").view(np.uint8).reshape(-1, 8)
        starts = np.cumsum(sizes[own]) - sizes[own]
        set_bits = np.add.reduceat(np.unpackbits(octets, axis=1), starts, axis=0, dtype=np.int32)
        found[own] = np.packbits(2 * set_bits > sizes[own][:, None], axis=1).view(">u8").ravel()
    return found


def fingerprint_texts(texts: list[str], words: int = WORDS, room: int = 1 << 15) -> np.ndarray:
    found, run, held = [], [], 0
    for text in texts:
        run.append(shingle_hashes(text, words))
        held += len(run[-1])
        if held >= room:
            found.append(majority(run))
            run, held = [], 0
    return np.concatenate([*found, majority(run)]) if run or found else np.empty(0, np.uint64)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of each row; a null text is an empty one, whose fp is 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = fingerprint_texts(batch.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    return rows.mapInArrow(task, "doc_id long, fp long")


# ---------------------------------------------------------------------------------------------------- index


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def rotated(codes: np.ndarray, by) -> np.ndarray:
    """The codes with their first `by` bits moved to the end."""
    by = np.asarray(by).astype(np.uint64)
    return np.where(by == 0, codes, (codes << by) | (codes >> (np.uint64(BITS) - by) % np.uint64(BITS)))


def _groups(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of a forest, with links added: each place's label is the smallest place it reaches."""
    while True:
        x, y = labels[a], labels[b]
        differs = x != y
        if not differs.any():
            return labels
        a, b, x, y = a[differs], b[differs], x[differs], y[differs]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]


class GrayIndex:
    """The index over codes that are dealt by `keys`: only codes of one key are compared."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray, lead: int) -> None:
        self.order = np.lexsort((gray_rank(codes), keys))
        keys, codes = keys[self.order], codes[self.order]
        n = len(codes)
        new_key = np.r_[True, keys[1:] != keys[:-1]] if n else np.empty(0, bool)
        self.starts, self.ones, self.zeros = [], [], []
        for bits in [lead, *range(lead + STEP, BITS, STEP), BITS]:
            prefix = codes >> np.uint64(BITS - bits) if bits else np.zeros(n, np.uint64)
            starts = np.flatnonzero(new_key | np.r_[True, prefix[1:] != prefix[:-1]]) if n else np.empty(0, np.int64)
            self.starts.append(starts)
            self.ones.append(np.bitwise_and.reduceat(codes, starts) if n else codes)
            self.zeros.append(~np.bitwise_or.reduceat(codes, starts) if n else codes)
        self.children = [np.r_[np.searchsorted(low, high), len(low)] for high, low in zip(self.starts, self.starts[1:])]

    def links(self, max_diff: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different codes of a key that differ in at most max_diff bits, as places in the input, in portions."""
        if not len(self.order):
            return
        # A node whose members are one code has nothing to find within itself.
        top = np.flatnonzero(np.diff(np.r_[self.starts[0], len(self.order)]) > 1)
        stack = [(0, top, top)]
        while stack:
            level, a, b = stack.pop()
            if level == len(self.starts) - 1:
                yield self.order[self.starts[level][a]], self.order[self.starts[level][b]]
                continue
            first, count = self.children[level], np.diff(self.children[level])
            made = count[a] * count[b]
            if len(a) > 1 and made.sum() > OPEN:
                cut = min(max(1, int(np.searchsorted(np.cumsum(made), OPEN))), len(a) - 1)
                stack += [(level, a[cut:], b[cut:]), (level, a[:cut], b[:cut])]
                continue
            of = np.repeat(np.arange(len(a)), made)
            k = np.arange(len(of)) - np.repeat(np.cumsum(made) - made, made)
            x, y = first[a][of] + k // count[b][of], first[b][of] + k % count[b][of]
            keep = x <= y
            x, y = x[keep], y[keep]
            ones, zeros = self.ones[level + 1], self.zeros[level + 1]
            apart = np.bitwise_count((ones[x] & zeros[y]) | (zeros[x] & ones[y])) <= max_diff
            x, y = x[apart], y[apart]
            size = np.diff(np.r_[self.starts[level + 1], len(self.order)])
            alone = (x == y) & (size[x] == 1)
            x, y = x[~alone], y[~alone]
            if level + 1 == len(self.starts) - 1:
                x, y = x[x != y], y[x != y]
            if len(x):
                stack.append((level + 1, x, y))


def _blocks(count: int, low: int = 0, high: int = BITS) -> list[tuple[int, int]]:
    """The first bit and the length of each of so many blocks of nearly equal length."""
    ends = [low + (high - low) * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _block_bits(code, first: int, length: int):
    """The bits of a block of a long column, counted from the highest."""
    return F.shiftrightunsigned(F.shiftleft(code, first) if first else code, BITS - length)


def _linked(blocks: list[tuple[int, int]], max_diff: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        spots, keys, codes, owners = (rows.column(c).to_numpy() for c in ("block", "key", "fp", "owner"))
        for spot, (first, length) in enumerate(blocks):
            own = np.flatnonzero(spots == spot)
            if len(own) < 2:
                continue
            index = GrayIndex(keys[own], rotated(codes[own].view(np.uint64), first), length)
            own_owners = owners[own]
            by_owner = np.argsort(own_owners, kind="stable")  # labels are places in the order of owners
            place = np.empty_like(by_owner)
            place[by_owner] = np.arange(len(by_owner))
            labels = np.arange(len(own))
            for a, b in index.links(max_diff):
                labels = _groups(labels, place[a], place[b])
            moved = np.flatnonzero(labels != np.arange(len(own)))
            if len(moved):
                u, v = own_owners[by_owner[moved]], own_owners[by_owner[labels[moved]]]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return task


def fingerprint_links(nodes: DataFrame, max_diff: int = MAX_DIFF) -> DataFrame:
    """Links (u, v) between owners that join just those fingerprints which some chain of near fingerprints joins.

    `nodes` has each fingerprint once: fp long, owner long, both different in each row and never null.
    """
    blocks = _blocks(max_diff + 1)
    spread = F.array(*(F.struct(F.lit(k).alias("block"), _block_bits(F.col("fp"), a, n).alias("key")) for k, (a, n) in enumerate(blocks)))
    dealt = nodes.select("fp", "owner", F.explode(spread).alias("x")).select("x.block", "x.key", "fp", "owner")
    # A block value that many fingerprints share is dealt again by blocks of the remaining bits, by the same argument.
    hot = dealt.groupBy("block", "key").count().filter(F.col("count") > HOT_BLOCK).select("block", "key", F.lit(True).alias("hot"))
    marked = dealt.join(hot, ["block", "key"], "left")
    parts = partitions(nodes.sparkSession)
    plain = marked.filter("hot is null").select("block", "key", "fp", "owner").repartition(parts, "block", "key")
    found = plain.mapInArrow(_linked(blocks, max_diff), "u long, v long")
    finer, again = [], []
    for k, (a, n) in enumerate(blocks):
        rest = [(x, m) for low, high in ((0, a), (a + n, BITS)) for x, m in _blocks(max_diff + 1, low, high) if m]
        # d differing bits leave at least one of any d + 1 blocks equal; both sides of the block are cut into d + 1.
        for x, m in rest:
            again.append((k, x, m))
            finer.append(F.struct(F.lit(len(finer)).alias("block"), F.lit(k).alias("of"), F.col("key").alias("outer"), _block_bits(F.col("fp"), x, m).alias("inner")))
    denser = (
        marked.filter("hot").select("block", "key", "fp", "owner").withColumnRenamed("block", "was")
        .select("was", "fp", "owner", F.explode(F.array(*finer)).alias("x")).filter("x.of = was")
        .select("x.block", F.xxhash64("x.outer", "x.inner").alias("key"), "fp", "owner").repartition(parts, "block", "key")
    )
    return found.union(denser.mapInArrow(_linked([(x, m) for _, x, m in again], max_diff), "u long, v long"))


def near_groups(docs: DataFrame, words: int = WORDS, max_diff: int = MAX_DIFF) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links of at most max_diff bits) of each row.

    Rows with equal texts, null ones included, have equal fingerprints and so one component. Rows that repeat a
    doc_id are rows of their own; a null doc_id never names a component unless all its members are null. Other
    columns are not read; an empty table gives no rows.
    """
    rows = written(fingerprints(docs, words), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    # Nodes are fingerprints, as one doc_id may own several of them.
    links = fingerprint_links(nodes.select("fp", F.col("fp").alias("owner")), max_diff)
    reached = components(links).select(F.col("u").alias("fp"), F.col("v").alias("label"))
    labelled = nodes.join(reached, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    settled = written(labelled.join(named, "label").select("fp", "component_id"), "settled")
    return rows.join(settled, "fp").select("doc_id", "fp", "component_id")


def op8_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op8_gray_index": op8_gray_index}
SQL: dict[str, str] = {}
