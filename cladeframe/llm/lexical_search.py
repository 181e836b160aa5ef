"""Ranked lexical search: a threshold-seeded join of items with all documents.

Each text is read once; of its terms, those that some item has are stored with their frequencies (postings, a row a
document). From the postings come the numbers of documents per term, each term's largest impact and its k-th largest one,
stored per term. An item's k-th score cannot be lower than the largest k-th impact of its terms: that seeds its threshold.
Its terms are ordered by their largest impacts; those whose sum from the smallest up stays below the threshold cannot lift
a document over it by themselves, so they raise no candidates. Documents with other terms are candidates if what they
have of those, and all that the pruned terms could add, reach the threshold, and only candidates are rescored by all terms.
Each task raises its own thresholds by the k-th score that it has found, and passes on its k best documents an item, from
which the k best of all follow. A bound that ties with a threshold prunes nothing, so equal scores keep their order by id.

Items are dealt with in blocks of BLOCK_TERMS terms, so that what a task holds of them has a bound whatever their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import plain_text, table, written

BEST = 50
#: Terms of items that one block holds at most, and those of an item that alone has more.
BLOCK_TERMS = 500_000
#: Scores that a task adds up at once (documents times items).
CELLS = 1 << 21
#: Documents that are looked at together, at most.
DOCUMENTS = 1 << 12
#: ASCII letters become lower case; other bytes below 128, but for digits, part terms.
_FOLD = bytes(b | 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of items (item_id, text), each term once. Rows of one item_id are one item with the terms of all."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = sorted(set(terms_of(batch.column("text")[k].as_py())))
                if found:
                    ids = pa.array([batch.column("item_id")[k].as_py()] * len(found), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.binary())], names=["item_id", "term"])

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), plain_text().cast("binary").alias("text"))
    return texts.mapInArrow(task, "item_id long, term binary").distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (its terms with repeats), and the numbers and frequencies of its terms that the vocabulary has: terms, tfs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sizes, ends, ids, tfs = [], [0], [], []
                for text in part.column("text"):
                    counted = Counter(terms_of(text.as_py()))
                    own = [(known[t], n) for t, n in counted.items() if t in known]
                    sizes.append(counted.total())
                    ids += [t for t, _ in own]
                    tfs += [n for _, n in own]
                    ends.append(len(ids))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((ids, pa.int32()), (tfs, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().cast("binary").alias("text"))
    return texts.mapInArrow(task, "doc_id long, n long, terms array<int>, tfs array<long>")


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of postings: the row of each posting, its term and its frequency."""
    terms, tfs = batch.column("terms"), batch.column("tfs")
    rows = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
    return rows, terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)


def document_counts(found: DataFrame, size: int) -> DataFrame:
    """(term, df) of postings; a task counts all it has before the rows are shuffled."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.zeros(size, np.int64)
        for batch in batches:
            counted += np.bincount(_lists(batch)[1], minlength=size)
        held = np.flatnonzero(counted)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counted[held])], names=["term", "df"])

    return found.select("terms", "tfs").mapInArrow(task, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def impacts(weights: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))


def _lengths(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    return 50 + (50 * n * documents) // max(words, 1)


def _first_of_each(keys: np.ndarray, k: int) -> np.ndarray:
    """Whether each of some sorted keys is among the first k of its own."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)])) < k


def term_bounds(found: DataFrame, weights: np.ndarray, documents: int, words: int, best: int) -> DataFrame:
    """(term, top, kth): each term's largest impact and its k-th largest one, 0 if it has fewer. A task passes on the k largest."""
    shared = found.sparkSession.sparkContext.broadcast(weights)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, values = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            rows, own, tfs = _lists(batch)
            m = _lengths(batch.column("n").to_numpy(), documents, words)[rows]
            terms, values = np.r_[terms, own], np.r_[values, impacts(shared.value, own, tfs, m)]
            order = np.lexsort((-values, terms))
            order = order[_first_of_each(terms[order], best)]
            terms, values = terms[order], values[order]
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array(values)], names=["term", "impact"])

    largest = found.select("n", "terms", "tfs").mapInArrow(task, "term int, impact long")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    ranked = largest.withColumn("place", place).filter(F.col("place") <= best)
    kth = F.coalesce(F.max(F.when(F.col("place") == best, F.col("impact"))), F.lit(0))
    return ranked.groupBy("term").agg(F.max("impact").alias("top"), kth.alias("kth"))


def seeded(items: DataFrame, bounds: DataFrame) -> DataFrame:
    """Items' terms (item, term) with their item's threshold, whether the term raises candidates, and what it adds at most.

    The terms are ordered by `top`; those whose running sum from the smallest stays below the threshold raise none.
    """
    own = Window.partitionBy("item")
    rows = items.join(bounds, "term").withColumn("threshold", F.max("kth").over(own))
    up_to = F.sum("top").over(own.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("raises", up_to >= F.col("threshold")).select("item", "term", "top", "threshold", "raises")


class Block:
    """Items of a block by term: those of terms that raise candidates, and those of the others."""

    def __init__(self, size: int, items: int, item: np.ndarray, term: np.ndarray, top: np.ndarray, threshold: np.ndarray, raises: np.ndarray) -> None:
        self.items = items
        self.thresholds, self.rest = np.zeros(items, np.int64), np.zeros(items, np.int64)
        self.thresholds[item] = threshold
        np.add.at(self.rest, item[~raises], top[~raises])
        self.raising, self.others = (self._by_term(size, item[x], term[x]) for x in (raises, ~raises))

    @staticmethod
    def _by_term(size: int, item: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(size + 1)), item[order]

    @staticmethod
    def expanded(by_term: tuple[np.ndarray, np.ndarray], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of a posting and an item that has its term: the posting's place and the item."""
        starts, items = by_term
        first, counts = starts[terms], starts[terms + 1] - starts[terms]
        at = np.repeat(np.arange(len(terms)), counts)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        return at, items[first[at] + inner]


def block_scores(found: DataFrame, block: Block, weights: np.ndarray, documents: int, words: int, best: int) -> DataFrame:
    """(item, doc_id, score): of each task, the `best` documents of each item, and no others."""
    shared = found.sparkSession.sparkContext.broadcast((block, weights))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = shared.value
        least = block.thresholds.copy()
        kept = [np.empty(0, np.int64) for _ in range(4)]  # item, score, whether the id is null, id
        step = max(1, min(DOCUMENTS, CELLS // block.items))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                kept = best_of(kept, candidates(part, block, weights, least), part)
                full = np.flatnonzero(kept[0][best - 1 :] == kept[0][: max(0, len(kept[0]) - best + 1)])
                least[kept[0][full]] = np.maximum(least[kept[0][full]], kept[1][full + best - 1])
        ids = pa.array(kept[3], mask=kept[2].astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(kept[0].astype(np.int32)), ids, pa.array(kept[1])], names=["item", "doc_id", "score"])

    def candidates(part: pa.RecordBatch, block: Block, weights: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, terms, tfs = _lists(part)
        own = impacts(weights, terms, tfs, _lengths(part.column("n").to_numpy(), documents, words)[rows])
        scores = np.zeros(part.num_rows * block.items, np.int64)
        at, item = block.expanded(block.raising, terms)
        np.add.at(scores, rows[at] * block.items + item, own[at])
        grid = scores.reshape(part.num_rows, block.items)
        alive = (grid > 0) & (grid + block.rest >= least)
        some = alive.any(axis=1)[rows]
        at, item = block.expanded(block.others, terms[some])
        cells = rows[some][at] * block.items + item
        np.add.at(scores, cells, own[some][at])
        alive &= grid >= least
        row, item = np.nonzero(alive)
        return row, item, grid[row, item]

    def best_of(kept: list[np.ndarray], new: tuple[np.ndarray, np.ndarray, np.ndarray], part: pa.RecordBatch) -> list[np.ndarray]:
        row, item, score = new
        if not len(row):
            return kept
        column = part.column("doc_id")
        void = column.is_null().to_numpy(zero_copy_only=False).astype(np.int64)[row]
        ids = column.fill_null(0).to_numpy()[row]
        kept = [np.r_[a, b] for a, b in zip(kept, (item, score, void, ids))]
        order = np.lexsort((kept[3], kept[2], -kept[1], kept[0]))
        order = order[_first_of_each(kept[0][order], best)]
        return [x[order] for x in kept]

    return found.mapInArrow(task, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The `best` documents (doc_id, text) of each item (item_id, text): item_id, rank from 1, doc_id, score.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. Null and
    empty texts have none; they are never found, and items without terms get no rows. Equal scores are ordered by
    doc_id, a null one last; repeated rows of documents are documents of their own. Rows with one item_id (also null)
    are one item. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    listed = written(item_terms(items), "search-terms")
    sizes = listed.groupBy("item_id").agg(F.count("*").alias("n"))
    number = F.row_number().over(Window.orderBy(F.col("item_id").asc_nulls_first())) - 1  # one row an item of the stated query set
    before = F.sum("n").over(Window.orderBy("item").rowsBetween(Window.unboundedPreceding, -1))
    numbered = sizes.withColumn("item", number).withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / block_terms).cast("int"))
    numbered = written(numbered, "search-items")
    parts = [_block(docs, listed, numbered.filter(F.col("block") == b.block), best) for b in numbered.select("block").distinct().collect()]
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    top = found.withColumn("rank", place).filter(F.col("rank") <= best)
    return top.join(numbered.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _block(docs: DataFrame, listed: DataFrame, numbered: DataFrame, best: int) -> DataFrame:
    """(item, doc_id, score) of the items of one block: every document that can be among an item's best, and few others."""
    spark = docs.sparkSession
    on = listed["item_id"].eqNullSafe(numbered["item_id"])
    pairs = listed.join(numbered, on).select("item", "term").toPandas()  # as many rows as a block may have
    vocabulary = {term: k for k, term in enumerate(sorted({bytes(t) for t in pairs["term"]}))}
    term = np.array([vocabulary[bytes(t)] for t in pairs["term"]], np.int32)
    low = int(pairs["item"].min())
    own = spark.createDataFrame(pa.table({"item": pa.array((pairs["item"] - low).astype("int32")), "term": pa.array(term)}))
    found = written(postings(docs, vocabulary), "search-postings")
    documents, words = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = document_counts(found, len(vocabulary))
    weight = F.floor(1000 * F.log((F.lit(2 * documents) + 2) / (2 * F.col("df") + 1)))
    rows = counted.select("term", weight.alias("w")).toArrow()  # a row a term of the block
    weights = np.zeros(len(vocabulary), np.int64)
    weights[rows.column("term").to_numpy()] = rows.column("w").to_numpy()
    bounds = term_bounds(found, weights, documents, words, best)
    seeds = seeded(own, bounds).toArrow()  # at most a row a term of the block's items
    columns = [seeds.column(c).to_numpy() for c in ("item", "term", "top", "threshold", "raises")]
    block = Block(len(vocabulary), int(pairs["item"].max()) - low + 1, *columns)
    scores = block_scores(found, block, weights, documents, words, best)
    return written(scores.withColumn("item", F.col("item") + low), "search-scores")


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
QUERIES = {"op11_threshold_search": op11_threshold_search}
SQL = {
    "op11_threshold_search": f"""WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, docs),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50"""
}
