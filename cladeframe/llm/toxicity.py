"""Toxic passages by maximum-scoring segment search.

A word has features: itself, and its first STEMS bytes, so that inflected forms of one stem are known together. A
feature's score is its log-odds in toxic against clean documents, under a Dirichlet prior of a share alike for all
and a share like the feature's in the whole corpus. A word takes the score of its longest known feature, at its first
occurrence in a text (labels are counted by documents, too); all else costs DRIFT, so that segments stay short. In one linear scan, all
maximal scoring segments of a text are found; a segment's score is significant by the extreme-value law of such
scores. Its decay solves the law's equation over the scores that the scan gives to clean documents that taught no
log-odds, and its constant is the likeliest for their best segments. The evidence of a document's
segments is mapped to a probability by a logistic curve fitted to the same documents.

Labels are learned from FIT_ROWS labelled documents at most, drawn by a hash of the id; word counts for the prior
cover all documents. Of labelled near copies (by the smallest hash of their runs of words), one teaches, so that a copied document's
chance words don't count many times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import plain_text, slices, table, training_row, written
from .words import Words, mixed, words_of

FIT_ROWS = 20_000
#: Of those, one in so many is kept from the word counts, for the calibration.
KEPT_BACK = 4
THRESHOLD = 0.3
#: Numbers of first bytes that make a stem.
STEMS = (4, 5, 6, 7, 8)
#: The prior: documents' words by the corpus's shares, and as much for each feature whatever its share.
PRIOR_WORDS, PRIOR_FLOOR = 2_000.0, 0.5
#: A feature needs to be in this many toxic documents, or in so many clean ones, and this many standard deviations from no difference.
LEAST_USES, LEAST_CLEAN, LEAST_Z = 3, 20, 3.0
#: What a word of no meaning costs, and the range of scores.
DRIFT, LOWEST, HIGHEST = 0.25, -2.0, 8.0
#: Words of a run whose smallest hash tells near copies.
SKETCH_WORDS = 4
#: Expected number of as good segments by chance, below which a segment is significant.
EXPECTED = 0.05
CHARS = 1 << 19
_BITS = 1 << 22


def segments(scores: np.ndarray, at: np.ndarray) -> list[tuple[float, int, int]]:
    """(score, first word, last word) of all maximal scoring segments, in linear time; `at` are the places of positive scores."""
    total = np.cumsum(scores)
    lefts, rights = (total[at] - scores[at]).tolist(), total[at].tolist()
    stack: list[list] = []  # left total, right total, first, last, place on the stack of the nearest one with a lower left
    for left, right, place in zip(lefts, rights, at.tolist()):
        own = [left, right, place, place, -1]
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= own[0]:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= own[1]:
                own[4] = j
                stack.append(own)
                break
            own[0], own[2] = stack[j][0], stack[j][2]
            after = stack[j][4]
            del stack[j:]
            j = after
    return [(s[1] - s[0], s[2], s[3]) for s in stack]


class _Scores:
    """Scores by hash, with a bit table that turns away most words at once."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], scores[order]
        self.bits = np.zeros(_BITS, bool)
        self.bits[(self.keys & np.uint64(_BITS - 1)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and their places among the keys."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64(_BITS - 1)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        hit = self.keys[spot] == hashes[maybe]
        return maybe[hit], spot[hit]

    def put(self, hashes: np.ndarray, out: np.ndarray) -> None:
        at, spot = self.places(hashes)
        out[at] = self.scores[spot]


def features(words: Words) -> list[np.ndarray]:
    """For each stem length and last for whole words, a key of each word's feature; 0 where it has none."""
    keys = [np.where(own != 0, mixed(own ^ np.uint64(k)), own) for k, own in zip(STEMS, words.stems)]
    return [*keys, words.hashes]


@dataclass
class ToxicityModel:
    known: _Scores
    decay: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    intercept: float = 0.0

    def word_scores(self, words: Words) -> np.ndarray:
        scores = np.full(len(words.hashes), -DRIFT)
        for keys in features(words):
            self.known.put(keys, scores)
        hits = np.flatnonzero(scores != -DRIFT)
        pairs = np.stack([words.of[hits].astype(np.uint64), words.hashes[hits]])
        first = np.unique(pairs, axis=1, return_index=True)[1] if len(hits) else hits
        again = np.ones(len(hits), bool)
        again[first] = False
        scores[hits[again]] = -DRIFT
        return scores

    def scanned(self, texts: list[str]) -> tuple[Words, np.ndarray, list[tuple[int, int, list]]]:
        """The words, their scores, and for each text its first word, its number of words, and its maximal scoring segments."""
        words = words_of(texts, STEMS)
        scores = self.word_scores(words)
        starts = np.searchsorted(words.of, np.arange(len(texts) + 1)).tolist()
        positive = np.flatnonzero(scores > 0)
        cut = np.searchsorted(positive, starts).tolist()
        found = []
        for k, (a, b) in enumerate(zip(starts, starts[1:])):
            own = positive[cut[k] : cut[k + 1]]
            found.append((a, b - a, segments(scores[a:b], own - a) if len(own) else []))
        return words, scores, found

    def significance(self, score: float, n: int) -> float:
        """The negative logarithm of the number of segments as good that n clean words are expected to hold."""
        return self.decay * score - self.log_k - np.log(max(n, 1))

    def evidence(self, n: int, found: list) -> float:
        if not found:
            return 0.0
        each = sorted((self.significance(s, n) for s, _, _ in found), reverse=True)
        # The best one by its chance under the extreme-value law, further ones if significant in themselves.
        best = -np.log(max(-np.expm1(-np.exp(-max(each[0], -30.0))), 1e-300)) if each[0] < 600 else each[0]
        return float(best + sum(x for x in each[1:] if x > -np.log(EXPECTED)))

    def probability(self, evidence) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.log1p(np.asarray(evidence, float)) + self.intercept)))

    def score(self, texts: list[str] | pa.Array) -> np.ndarray:
        found = [self.evidence(n, s) for run in slices(texts, CHARS) for _, n, s in self.scanned(run)[2]]
        return self.probability(found)


def _once(text: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of a text and a word once."""
    pairs = np.unique(text * max(words, 1) + word)
    return pairs // max(words, 1), pairs % max(words, 1)


def sketches(texts: list[str]) -> np.ndarray:
    """Of each text, the smallest hash of its runs of SKETCH_WORDS words (0 if it has fewer): near copies mostly share it."""
    words = words_of(texts)
    found = np.zeros(len(texts), np.uint64)
    n = len(words.hashes) - SKETCH_WORDS + 1
    if n > 0:
        runs = np.zeros(n, np.uint64)
        for k in range(SKETCH_WORDS):
            runs = runs * np.uint64(0x9E3779B97F4A7C15) + words.hashes[k : k + n]
        whole = np.flatnonzero(words.of[:n] == words.of[SKETCH_WORDS - 1 :])
        if len(whole):
            of = words.of[whole]
            new = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            found[of[new]] = np.minimum.reduceat(mixed(runs[whole]), new)
    return found.view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sketches(run) for run in slices(batch.column("text"), CHARS)]
        columns = [*batch.columns, pa.array(np.concatenate(found) if found else np.empty(0, np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "text", "sketch"])


def _labelled_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts have each feature; one that a text repeats counts once. Key 0 counts the texts' different words."""
    for batch in batches:
        labels, at = batch.column("toxic").to_numpy(), 0
        for run in slices(batch.column("text"), CHARS):
            words, toxic = words_of(run, STEMS), labels[at : at + len(run)]
            at += len(run)
            for keys in features(words):
                unique, back = np.unique(keys[keys != 0], return_inverse=True)
                text, back = _once(words.of[keys != 0], back, len(unique))
                bad = np.bincount(back, weights=toxic[text], minlength=len(unique)).astype(np.int64)
                good = np.bincount(back, minlength=len(unique)) - bad
                if keys is words.hashes:
                    unique, bad, good = np.r_[unique, np.uint64(0)], np.r_[bad, bad.sum()], np.r_[good, good.sum()]
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(bad), pa.array(good)], names=["key", "bad", "good"])


def _corpus_counts(keys: np.ndarray):
    """How many of all texts have the chosen features; key 0 counts the texts' words."""
    known = _Scores(keys, np.zeros(len(keys)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(keys), np.int64), 0
        for batch in batches:
            for run in slices(batch.column("text"), CHARS):
                words = words_of(run, STEMS)
                total += len(words.hashes)
                for own in features(words):
                    at, spot = known.places(own)
                    counts += np.bincount(_once(words.of[at], spot, len(keys))[1], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[known.keys, np.uint64(0)].view(np.int64)), pa.array(np.r_[counts, total])], names=["key", "n"])

    return task


def log_odds(bad, good, share, all_bad: float, all_good: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds with a Dirichlet prior of these shares, and how many standard deviations they are from zero."""
    prior = PRIOR_WORDS * np.asarray(share, float) + PRIOR_FLOOR
    # The prior is alike for both sides once the clean side's larger total is allowed for.
    scale = all_good / max(all_bad, 1.0)
    a, b = bad + prior, good + prior * min(scale, 1.0)
    found = np.log(a / (all_bad + PRIOR_WORDS - bad)) - np.log(b / (all_good + PRIOR_WORDS - good))
    return found, found / np.sqrt(1 / a + 1 / b)


def decay_of(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(shares * exp(root * scores)) = 1: how fast chance scores die out."""
    if not (scores[shares > 0] > 0).any() or (shares * scores).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (shares * np.exp(high * scores)).sum() < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (shares * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return high


def constant_of(decay: float, best: list[float], sizes: np.ndarray) -> float:
    """The likeliest constant K of the law that n words hold no segment above x with chance exp(-K n exp(-decay x)).

    Texts without a segment count as having none above the smallest best one.
    """
    found = np.asarray(best, float)
    least = found[found > 0].min() if (found > 0).any() else 0.0
    expected = np.asarray(sizes, float) * np.exp(-decay * np.maximum(found, least))
    return max(1.0, float((found > 0).sum())) / max(expected.sum(), 1e-12)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the likeliest logistic curve, with a weak pull to zero."""
    design, w = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - y) + 1e-2 * w
        w = w - np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), gradient)
    return float(w[0]), float(w[1])


def _decided(z: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Scores by the bound of the log-odds nearest to zero that one standard deviation allows; zero where that changes sides."""
    deviation = np.abs(odds / np.where(z == 0, 1.0, z))
    return np.sign(odds) * np.maximum(np.abs(odds) - deviation, 0.0)


def one_of_copies(labelled: DataFrame) -> DataFrame:
    """Of labelled texts (doc_id, toxic, text) with one label and sketch, one: sketch, toxic and x, its doc_id and text.

    Texts too short for a run of words have no sketch: only their copies are one.
    """
    sketched = labelled.mapInArrow(_sketched, "doc_id long, toxic double, text string, sketch long")
    sketched = sketched.withColumn("sketch", F.when(F.col("sketch") == 0, F.xxhash64("text")).otherwise(F.col("sketch")))
    return sketched.groupBy("sketch", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("x"))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn from the labelled rows that training_row() admits; a null label teaches nothing, of repeated ids the highest label counts."""
    spark = docs.sparkSession
    none = ToxicityModel(_Scores(np.empty(0, np.uint64), np.empty(0)), slope=0.0, intercept=-3.0)
    usable = labels.filter(training_row() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").cast("double").alias("toxic"))
    total = usable.count()
    if not total:
        return none
    draw = F.pmod(F.xxhash64("label_id", F.lit(5)), F.lit(1 << 30))
    sample = usable.filter(draw < int(min(1.0, fit_rows / total) * (1 << 30)))
    # fit_rows rows of two small columns: the side that is broadcast has a bound.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    joined = rows.join(F.broadcast(sample), rows["doc_id"] == F.col("label_id")).select("doc_id", "toxic", "text")
    one = one_of_copies(joined)
    taught = written(one.select("x.doc_id", "toxic", "x.text", (F.pmod(F.xxhash64("sketch", F.lit(6)), F.lit(KEPT_BACK)) == 0).alias("back")), "toxicity-sample")
    counted = taught.filter("not back").select("toxic", "text").mapInArrow(_labelled_counts, "key long, bad long, good long")
    sums = counted.groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # The sample is bounded, and so is the number of features with so many uses in it.
    got = sums.filter((F.col("bad") >= LEAST_USES) | (F.col("good") >= LEAST_CLEAN) | (F.col("key") == 0)).toArrow()
    key, bad, good = (got.column(c).to_numpy() for c in ("key", "bad", "good"))
    of_all = key == 0
    if not of_all.any() or not bad[of_all].sum() or not good[of_all].sum():
        return none
    all_bad, all_good = float(bad[of_all][0]), float(good[of_all][0])
    key, bad, good = key[~of_all].view(np.uint64), bad[~of_all].astype(float), good[~of_all].astype(float)
    order = np.argsort(key)
    key, bad, good = key[order], bad[order], good[order]
    # Only features whose use differs at all go on to the count over the corpus.
    differs = np.abs(log_odds(bad, good, np.zeros(len(key)), all_bad, all_good)[1]) >= LEAST_Z
    chosen = key[differs]
    seen = rows.select("text").mapInArrow(_corpus_counts(chosen), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    uses = dict(zip(seen.column("key").to_pylist(), seen.column("n").to_pylist()))
    corpus = max(1, uses.get(0, 1))
    share = np.array([uses.get(k, 0) / corpus for k in chosen.view(np.int64).tolist()], float)
    odds, z = log_odds(bad[differs], good[differs], share, all_bad, all_good)
    scores = np.zeros(len(key))
    scores[differs] = np.where(np.abs(z) >= LEAST_Z, np.clip(_decided(z, odds), LOWEST, HIGHEST), 0.0)
    # A well-known feature without difference is kept, too: it stands before its shorter stems.
    model = ToxicityModel(_Scores(key, scores - DRIFT))
    shared = spark.sparkContext.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, at, found, told = batch.column("toxic").to_numpy(), 0, [], []
            for run in slices(batch.column("text"), CHARS):
                _, scores, each = shared.value.scanned(run)
                for k, (start, n, own) in enumerate(each):
                    found.append((n, [x[0] for x in own]))
                    hits = scores[start : start + n]
                    told.append(hits[hits != -DRIFT].tolist() if not labels[at + k] else [])
                at += len(run)
            columns = [batch.column("doc_id"), batch.column("toxic"), pa.array([n for n, _ in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x for _, x in found], pa.list_(pa.float64())), pa.array(told, pa.list_(pa.float64()))], names=["doc_id", "toxic", "n", "scores", "hits"])

    kept = taught.filter("back").select("doc_id", "toxic", "text").mapInArrow(best, "doc_id long, toxic double, n long, scores array<double>, hits array<double>").toArrow().sort_by("doc_id")
    toxic, sizes, lists = kept.column("toxic").to_numpy(), kept.column("n").to_numpy(), kept.column("scores").to_pylist()
    values, counts = np.unique(np.concatenate([np.empty(0), *map(np.asarray, kept.column("hits").to_pylist())]).round(6), return_counts=True)
    clean_words = float(sizes[toxic == 0].sum())
    if clean_words:
        shares = np.r_[counts, max(1.0, clean_words - counts.sum())] / clean_words
        model.decay = decay_of(np.r_[values, -DRIFT], shares / shares.sum())
        model.log_k = float(np.log(constant_of(model.decay, [max(s, default=0.0) for s, t in zip(lists, toxic) if not t], sizes[toxic == 0])))
    evidence = np.array([model.evidence(int(n), [(x, 0, 0) for x in s]) for s, n in zip(lists, sizes)])
    if 0 < toxic.sum() < len(toxic):
        model.slope, model.intercept = _logistic(np.log1p(evidence), toxic)
        model.slope = max(model.slope, 1e-3)
    else:
        model.slope, model.intercept = 2.0, -4.0
    return model


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with `toxicity` (0 to 1) as last column; all rows and columns stay. A null text counts as empty; that has no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts), pa.float64())

    return docs.withColumn("toxicity", scored(F.col("text").cast("string")))


def passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """A row for each significant segment: doc_id, first_word, n_words, score, expected (segments as good by chance), passage (in lower case)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "first_word", "n_words", "score", "expected", "passage"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids, at, rows = batch.column("doc_id").to_pylist(), 0, []
            for run in slices(batch.column("text"), CHARS):
                words, _, found = m.scanned(run)
                for k, (start, n, own) in enumerate(found):
                    for score, a, b in own:
                        if (x := m.significance(score, n)) > -np.log(EXPECTED):
                            text = words.data[words.starts[start + a] : words.ends[start + b]].decode("utf-8", "replace")
                            rows.append((ids[at + k], a, b - a + 1, score, float(np.exp(-x)), text))
                at += len(run)
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    return rows.mapInArrow(task, "doc_id long, first_word long, n_words long, score double, expected double, passage string")


def op4_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    score = F.col("toxicity").alias("score")
    return found.select("doc_id", (~training_row()).alias("held_out"), score, (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_segment_search": op4_segment_search}
SQL: dict[str, str] = {}
