"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and each run of characters that are no letters becomes one space. The features are hashed
runs of one to three characters; a feature's value is its share of the text's runs of that length times its inverse document
frequency, which is counted over all training rows. The weights are fitted by follow-the-regularised-leader steps
with an elastic net (an L1 part that leaves most weights at zero, and an L2 part) on a sample of FIT_ROWS rows at
most, drawn by a hash of the id and balanced over the languages. The sample's last part is kept back to fit the
temperature by which the logits are divided, so that scores are probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import plain_text, slices, table, training_row

ORDERS = (1, 2, 3)
FEATURES = 1 << 15
#: Rows that the weights are fitted on at most; frequencies are counted over all training rows.
FIT_ROWS = 3200
#: Of those, one in so many is kept back for the temperature.
KEPT_BACK = 5
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.8, 1.0, 0.02, 0.05
CHARS = 1 << 19
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def character_runs(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the feature numbers at every place (FEATURES where a run leaves its text), each text's first place, and its number of letters."""
    lowered = [text.lower() for text in texts]
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    kept = letter.copy()
    ends = np.cumsum([len(text) + 1 for text in lowered])
    kept[1:] |= letter[:-1]  # one space after each run of letters
    kept[ends - 1] = True  # and one at each text's end
    of = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, ends]))[kept]
    chars = np.where(letter, codes, np.uint32(32))[kept]
    starts = np.searchsorted(of, np.arange(len(texts)))
    numbers = []
    for order in ORDERS:
        n = len(chars) - order + 1
        h = np.full(len(chars), np.uint32(order))
        for k in range(order):
            h[: max(n, 0)] += chars[k : k + n] * _FACTORS[k] if n > 0 else 0
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found = (h >> np.uint32(17)).astype(np.int32)  # 15 bits
        found[max(n, 0) :] = FEATURES
        if order > 1:
            found[: max(n, 0)][of[: max(n, 0)] != of[order - 1 :][: max(n, 0)]] = FEATURES
        numbers.append(found)
    return numbers, starts, np.add.reduceat(letter.astype(np.int64), np.r_[0, ends[:-1]])


def _spans(starts: np.ndarray, n: int) -> Iterator[slice]:
    for a, b in zip(starts, np.r_[starts[1:], n]):
        yield slice(int(a), int(b))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts hold each feature; feature -1 counts the texts."""
    df, total, seen = np.zeros(FEATURES + 1, np.int64), 0, np.zeros(FEATURES + 1, bool)
    for batch in batches:
        for run in slices(batch.column("text"), CHARS):
            numbers, starts, _ = character_runs(run)
            for span in _spans(starts, len(numbers[0])):
                for found in numbers:
                    seen[found[span]] = True
                df += seen
                seen[:] = False
            total += len(run)
    at = np.flatnonzero(df[:FEATURES])
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[df[at], total])], names=["feature", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's features and their shares."""
    for batch in batches:
        at, labels = 0, batch.column("lang")
        for run in slices(batch.column("text"), CHARS):
            numbers, starts, _ = character_runs(run)
            features, shares = [], []
            for span in _spans(starts, len(numbers[0])):
                share = np.zeros(FEATURES)
                for found in numbers:
                    count = np.bincount(found[span], minlength=FEATURES + 1)[:FEATURES]
                    share += count / max(1, count.sum())
                own = np.flatnonzero(share)
                features.append(own.astype(np.int32))
                shares.append(share[own].astype(np.float32))
            columns = [labels.slice(at, len(run)), pa.array(features, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*columns], names=["lang", "features", "shares"])
            at += len(run)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (FEATURES + 1, classes) fitted by follow-the-regularised-leader, a class a column; the last row is the intercept."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at):
        shrunk = np.sign(z[at]) * L1 - z[at]
        return np.where(np.abs(z[at]) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for label, at, values in rows:
            at, values = np.r_[at, FEATURES], np.r_[values, 1.0]
            w = weights(at)
            logits = values @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = values[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that makes the labels likeliest."""

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), labels]))

    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    return float(min(grid, key=loss)) if len(labels) else 1.0


@dataclass
class LanguageModel:
    """langs, and weights already multiplied by inverse document frequency, over the temperature."""

    langs: list[str]
    weights: np.ndarray
    intercept: np.ndarray

    def predict(self, texts: list[str] | pa.Array) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its probability; `und` and 0 for a text without letters, or if nothing was learned."""
        names, scores = [], []
        for run in slices(texts, max(1 << 14, CHARS * 4 // max(4, len(self.langs)))):
            numbers, starts, letters = character_runs(run)
            logits = np.repeat(self.intercept[None, :].astype(np.float64), len(run), axis=0)
            for found in numbers:
                sums = np.add.reduceat(self.weights[found], starts, axis=0, dtype=np.float64)
                counts = np.add.reduceat((found != FEATURES).astype(np.int64), starts)
                logits += sums / np.maximum(counts, 1)[:, None]
            if not self.langs:
                names += [UNKNOWN] * len(run)
                scores += [0.0] * len(run)
                continue
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            names += [self.langs[k] if n else UNKNOWN for k, n in zip(best, letters)]
            scores += np.where(letters > 0, p[np.arange(len(run)), best], 0.0).tolist()
        return names, np.array(scores, float)


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Learn from text and lang of the rows that training_row() admits; null langs and null texts teach nothing."""
    rows = docs.filter(training_row() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"), F.col("lang").cast("string").alias("lang"))
    per_lang = {x.lang: x["n"] for x in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(per_lang)
    if not langs:
        return LanguageModel([], np.zeros((FEATURES + 1, 1), np.float32), np.zeros(1))
    counted = rows.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(FEATURES + 1)
    df[counted.column("feature").to_numpy()] = counted.column("n").to_numpy()  # -1, the number of texts, is the last place
    idf = np.log((1 + df[-1]) / (1 + df[:FEATURES])) + 1
    draw, share = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)), fit_rows / len(langs)
    admitted = F.lit(False)
    for lang in langs:
        admitted |= (F.col("lang") == lang) & (draw < int(min(1.0, share / per_lang[lang]) * (1 << 30)))
    sample = rows.filter(admitted).select("doc_id", "text", "lang", F.xxhash64("doc_id", F.lit(4)).alias("draw"))
    got = sample.orderBy("draw", "doc_id").select("lang", "text").mapInArrow(_sparse, "lang string, features array<int>, shares array<float>").toArrow()
    # Slices of Arrow's own arrays: as lists of Python numbers, the sample would take hundreds of megabytes.
    features, shares = (got.column(c).combine_chunks() for c in ("features", "shares"))
    cuts, at, values = features.offsets.to_numpy(), features.values.to_numpy(), shares.values.to_numpy().astype(np.float64)
    fitted = [(langs.index(x), at[a:b], values[a:b] * idf[at[a:b]]) for x, a, b in zip(got.column("lang").to_pylist(), cuts, cuts[1:])]
    back = fitted[::KEPT_BACK] if len(fitted) >= 20 * KEPT_BACK else []
    w = ftrl([x for k, x in enumerate(fitted) if not back or k % KEPT_BACK], len(langs))
    logits = np.array([v @ w[f] + w[FEATURES] for _, f, v in back])
    t = temperature(logits, np.array([x for x, _, _ in back], int))
    weights = np.vstack([w[:FEATURES] * idf[:, None], np.zeros(len(langs))]) / t
    return LanguageModel(langs, weights.astype(np.float32), w[FEATURES] / t)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with `language`, a struct of lang and score, as last column; all rows and columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predicted(texts: pa.Array) -> pa.Array:
        langs, scores = shared.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return docs.withColumn("language", predicted(F.col("text").cast("string")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (~training_row()).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


QUERIES = {"op3_language_id": op3_language_id}
SQL: dict[str, str] = {}
