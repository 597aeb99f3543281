"""Text quality by ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(threshold_j - w . x): one weight vector for all grades, thresholds kept in order (the first, then logs of the gaps). x holds hashed words, hashed shapes of words (runs of capitals, letters, digits, other characters) and whether a word equals the one before, as square roots of frequencies, in DIMENSIONS places. Fitted with AdaGrad over EPOCHS passes on at most SAMPLE rated texts, those of least hash of doc_id; the rated texts whose crc32(doc_id as text) mod 5 is 0 are held out.

A rating is 0 for a text of low quality, 1 for one of good quality that is toxic, 2 for one of good quality that is not. Selection keeps texts with P(grade >= 1) of at least KEEP.
Nulls: a null text is empty, has no features and is judged by the thresholds alone. A null rating is none; of several for a doc_id the least counts. Without ratings all grades are equally likely. Rows that repeat give equal rows; whole texts of any length are read; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .toxicity import fold

DIMENSIONS, SAMPLE, EPOCHS, RATE, DECAY, KEEP = 1 << 18, 12_000, 12, 0.3, 1e-6, 0.5
GRADES = 3
_RUNS = re.compile(rb"([A-Z]+)|([a-z\x80-\xff]+)|([0-9]+)|([^A-Za-z0-9\x80-\xff]+)")


def shape(word: bytes) -> bytes:
    """A letter for each run: A capitals, a letters, 0 digits, other runs by their first character and whether they go on."""
    out = b"".join(b"A" if m[1] else b"a" if m[2] else b"0" if m[3] else m[4][:1] + b"+" * (len(m[4]) > 1) for m in _RUNS.finditer(word))
    return out[:12]


class Places(dict):
    """The two hashed places of a word."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > C.WordHashes.KEEP:
            self.clear()
        out = self[word] = (xxhash.xxh3_64_intdigest(word.lower()) % (DIMENSIONS - 4096) + 4096, xxhash.xxh3_64_intdigest(shape(word)) % 4095 + 1)
        return out


PLACES = Places()


def vector(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    words = text.split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    places = np.array([PLACES[w] for w in words], np.int32)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    at, n = np.unique(np.append(places.ravel(), np.zeros(repeats, np.int32)), return_counts=True)
    return at, np.sqrt(n / len(words)).astype(np.float32)


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..."""
        z = float(self.weights[at] @ x) if len(at) else 0.0
        return 1 / (1 + np.exp(np.clip(self.thresholds - z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], *, grades: int = GRADES, epochs: int = EPOCHS, seed: int = 1) -> Model:
    """rows: places, values, grade."""
    weights, raw = np.zeros(DIMENSIONS), np.zeros(grades - 1)
    if not rows:
        return Model(weights, np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1)))
    y = np.array([r[2] for r in rows])
    share = np.clip([(y <= j).mean() for j in range(grades - 1)], 0.01, 0.99)
    share = np.maximum.accumulate(share + np.arange(grades - 1) * 1e-3)
    start = np.log(share / (1 - share))
    raw[0], raw[1:] = start[0], np.log(np.maximum(np.diff(start), 1e-3))
    squares, squares_raw, rng = np.full(DIMENSIONS, 1e-6), np.full(grades - 1, 1e-6), np.random.default_rng(seed)
    sizes = np.array([len(r[0]) for r in rows])
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 64):
            batch = order[i : i + 64]
            at, x = np.concatenate([rows[k][0] for k in batch]), np.concatenate([rows[k][1] for k in batch]).astype(float)
            of = np.repeat(np.arange(len(batch)), sizes[batch])
            z = np.bincount(of, weights[at] * x, len(batch))
            cuts = np.concatenate([[-np.inf], np.cumsum(np.append(raw[0], np.exp(raw[1:]))), [np.inf]])
            g = y[batch]
            low, high = (1 / (1 + np.exp(-np.clip(c - z, -30, 30))) for c in (cuts[g], cuts[g + 1]))
            mass = np.maximum(high - low, 1e-9)
            dlow, dhigh = low * (1 - low) * np.isfinite(cuts[g]), high * (1 - high) * np.isfinite(cuts[g + 1])
            slope = (dhigh - dlow) / mass  # of the loss by z
            grad = np.bincount(at, slope[of] * x, DIMENSIONS) / len(batch)
            touched = np.unique(at)
            grad = grad[touched] + DECAY * weights[touched]
            squares[touched] += grad * grad
            weights[touched] -= RATE * grad / np.sqrt(squares[touched])
            by_cut = np.zeros(grades + 1)
            np.add.at(by_cut, g + 1, -dhigh / mass)
            np.add.at(by_cut, g, dlow / mass)
            inner = by_cut[1:-1] / len(batch)
            grad = np.append(inner.sum(), np.cumsum(inner[::-1])[::-1][1:] * np.exp(raw[1:]))
            squares_raw += grad * grad
            raw -= RATE / 3 * grad / np.sqrt(squares_raw)
    return Model(weights, np.cumsum(np.append(raw[0], np.exp(raw[1:]))))


def _vectors(batches):
    for batch in batches:
        v = [vector(x) for x in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("grade"), pa.array([a.astype("<i4").tobytes() for a, _ in v], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in v], pa.binary())], ["grade", "at", "x"])


def grade() -> Column:
    """The rating of a row of labels, quality and toxic."""
    return F.expr("case when quality is null then null when quality = 0 then 0 when toxic = 1 then 1 else 2 end")


def train(docs: DataFrame, labels: DataFrame, *, rating: Column | None = None, grades: int = GRADES, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text as bytes; labels: doc_id and what the rating is made of."""
    scratch = C.Scratch(docs.sparkSession, "ordinal")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (grade() if rating is None else rating).cast("int").alias("grade")).where((fold("doc_id", 5) != 0) & F.col("grade").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    few = scratch.write(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "few")
    rated = docs.join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "grade", "text")
    rows = scratch.write(rated.mapInArrow(_vectors, "grade int, at binary, x binary"), "rated").orderBy("at", "x", "grade")  # sample rows at most; in one order for one model
    return fit([(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["x"], "<f4"), r["grade"]) for r in rows.toLocalIterator()], grades=grades)


def _run(shared, grades: int):
    def run(batches):
        model = shared.value
        for batch in batches:
            tails = [model.tails(*vector(x)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array([t.tolist() for t in tails], pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"])

    return run


def score(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", rating: Column | None = None, grades: int = GRADES, keep: float = KEEP) -> DataFrame:
    """Per row of docs: doc_id, held_out, expected_grade, p_at_least_1 and so on (tail probabilities), kept."""
    spark = docs.sparkSession
    C.prepare(spark)
    docs = C.id_and_text(docs, key, text)
    model = train(docs, labels, rating=rating, grades=grades)
    out = docs.mapInArrow(_run(spark.sparkContext.broadcast(model), grades), "doc_id long, expected_grade double, tails array<double>")
    tails = [F.col("tails")[j - 1].alias(f"p_at_least_{j}") for j in range(1, grades)]
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "expected_grade", *tails, (F.col("tails")[0] >= keep).alias("kept"))
