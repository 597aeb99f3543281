"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes, calibrated.

Terms are words in lower case, without what is no letter or digit at their edges, cut to their first STEM characters. Every term of a text counts: its weight is (1 + ln n) * idf * (1 + STRESS * lean). idf is that of the labelled examples; lean is how far a term is likelier in toxic examples than in others (the log of the ratio less twice its standard error, 0 at least), so that terms that tell the labels apart weigh more; none is dropped, and a term that no example has counts in the text's length.
Examples: at most TOXIC toxic and OTHER other texts of least hash of doc_id, each a unit vector. They lie in blocks of BLOCK, like ones together. The WIDE most frequent terms have their postings as rows of blocks, with the largest weight of each block; the postings of the others are short and added up first. A text's NEAREST nearest examples are found exactly: the blocks of the largest bounds (that sum, plus the text's weights times the blocks' largest ones) are visited first, then all others whose bound exceeds the last neighbour so far.
Each neighbour votes with its cosine; PRIOR votes go to the share of toxic texts among all labelled ones, which keeps scores moderate where evidence is thin. The share of votes becomes a probability by a logistic curve fitted on at most CHECKED labelled texts that are no examples. The neighbours' ids are the evidence.

Learning takes the rows of labels whose crc32(doc_id as text) mod 5 is not 0; examples come from remainders 1 to 3, the curve from 4. Nulls: a null text is empty; texts without a known term score what the share alone gives. A null label is no label; of several rows for a doc_id the larger label counts; of several texts with a doc_id the least is the example. Without any labels the score is 0. Rows that repeat give equal rows; whole texts of any length are read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

TOXIC, OTHER, CHECKED = 2000, 4000, 1500
STEM, STRESS, WIDE = 5, 6.0, 1000
NEAREST, PRIOR, BLOCK, AT_ONCE = 15, 0.35, 64, 8
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def fold(key: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(key).cast("long").cast("string").cast("binary")) % parts


def stem(word: bytes) -> str:
    """The term of a word with A-Z in lower case."""
    w = word.decode("utf-8", "replace")
    if not w.isalnum():
        w = EDGE.sub("", w)
    return (w if w.isascii() else w.lower())[:STEM]


class Stems(dict):
    """The term of a word, kept for words met before."""

    def __missing__(self, word: bytes) -> str:
        if len(self) > C.WordHashes.KEEP:
            self.clear()
        self[word] = out = stem(word)
        return out


STEMS = Stems()


def terms_of(text: bytes) -> Counter:
    c = Counter(map(STEMS.__getitem__, C.words_of(text)))
    del c[""]
    return c


def leaning(toxic: np.ndarray, other: np.ndarray, p: int, n: int) -> np.ndarray:
    """The lower bound of the log of how much likelier a term is in toxic examples, of p and n examples."""
    a, b = toxic + 0.5, other + 0.5
    return np.maximum(0, np.log(a / (p + 1)) - np.log(b / (n + 1)) - 2 * np.sqrt(1 / a + 1 / b))


class Numbers(dict):
    """The number of a word's term, kept for words met before: below -1 by hash for terms without one, -1 where nothing is left of a word."""

    def __init__(self, number: dict[str, int]):
        self.number = number

    def __missing__(self, word: bytes) -> int:
        if len(self) > C.WordHashes.KEEP:
            self.clear()
        term = stem(word)
        out = self.number.get(term) if term else -1
        self[word] = out = -2 - (xxhash.xxh3_64_intdigest(term) >> 2) if out is None else out
        return out


class Weights:
    """Terms by number, their weights, and the vectors of texts."""

    def __init__(self, terms: list[str], toxic: np.ndarray, other: np.ndarray, p: int, n: int):
        self.number = {t: i for i, t in enumerate(terms)}
        self.idf = ((np.log((p + n + 1) / (toxic + other + 1)) + 1) * (1 + STRESS * leaning(toxic, other, p, n))).astype(np.float32)
        self.unknown, self.of = np.log(p + n + 1) + 1, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"of": None}

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Known terms, ascending, and their weights; the whole text's vector, unknown terms included, has length 1."""
        if self.of is None:
            self.of = Numbers(self.number)
        words = C.words_of(text)
        x = np.sort(np.fromiter(map(self.of.__getitem__, words), np.int64, len(words)))
        new = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
        at, tf = x[new], 1 + np.log(np.diff(new, append=len(x)))
        known = np.searchsorted(at, 0)
        far = tf[: np.searchsorted(at, -1)] * self.unknown
        at, w = at[known:], tf[known:] * self.idf[at[known:]]
        return at, (w / np.sqrt(max(1e-30, w @ w + far @ far))).astype(np.float32)


class Index:
    def __init__(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]], terms: int, share: float):
        """examples: id, label, terms, weights."""
        examples = sorted((e for e in examples if len(e[2])), key=lambda e: (e[1], e[2][np.argmax(e[3])], e[0]))  # like examples together: closer bounds
        self.share, self.ids, self.labels = share, np.array([e[0] for e in examples], np.int64), np.array([e[1] for e in examples], float)
        self.blocks, self.terms, self.ready = -(-len(examples) // BLOCK), terms, False
        of = np.repeat(np.arange(len(examples), dtype=np.int32), [len(e[2]) for e in examples])
        at = np.concatenate([e[2] for e in examples]).astype(np.int32) if examples else np.zeros(0, np.int32)
        order = np.argsort(at, kind="stable")
        self.item, self.weight = of[order], (np.concatenate([e[3] for e in examples]) if examples else np.zeros(0)).astype(np.float32)[order]
        self.begin = np.searchsorted(at[order], np.arange(terms + 1)).astype(np.int64)

    def unpack(self) -> None:
        """Rows of blocks for the frequent terms, and their largest weights; where they are searched."""
        df = np.diff(self.begin)
        wide = np.argsort(-df, kind="stable")[:WIDE]
        self.row = np.full(self.terms, -1, np.int64)
        self.row[wide] = np.arange(len(wide))
        self.rows = np.zeros((self.blocks, len(wide), BLOCK), np.float32)
        for r, t in enumerate(wide.tolist()):
            i = self.item[self.begin[t] : self.begin[t + 1]]
            self.rows[i // BLOCK, r, i % BLOCK] = self.weight[self.begin[t] : self.begin[t + 1]]
        self.most, self.ready = np.ascontiguousarray(self.rows.max(axis=2, initial=0).T), True

    def nearest(self, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the nearest examples; ties go to the lower place."""
        if not self.ready:
            self.unpack()
        wide = self.row[at] >= 0
        r, v, few, u = self.row[at[wide]], w[wide], at[~wide], w[~wide]
        n = self.begin[few + 1] - self.begin[few]
        ends = np.cumsum(n)
        posting = np.arange(int(n.sum())) + np.repeat(self.begin[few] - ends + n, n)
        sums = np.bincount(self.item[posting], self.weight[posting] * np.repeat(u, n), self.blocks * BLOCK).reshape(self.blocks, BLOCK)
        bound = sums.max(axis=1) + v @ self.most[r]
        order = np.argsort(-bound, kind="stable")
        places, cosines, at = np.zeros(0, np.int64), np.zeros(0), 0
        while at < self.blocks and bound[order[at]] > 0:
            least = cosines[-1] - 1e-5 if len(cosines) == NEAREST else 0.0
            end = at + AT_ONCE if not at else int(np.searchsorted(-bound[order], -least, side="right"))  # first the best blocks, then all that may still matter
            some = order[at:end]
            if not len(some):
                break
            x = (sums[some] + np.matmul(v, self.rows[some[:, None], r])).ravel()
            hit = np.flatnonzero(x > max(0.0, least))
            places, cosines = np.append(places, (some[hit // BLOCK] * BLOCK + hit % BLOCK)), np.append(cosines, x[hit])
            best = np.lexsort((places, -cosines))[:NEAREST]
            places, cosines, at = places[best], cosines[best], max(end, at + 1)
        return places, cosines

    def vote(self, at: np.ndarray, w: np.ndarray) -> tuple[float, list[int]]:
        """The share of votes for toxic, and the voters."""
        if not len(at) or not self.blocks:
            return self.share, []
        places, cosines = self.nearest(at, w)
        return float((cosines @ self.labels[places] + PRIOR * self.share) / (cosines.sum() + PRIOR)), self.ids[places].tolist()


def curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the logistic curve from shares of votes to chances (a little ridge keeps it finite). Without both labels: a steep one in the middle."""
    if len(set(labels.tolist())) < 2:
        return 8.0, 0.5
    x, theta = np.stack([votes - 0.5, np.ones(len(votes))], 1), np.array([8.0, 0.0])
    ridge = np.array([0.02, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        step = np.linalg.solve(h, x.T @ (p - labels) + ridge * (theta - [8.0, 0.0]))
        theta -= np.clip(step, -5, 5)
    return (float(theta[0]), float(np.clip(0.5 - theta[1] / theta[0], 0.1, 0.9))) if theta[0] > 0 else (8.0, 0.5)


def _count(batches):
    """For each term the toxic and other texts that have it, as far as this task has read."""
    toxic, other = Counter(), Counter()
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
            (toxic if label else other).update(set(terms_of(text)))
    names = list(set(toxic) | set(other))
    for i in range(0, len(names), 50_000):
        some = names[i : i + 50_000]
        yield pa.record_batch([pa.array(some, pa.string()), pa.array([toxic[x] for x in some], pa.int64()), pa.array([other[x] for x in some], pa.int64())], ["term", "toxic", "other"])


def _vectors(shared):
    def run(batches):
        weights = shared.value
        for batch in batches:
            found = [weights.vector(x) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array([at.astype(np.int32).tobytes() for at, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())], ["doc_id", "label", "at", "weights"])

    return run


def _votes(shared):
    def run(batches):
        weights, index, _ = shared.value
        for batch in batches:
            votes = [index.vote(*weights.vector(x))[0] for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("label"), pa.array(votes, pa.float64())], ["label", "vote"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic") -> tuple[Weights, Index, tuple[float, float]]:
    """docs: doc_id, text as bytes; labels: doc_id and a label of 0 or 1. What is gathered comes from TOXIC + OTHER + CHECKED texts."""
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "toxicity")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where((fold("doc_id", 5) != 0) & F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = scratch.write(known, "known")
    few = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    example = fold("doc_id", 5) != 4
    some = few(known.where(example & (F.col("label") == 1)), TOXIC).unionAll(few(known.where(example & (F.col("label") == 0)), OTHER)).withColumn("checked", F.lit(False))
    some = scratch.write(some.unionAll(few(known.where(~example), CHECKED).withColumn("checked", F.lit(True))), "some")
    sample = scratch.write(docs.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", "checked", "text")).alias("x")).select("doc_id", "x.*"), "sample")
    examples, checked = sample.where("not checked"), sample.where("checked")
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    sizes = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    p, n = sizes.get(1, 0), sizes.get(0, 0)
    share = shares.get(1, 0) / max(1, sum(shares.values()))
    counts = examples.select("label", "text").mapInArrow(_count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).orderBy("term").toArrow()
    weights = Weights(counts["term"].to_pylist(), counts["toxic"].to_numpy(), counts["other"].to_numpy(), p, n)
    shared = spark.sparkContext.broadcast(weights)
    vectors = examples.mapInArrow(C.lean("toxicity", _vectors(shared)), "doc_id long, label int, at binary, weights binary").toArrow()
    found = [(i, y, np.frombuffer(at, np.int32), np.frombuffer(w, np.float32)) for i, y, at, w in zip(*(c.to_pylist() for c in vectors.columns), strict=True)]
    index = Index(found, len(weights.number), share)
    shared.destroy()
    shared = spark.sparkContext.broadcast((weights, index, None))
    votes = checked.mapInArrow(C.lean("toxicity", _votes(shared)), "label int, vote double").toArrow()
    shared.destroy()
    return weights, index, curve(votes["vote"].to_numpy(), votes["label"].to_numpy())


def _run(shared):
    def run(batches):
        weights, index, (slope, middle) = shared.value
        chance = lambda vote: 1 / (1 + np.exp(-np.clip(slope * (vote - middle), -30, 30))) if index.share else 0.0
        for batch in batches:
            out = [index.vote(*weights.vector(x)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([float(chance(v)) for v, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(pa.int64()))], ["doc_id", "score", "neighbours"])

    return run


def score(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out (no learning from its label), score, predicted (1 from 0.5 on), neighbours (ids, nearest first)."""
    spark = docs.sparkSession
    C.prepare(spark)
    docs = C.id_and_text(docs, key, text)
    shared = spark.sparkContext.broadcast(train(docs, labels))
    out = docs.mapInArrow(C.lean("toxicity", _run(shared)), "doc_id long, score double, neighbours array<long>")
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")
