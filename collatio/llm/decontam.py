"""Benchmark passages in training texts: BM25 over an inverted index of the test items, block-max WAND bounds, verified overlap.

Every text is cut into windows of words that overlap by half; each window is a query, each test item a document of the index. An item is retrieved if its BM25 score is at least SHARE of the score that its own words have. Weights are divided by the item's threshold, so that a window reaches an item if the sum is 1 or more. Bounds, as in block-max WAND (Ding, Suel, Faster Top-k Document Retrieval Using Block-Max Indexes, 2011), leave out what can't reach it: first the sums of each term's largest weight within SUPER groups of items, then within blocks of BLOCK items; only blocks that pass are scored. A retrieved item counts if the text around any of the windows that retrieve it (as many words on each side as the item has, a window's at least) holds at least OVERLAP of the word 5-grams of its question and of its answer (the part after the last question mark or line break, else the last third). Punctuation at the edges of words does not count there, and a part of fewer than 10 words has grams of half its words; of a one-word part that word itself must be there.

Items come in rounds of ITEMS at most, so the index that is sent to executors has a bound; every round scans the texts. Numbers of items by word, the mean and the longest length are those of all items, so scores don't depend on rounds. Nulls and empty texts or items match nothing; rows that repeat a doc_id with the same text give their rows once. Long texts are windows like any other. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

K1, B, SHARE, OVERLAP, GRAM = 1.2, 0.75, 0.5, 0.5, 5
SUPER, BLOCK, ITEMS = 8, 8, 20_000
EDGE = string.punctuation.encode()
SCHEMA = "doc_id long, item_id long, score double, at_word long, question_overlap double, answer_overlap double"


def bare(words: list[bytes]) -> list[bytes]:
    """Words without the ASCII punctuation at their edges; those of punctuation alone stay."""
    return [w.strip(EDGE) or w for w in words]


def size_of(part: list[bytes]) -> int:
    """Words of a gram: at most half of a short part, so that a changed word at its edge leaves the other grams."""
    return max(1, min(GRAM, len(part) // 2))


def grams(words: list[bytes], size: int) -> set[tuple]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def parts(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Question and answer words of an item."""
    cut = max(m.end() for m in [*re.finditer(rb"[?\n]", text.rstrip()), re.match(b"", text)])
    question, answer = C.words_of(text[:cut]), C.words_of(text[cut:])
    if not question or not answer:
        words = C.words_of(text)
        cut = -(-2 * len(words) // 3)
        question, answer = words[:cut], words[cut:]
    return question, answer


class Index:
    """Terms to blocks of items to items; weights are divided by the items' thresholds."""

    def __init__(self, items: list[tuple[int, bytes]], whole: tuple[int, float, int, dict[bytes, int]] | None = None):
        """whole: number, mean and most words, and each word's number of items, of all items where these are a part of them."""
        items = [(i, t) for i, t in items if t.split()]
        split = [C.words_of(t) for _, t in items]
        self.n, self.parts = len(items), [tuple(map(bare, parts(t))) for _, t in items]
        counts = [Counter(w) for w in split]
        df = Counter(w for c in counts for w in c)
        self.term = {w: i for i, w in enumerate(df)}
        total, mean, longest, df = whole or (self.n, sum(map(len, split)) / max(1, self.n), max(map(len, split), default=0), df)
        self.window = min(512, max(64, -(-longest // 32) * 32))
        weights = []
        for words, c in zip(split, counts, strict=True):
            k = K1 * (1 - B + B * len(words) / mean)
            weights.append({self.term[w]: math.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + k) for w, n in c.items()})
        needs = [SHARE * sum(w.values()) * min(1, self.window / len(words)) for w, words in zip(weights, split, strict=True)]
        order = sorted(range(self.n), key=lambda i: needs[i])  # blocks of like thresholds have closer bounds
        self.ids, self.needs = [items[i][0] for i in order], np.array([needs[i] for i in order])
        self.parts, self.lengths = [self.parts[i] for i in order], [len(split[i]) for i in order]
        rows = [(t, place, w / needs[i]) for place, i in enumerate(order) for t, w in weights[i].items()]
        rows.sort()
        self.item = np.array([r[1] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows], np.float32)
        term = np.array([r[0] for r in rows], np.int64)
        blocks = -(-self.n // BLOCK) if self.n else 0
        key = term * max(1, blocks) + self.item // BLOCK
        self.begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.end = np.append(self.begin[1:], len(key))
        self.block = self.item[self.begin] // BLOCK
        self.most = np.maximum.reduceat(self.weight, self.begin) if len(key) else np.zeros(0, np.float32)
        of = term[self.begin]
        self.term_begin, self.term_end = np.searchsorted(of, np.arange(len(self.term) + 1)), np.searchsorted(of, np.arange(len(self.term) + 1), side="right")
        self.per = -(-max(1, blocks) // SUPER)
        self.super = np.zeros((len(self.term) + 1, SUPER), np.float32)
        np.maximum.at(self.super, (of, self.block // self.per), self.most)
        self.blocks = max(1, blocks)


def expand(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range that each comes from."""
    n = end - begin
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - begin, n), of


def retrieve(index: Index, terms: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """terms: a row of term numbers for each window (len(index.term): none); first: whether a place is the term's first in its window. Gives window, item's place and sum (1: the threshold) of all that reach it."""
    slack = np.float32(0.9999)
    bound = np.einsum("wts,wt->ws", index.super[terms], first.astype(np.float32))
    windows = np.flatnonzero(bound.max(axis=1) >= slack)
    w, at = np.nonzero(first[windows] & (terms[windows] < len(index.term)))
    t = terms[windows][w, at]
    entry, of = expand(index.term_begin[t], index.term_end[t])
    w = w[of]
    may = bound[windows][w, index.block[entry] // index.per] >= slack
    entry, w = entry[may], w[may]
    key, back = np.unique(w * index.blocks + index.block[entry], return_inverse=True)
    sums = np.bincount(back, index.most[entry], len(key))
    may = sums[back] >= slack
    entry, w = entry[may], w[may]
    posting, of = expand(index.begin[entry], index.end[entry])
    key, back = np.unique(w[of] * max(1, index.n) + index.item[posting], return_inverse=True)
    sums = np.bincount(back, index.weight[posting], len(key))
    good = sums >= 1 - 1e-5
    return windows[key[good] // max(1, index.n)], key[good] % max(1, index.n), sums[good]


def windows_of(n: int, size: int) -> list[int]:
    return list(range(0, max(1, n - size // 2), size // 2))


def covered(words: list[bytes], spans: list[tuple[int, int]], part: list[bytes]) -> list[float]:
    """The share of a part's grams that each span of the words holds; spans begin and end in order. One pass, however much they overlap."""
    size, out = size_of(part), []
    want = {g: 0 for g in grams(part, size)}
    places: deque[tuple[int, tuple]] = deque()
    read, held = 0, 0
    for begin, end in spans:
        read = max(read, begin)
        if read <= end - size:
            near = bare(words[read:end])
            for k in range(len(near) - size + 1):
                g = tuple(near[k : k + size])
                if g in want:
                    held += not want[g]
                    want[g] += 1
                    places.append((read + k, g))
            read = end - size + 1
        while places and places[0][0] < begin:
            g = places.popleft()[1]
            want[g] -= 1
            held -= not want[g]
        out.append(held / len(want) if want else 1.0)
    return out


def matches(index: Index, texts: list[bytes]) -> list[tuple[int, int, float, int, float, float]]:
    """(text, item's place, BM25, first word of the best window of those that pass, overlaps)."""
    none, size = len(index.term), index.window
    get = index.term.get
    split = [C.words_of(t) for t in texts]
    starts = [windows_of(len(w), size) for w in split]
    text = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    numbers = [np.fromiter((get(x, none) for x in w), np.int64, len(w)) for w in split]
    terms = np.full((len(text), size), none, np.int64)
    for row, (i, s) in enumerate((i, s) for i, ss in enumerate(starts) for s in ss):
        x = numbers[i][s : s + size]
        terms[row, : len(x)] = x
    order = np.argsort(terms, axis=1, kind="stable")
    ranked = np.take_along_axis(terms, order, 1)
    first = np.zeros(terms.shape, bool)
    np.put_along_axis(first, order, np.concatenate([np.ones((len(terms), 1), bool), ranked[:, 1:] != ranked[:, :-1]], axis=1), 1)
    first &= terms < none
    hits: dict[tuple[int, int], list[tuple[float, int]]] = {}
    at = [s for ss in starts for s in ss]
    for w, item, total in zip(*(x.tolist() for x in retrieve(index, terms, first)), strict=True):
        hits.setdefault((int(text[w]), item), []).append((total, at[w]))
    out = []
    for (i, item), windows in hits.items():
        begins = sorted(s for _, s in windows)
        reach = max(size, index.lengths[item])  # a copy of the item that the window touches lies within
        spans = [(max(0, s - reach), min(len(split[i]), s + size + reach)) for s in begins]
        shares = dict(zip(begins, zip(*(covered(split[i], spans, part) for part in index.parts[item]), strict=True), strict=True))
        good = [(total, -s) for total, s in windows if min(shares[s]) >= OVERLAP]
        if good:
            total, start = max(good)
            out.append((i, item, total * float(index.needs[item]), -start, *shares[-start]))
    return out


def _words(batches):
    """The distinct words of each item, and a row without a word that has its number of words."""
    for batch in batches:
        for k, text in zip(batch.column("round").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = C.words_of(text)
            if words:
                some = [None, *set(words)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.int32()), pa.array(some, pa.binary()), pa.array([len(words)] * len(some), pa.int64())], ["round", "word", "words"])


def _run(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            ids, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) < 500_000:
                    size += len(texts[end])
                    end += 1
                found = matches(index, texts[at:end])
                rows = [(ids[at + i], index.ids[item], *rest) for i, item, *rest in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()))], ["doc_id", "item_id", "score", "at_word", "question_overlap", "answer_overlap"])
                at = end

    return run


def contaminated(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", items_at_once: int = ITEMS) -> DataFrame:
    """A row for each text and item that it holds: doc_id, item_id, score (BM25), at_word (where the best window that passes begins), question_overlap, answer_overlap."""
    spark = docs.sparkSession
    C.prepare(spark)
    docs, out = C.id_and_text(docs, key, text), None
    items = C.id_and_text(items, item_key, item_text).distinct()
    n = items.count()
    rounds = -(-n // items_at_once)
    whole = None
    if rounds > 1:
        scratch = C.Scratch(spark, "decontam")
        items = scratch.write(items.withColumn("round", F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)).cast("int")), "items")
        words = items.select("round", "text").mapInArrow(_words, "round int, word binary, words long")
        count, total, longest = words.where("word is null").agg(F.count("*"), F.sum("words"), F.max("words")).first()
        counts = words.where("word is not null").groupBy("word", "round").agg(F.count("*").alias("n"))
        of_all = counts.groupBy("word").agg(F.sum("n").alias("df"), F.collect_list("round").alias("rounds"))
        counts = scratch.write(of_all.select(F.explode("rounds").alias("round"), "word", "df"), "counts")
    for k in range(rounds):
        some = items.where(F.col("round") == k) if rounds > 1 else items
        if rounds > 1:
            whole = (count, (total or 0) / max(1, count), longest or 0, {bytes(r["word"]): r["df"] for r in counts.where(F.col("round") == k).toLocalIterator()})
        index = Index([(r["doc_id"], bytes(r["text"])) for r in some.toLocalIterator()], whole)
        found = docs.mapInArrow(C.lean("decontam", _run(spark.sparkContext.broadcast(index))), SCHEMA)
        out = found if out is None else out.unionAll(found)
    return (spark.createDataFrame([], SCHEMA) if out is None else out).distinct()
