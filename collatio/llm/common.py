"""Shared pieces: shared scratch storage, word splitting, hashing, checked broadcasts, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, delete_at_end, new_folder

#: Rows and bytes of an Arrow batch; whole texts travel in them, so that batches stay small.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, for this session from now on: a frame is planned when it is run, so its settings can't end with the call that made it. A setting of the session's user stays."""
    for name, usual, small in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", usual) == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", small)


class Scratch:
    """Tables that cut lineage, in the shared folder. A lost executor costs the tasks that ran on it, never a table. The folder goes when the session's driver ends, or earlier by close() (or as a context manager), where the result has been taken."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, new_folder(spark, name)
        delete_at_end(spark, self.path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        delete(self.spark, self.path)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(f"{name}-{uuid.uuid4().hex[:8]}")
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)


def own(*names: str) -> list[str]:
    """Names of columns that no input has."""
    tag = uuid.uuid4().hex
    return [f"{n}_{tag}" for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that operators read; a null text is an empty one; bytes, so that Python need not decode them."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))


def uncollected(run: Callable) -> Callable:
    """The same function of batches, with the search for cyclic garbage at rest inside a batch: it would walk the many short lists that a batch makes, which hold no cycles. After each batch it looks at what is new."""

    def calm(batches):
        was = gc.isenabled()
        gc.disable()
        try:
            for out in run(batches):
                yield out
                gc.collect(1)
        finally:
            if was:
                gc.enable()

    return calm


_HELD: dict[tuple, object] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def release() -> None:
    """Gives freed memory back to the system: Arrow's pool and the C library keep it otherwise as long as the worker lives, also while it waits for work."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def held(operator: str, key: object, make: Callable):
    """What a worker keeps of an operator from task to task. A worker serves one operator after another; what it keeps of others goes."""
    leave(operator)
    if (operator, key) not in _HELD:
        _HELD[operator, key] = make()
    return _HELD[operator, key]


def leave(operator: str = "") -> None:
    """Lets go what this process keeps of operators other than this one."""
    others = [k for k in _HELD if k[0] != operator]
    for k in others:
        del _HELD[k]
    if others:
        WORDS.clear()
        gc.collect()


def lean(operator: str, run: Callable) -> Callable:
    """The same function of batches in a worker that keeps little: nothing of other operators, and no freed memory after a batch."""

    def tidy(batches):
        leave(operator)
        for out in run(batches):
            yield out
            del out
            release()

    return tidy


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """The broadcast hint if df (a table already written) has at most so many rows, else df itself, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class WordHashes(dict):
    """64-bit hashes of words, kept up to a number of entries, then computed anew."""

    KEEP = 150_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.KEEP:
            self.clear()
        self[word] = h
        return h


WORDS = WordHashes()


def words_of(data: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at the six ASCII white-space characters, as bytes.split does."""
    return data.lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


_STEP = [np.uint64(int(_ODD[i % 8]) * (i + 1) % 2**64) for i in range(64)]


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct elements; by sorting, which takes a small part of what a hash table does."""
    y = np.sort(x)
    return y[np.append(True, y[1:] != y[:-1])] if len(y) else y


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of k-word shingles; fewer words make one shingle; none make none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, n)
    if n < k:
        x = np.array([n], np.uint64)
        for i in range(n):
            x = mix(x * _ODD[7] + h[i])
        return x
    s = h[: n - k + 1] * _ODD[0]
    for i in range(1, k):
        s = s + mix(h[i : n - k + 1 + i] + _STEP[i])
    return distinct(mix(s))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns a, b (long) of undirected links to (node, component): the smallest node that can be reached, for every node that has a link.

    Alternating large-star and small-star steps (Kiveris et al., Connected components in MapReduce and beyond, 2014); each step is a few aggregations and joins, no neighbourhood is gathered in one place.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, before = scratch.write(e, "edges"), None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = mark
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = scratch.write(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = scratch.write(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "small")
