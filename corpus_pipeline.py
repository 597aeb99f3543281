"""A training corpus from documents: toxic texts, near copies and benchmark passages go, secrets are masked, what stays is encoded.

Each stage reads all that its predecessor kept. STAGES: toxicity, near-dedup, decontamination, secret scans, BPE.
Every stage takes null texts as empty; rows that repeat a doc_id stand or fall together in toxicity and decontamination (if one text of an id is toxic or holds a benchmark item, all rows of it go; a null id is never dropped there). Near-dedup judges rows, not ids: equal or near texts leave one row, different texts of one id (or of none) stay. Empty tables pass through; extra columns of any name stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.llm import bpe, decontam, minhash, secrets, toxicity
from collatio.llm import common as C
from collatio.llm.queries import byte_bpe

#: Ids of documents to leave out that are broadcast at once (8 MB); more are joined by a shuffle.
IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame, scratch: C.Scratch, key: str = "doc_id") -> DataFrame:
    (name,) = C.own("gone")
    gone = scratch.write(ids.select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(C.broadcast_below(gone, IDS), docs[key].cast("long") == F.col(name), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs, C.table(spark, sf_dir, "labels"))
    return _without(docs, scored.where("predicted = 1"), C.Scratch(spark, "drop_toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = C.Scratch(spark, "drop_near_copies")
    if docs.groupBy(F.col("doc_id").cast("long").alias("id")).count().where("count > 1 or id is null").isEmpty():
        return _without(docs, minhash.near_duplicates(docs, shingle=5, percent=80).where("not kept"), scratch)
    (row,) = C.own("row")  # ids don't tell rows apart: numbers of a written table do
    rows = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    return _without(rows, minhash.near_duplicates(rows, key=row, shingle=5, percent=80).where("not kept"), scratch, row).drop(row)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontam.contaminated(docs, C.table(spark, sf_dir, "benchmark")), C.Scratch(spark, "drop_benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text, (base, spans) = docs.withColumn("text", F.coalesce("text", F.lit(""))), C.own("base", "spans")
    table = secrets.train(text.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = secrets.annotate(text, "text", table, base, spans).withColumn("text", secrets.redacted("text", spans)).drop(base, spans)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(docs, byte_bpe())
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("secrets", mask_secrets), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = C.Scratch(spark, "pipeline"), C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
