"""Global scores: pairs of reference and hypothesis, measures of each pair, rollups by experiment and model."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import kernels
from ..functions.text import words

EDITS = [f"{kind}_{edit}" for kind in ("character", "word") for edit in ("substitutions", "deletions", "insertions")]
PER_FILE = (
    "experiment model file status reference_characters hypothesis_characters character_substitutions character_deletions character_insertions character_errors cer "
    "reference_words hypothesis_words word_substitutions word_deletions word_insertions word_errors wer word_matches word_precision word_recall word_f1 exact_match"
).split()


def _every(references: DataFrame, models: DataFrame) -> DataFrame:
    """Each reference for each model: a model's folder is meant to have every file. The list of models is broadcast only if it was counted to be short."""
    return references.crossJoin(F.broadcast(models) if models.limit(10_001).count() <= 10_000 else models)


def pair(references: DataFrame, models: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """references (file, ref), models (experiment, model), hypotheses (experiment, model, file, hyp): a row for each model and reference, with status. models is a short list of folders; a model without files keeps all its references as missing."""
    joined = _every(references, models).join(hypotheses, ["experiment", "model", "file"], "left")
    status = F.when(F.col("hyp").isNull(), "missing_hypothesis").when(F.col("hyp") == "", "empty_hypothesis").otherwise("ok")
    return joined.select("experiment", "model", "file", "ref", F.coalesce("hyp", F.lit("")).alias("hyp"), status.alias("status"))


def extra(references: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Files of hypotheses that no reference has."""
    return hypotheses.join(references, "file", "left_anti").select("experiment", "model", "file")


def missing(references: DataFrame, models: DataFrame, hypotheses: DataFrame) -> DataFrame:
    return _every(references, models).join(hypotheses, ["experiment", "model", "file"], "left_anti").select("experiment", "model", "file")


def matched(truth: DataFrame, read: DataFrame, on: str = "document") -> DataFrame:
    """Documents that both sides have."""
    return read.join(truth, on)


@F.pandas_udf(StructType([StructField(x, LongType()) for x in EDITS]))
def edit_counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    both = list(zip(ref, hyp, strict=True))
    rows = [(*c, *w) for c, w in zip(kernels.edits_of(both), kernels.edits_of([(a.split(), b.split()) for a, b in both]), strict=True)]
    return pd.DataFrame(rows, columns=EDITS, dtype="int64")


@F.arrow_udf(StructType([StructField(x, LongType()) for x in EDITS[:3]]))
def character_edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """The first half of edit_counts(), alone."""
    rows = kernels.edits_of(list(zip(ref.to_pylist(), hyp.to_pylist(), strict=True)))
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=EDITS[:3])


def edits(kind: str, ref: str = "ref", hyp: str = "hyp") -> Column:
    """Edits between two texts, in characters or words."""

    @F.pandas_udf(LongType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        part = (lambda t: t) if kind == "character" else str.split
        return pd.Series([0 if x == y else kernels.distance(part(x), part(y)) for x, y in zip(a, b, strict=True)], dtype="int64")

    return run(ref, hyp)


def error_rate(errors: Column, reference: Column, hypothesis: Column) -> Column:
    """errors / reference; 0 for two empty texts, null if only the reference is empty. May exceed 1."""
    return F.when(reference > 0, errors / reference).when(hypothesis == 0, 0.0)


def shares(matches: Column, reference: Column, hypothesis: Column) -> list[Column]:
    """Precision, recall and F1 of bags of words."""
    part = lambda size, other: F.when(size > 0, matches / size).otherwise(F.when(other == 0, 1.0).otherwise(0.0))
    f1 = F.when(reference + hypothesis > 0, 2 * matches / (reference + hypothesis)).otherwise(1.0)
    return [part(hypothesis, reference), part(reference, hypothesis), f1]


def bag_matches(ref: str, hyp: str) -> Column:
    """Words in common, with their multiplicity: for each distinct word the smaller count."""
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    a, b = words(F.col(ref)), words(F.col(hyp))
    return F.aggregate(F.array_intersect(a, b), F.lit(0).cast("long"), lambda acc, w: acc + F.least(count(a, w), count(b, w)).cast("long"))


@F.pandas_udf(LongType())
def bag_matches_udf(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """For long texts: one pass instead of one for each distinct word."""
    return pd.Series([kernels.overlap(a.split(), b.split()) for a, b in zip(ref, hyp, strict=True)], dtype="int64")


def measure(pairs: DataFrame) -> DataFrame:
    """All measures of each pair; ref and hyp are normalised. One kernel call a row."""
    x = pairs.withColumn("_e", edit_counts("ref", "hyp")).withColumn("word_matches", bag_matches_udf("ref", "hyp")).select("*", "_e.*").drop("_e")
    for name, col in (("reference", "ref"), ("hypothesis", "hyp")):
        x = x.withColumn(f"{name}_characters", F.length(col).cast("long")).withColumn(f"{name}_words", F.size(words(F.col(col))).cast("long"))
    for kind in ("character", "word"):
        x = x.withColumn(f"{kind}_errors", F.col(f"{kind}_substitutions") + F.col(f"{kind}_deletions") + F.col(f"{kind}_insertions"))
    x = x.withColumn("cer", error_rate(F.col("character_errors"), F.col("reference_characters"), F.col("hypothesis_characters"))).withColumn("wer", error_rate(F.col("word_errors"), F.col("reference_words"), F.col("hypothesis_words")))
    for name, c in zip(("word_precision", "word_recall", "word_f1"), shares(F.col("word_matches"), F.col("reference_words"), F.col("hypothesis_words")), strict=True):
        x = x.withColumn(name, c)
    return x.withColumn("exact_match", F.col("ref") == F.col("hyp")).select(*PER_FILE)


def statistics(name: str) -> list[Column]:
    """Mean, median, population deviation, least and most of the finite values."""
    c = F.when(~F.isnan(name) & (F.abs(name) < float("inf")), F.col(name))
    return [f(c).alias(f"macro_{name}_{a}") for f, a in ((F.avg, "mean"), (F.median, "median"), (F.stddev_pop, "population_stddev"), (F.min, "min"), (F.max, "max"))]


def summarize(files: DataFrame) -> DataFrame:
    """By experiment and model: counts by status, totals, micro rates of the totals, macro statistics of the files."""
    sums = [f"{k}_{x}" for k in ("character", "word") for x in ("substitutions", "deletions", "insertions", "errors")]
    totals = [f"{x}_{k}" for k in ("characters", "words") for x in ("reference", "hypothesis")]
    count = lambda condition: F.count_if(condition)
    out = files.groupBy("experiment", "model").agg(
        F.count("*").alias("reference_files"),
        count(F.col("status") != "missing_hypothesis").alias("found_hypotheses"),
        count(F.col("status") == "missing_hypothesis").alias("missing_hypotheses"),
        count(F.col("status") == "empty_hypothesis").alias("empty_hypotheses"),
        count(F.col("exact_match")).alias("exact_matches"),
        *(F.sum(c).alias(f"total_{c}") for c in [*totals, "word_matches"]),
        *(F.sum(c).alias(c) for c in sums),
        *statistics("cer"),
        *statistics("wer"),
    )
    r, h, m = F.col("total_reference_words"), F.col("total_hypothesis_words"), F.col("total_word_matches")
    micro = [F.when(F.col(f"total_reference_{k}s") > 0, F.col(f"{k}_errors") / F.col(f"total_reference_{k}s")).alias(f"micro_{n}") for k, n in (("character", "cer"), ("word", "wer"))]
    parts = [c.alias(f"micro_word_{n}") for c, n in zip(shares(m, r, h), ("precision", "recall", "f1"), strict=True)]
    return out.select("*", F.try_divide("exact_matches", "reference_files").alias("exact_match_rate"), *micro, *parts)
