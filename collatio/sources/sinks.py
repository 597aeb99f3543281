"""Tables of results as CSV, JSON and Parquet, and the reports of runs."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BOM = "﻿"
#: What normalisation does and what the measures mean, as the reports say it.
RULES = {
    "unicode": "NFC",
    "case": "casefold",
    "line_breaks_and_whitespace": "replace with spaces and collapse",
    "punctuation_and_symbols": "replace with spaces",
    "accents": "preserved",
    "numbers": "preserved",
    "word_order": "preserved",
    "unclear_tag": "remove markup and preserve enclosed text",
    "gap_and_illegible_tags": "remove",
}
DEFINITIONS = {
    "cer": "character_errors / reference_characters",
    "wer": "word_errors / reference_words",
    "word_precision": "word_matches / hypothesis_words",
    "word_recall": "word_matches / reference_words",
    "word_f1": "2 * word_matches / (reference_words + hypothesis_words)",
    "missing_hypothesis": "evaluated as an empty hypothesis",
    "empty_reference": "per-file rate is 0 only when hypothesis is also empty; otherwise null",
    "cer_wer_can_exceed_one": True,
}


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, as tables for readers have them; nothing computes on from here."""
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def public(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if not c.startswith("_")))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, by: list[str] | None = None, bom: bool = False) -> bool:
    """A folder of CSV files with a header: fixed columns, nulls blank, private columns left out. by: a folder for each value. bom: a byte order mark before each header. Without rows nothing is written (false)."""
    out = rounded(public(df) if columns is None else df.select(*columns))
    if out.isEmpty():
        return False
    if bom:
        first = next(c for c in out.columns if c not in (by or []))
        out = out.withColumnRenamed(first, BOM + first)
    writer = out.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "")
    (writer.partitionBy(*by) if by else writer).csv(path)
    return True


def write_json(df: DataFrame, path: str, by: list[str] | None = None, append: bool = False) -> None:
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_texts(df: DataFrame, path: str, clean: bool = True) -> None:
    """Normalised texts, by experiment and model. clean: what an earlier run left goes first; else only the folders that are written again."""
    writer = df.write.partitionBy("experiment", "model").mode("overwrite")
    writer.option("partitionOverwriteMode", "static" if clean else "dynamic").parquet(path)


def report(df: DataFrame) -> DataFrame:
    """One row of JSON with all rows of a small summary."""
    return df.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("rows"), F.count("*").alias("n"))).alias("report"))


def pretty(spark: SparkSession, data: dict, path: str) -> None:
    """A dict as one JSON file for people."""
    shared.write_text(spark, path, json.dumps(data, ensure_ascii=False, indent=2, default=str) + "\n")


class Rows(NamedTuple):
    """A folder of write_rows(), in the place of a list."""

    folder: str


def write_rows(df: DataFrame, folder: str) -> str:
    """Rows as JSON in files of lines, in order; each line begins with the comma that parts it from the one before."""
    df.select(F.concat(F.lit(","), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))).write.option("compression", "none").text(folder)
    return folder


def by_line(spark: SparkSession, data: dict, path: str) -> None:
    """A dict as one JSON file that is read again line by line: each value has a line, and each item of a list. Files of rows are joined as bytes, with a buffer's memory on the driver."""
    told = lambda x: json.dumps(x, ensure_ascii=False, default=str)
    with shared.create(spark, path) as (text, file):
        for i, (name, value) in enumerate(data.items()):
            text(("{\n" if i == 0 else ",\n") + told(name) + ": ")
            if isinstance(value, Rows):
                text("[\n")
                for k, part in enumerate(shared.parts(spark, value.folder)):
                    file(part, 1 if k == 0 else 0)
                text("]")
            else:
                text("[\n" + "\n,".join(map(told, value)) + "\n]" if isinstance(value, list) else told(value))
        text("\n}\n" if data else "{}\n")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """What by_line() wrote, by many tasks: name and JSON of each value, items of lists without a name."""
    line, named = F.regexp_replace("value", "^,|,$", ""), r'^"([^"]+)": (.+)$'
    x = spark.read.text(path).select(F.regexp_extract(line, named, 1).alias("name"), line.alias("line"))
    value = F.when(F.col("name") != "", F.regexp_extract("line", named, 2)).otherwise(F.col("line"))
    return x.select(F.nullif("name", F.lit("")).alias("name"), value.alias("json")).where("json <> '[' and (name is not null or length(json) > 1)")


def _now() -> str:
    return datetime.now(UTC).isoformat()


def normalized_models(references: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """By experiment and model that has files: how many, the references it lacks, the files that no reference has. Names only, and only the differing ones are gathered."""
    have = hypotheses.select("experiment", "model", "file").distinct()
    counted = have.groupBy("experiment", "model").agg(F.count("*").alias("normalized_files"))
    names = references.select("file").distinct()
    lacks = counted.select("experiment", "model").crossJoin(names).join(have, ["experiment", "model", "file"], "left_anti").groupBy("experiment", "model").agg(F.array_sort(F.collect_list("file")).alias("missing_ground_truth_files"))
    extra = have.join(names, "file", "left_anti").groupBy("experiment", "model").agg(F.array_sort(F.collect_list("file")).alias("extra_output_files"))
    none = F.array().cast("array<string>")
    out = counted.join(lacks, ["experiment", "model"], "left").join(extra, ["experiment", "model"], "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("missing_ground_truth_files", "extra_output_files")})


def normalization_report(references: DataFrame, hypotheses: DataFrame, *, sources: dict[str, str], destinations: dict[str, str]) -> dict:
    models = normalized_models(references, hypotheses).orderBy("experiment", "model").collect()  # a row for each folder of a model
    return {"created_at_utc": _now(), "sources": sources, "destinations": destinations, "normalization_rules": RULES, "reference_files": references.select("file").distinct().count(), "models": [r.asDict() for r in models]}


def metrics_report(files: DataFrame, summaries: DataFrame, extra: DataFrame, *, inputs: dict[str, str], outputs: dict[str, str]) -> dict:
    """files: a row for each pair; summaries: by model; extra: files of hypotheses without a reference."""
    extras = extra.groupBy("experiment", "model").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("experiment", "model").collect()
    return {
        "created_at_utc": _now(), "evaluation_mode": "normalized", "inputs": inputs | {"reference_files": files.select("file").distinct().count()}, "outputs": outputs, "definitions": DEFINITIONS,
        "model_summaries": [r.asDict() for r in rounded(summaries).orderBy("experiment", "model").collect()], "extra_output_files": [r.asDict() for r in extras], "status_counts": {r["status"]: r["count"] for r in files.groupBy("status").count().collect()},
    }
