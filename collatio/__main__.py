"""Runs from the command line: transcribe, normalize, evaluate, parse, fields."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize_udf
from .operators import evaluate, fields, parse, runs
from .sources import files, sinks


def arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="collatio")
    sub = top.add_subparsers(dest="command", required=True)
    x = sub.add_parser("transcribe")
    x.add_argument("--models", nargs="+", required=True)
    x.add_argument("--url", required=True)
    x.add_argument("--image-dir", required=True)
    x.add_argument("--output-dir", required=True)
    x.add_argument("--prompt", required=True)
    x.add_argument("--experiment-id", "--run-id", type=int)
    x.add_argument("--description", default="")
    x.add_argument("--limit", type=int)
    x.add_argument("--overwrite", action="store_true")
    x.add_argument("--timeout", type=int, default=runs.DEFAULTS["timeout_seconds"])
    x.add_argument("--num-ctx", type=int, default=runs.DEFAULTS["num_ctx"])
    x.add_argument("--num-predict", type=int, default=runs.DEFAULTS["num_predict"])
    x.add_argument("--keep-alive", default=runs.DEFAULTS["keep_alive"])
    x = sub.add_parser("normalize")
    x.add_argument("--references", required=True)
    x.add_argument("--hypotheses", required=True)
    x.add_argument("--output", required=True)
    x.add_argument("--pattern", default="*.txt")
    x.add_argument("--clean", action="store_true")
    x = sub.add_parser("evaluate")
    x.add_argument("--normalized", required=True)
    x.add_argument("--output", required=True)
    for name in ("parse", "fields"):
        x = sub.add_parser(name)
        x.add_argument("input" if name == "parse" else "ocr_dir")
        x.add_argument("--templates", required=True)
        x.add_argument("--output", required=True)
        x.add_argument("--pattern", default="*.txt")
        x.add_argument("--global-threshold", type=float, default=parse.GLOBAL)
        x.add_argument("--recovery-threshold", type=float, default=parse.RECOVERY)
        x.add_argument("--local-fuzzy-threshold", type=float, default=parse.LOCAL)
    x.add_argument("--gt-dir", required=True)
    x.add_argument("--dictionaries")
    x.add_argument("--dictionary-threshold", type=float, default=fields.THRESHOLD)
    x.add_argument("--dictionary-margin", type=float, default=fields.MARGIN)
    return top.parse_args(argv)


def transcribe(spark: SparkSession, a: argparse.Namespace) -> int:
    parameters = runs.DEFAULTS | {"num_ctx": a.num_ctx, "num_predict": a.num_predict, "keep_alive": a.keep_alive, "timeout_seconds": a.timeout}
    try:
        installed = runs.HttpClient(a.url).installed()
    except runs.CallError as e:
        print(e, file=sys.stderr)
        return 1
    url = a.url
    code, totals = runs.run(spark, image_dir=a.image_dir, output_dir=a.output_dir, models=a.models, client=lambda: runs.HttpClient(url, parameters), installed=installed, default_prompt=a.prompt, experiment=a.experiment_id, description=a.description, limit=a.limit, overwrite=a.overwrite, parameters=parameters)
    print(totals)
    return code


def normalize(spark: SparkSession, a: argparse.Namespace) -> int:
    """Normalised texts as Parquet: references, and hypotheses by experiment and model; and a report."""
    refs, hyps = files.references(spark, a.references, a.pattern), files.hypotheses(spark, a.hypotheses, a.pattern)
    refs.select("file", normalize_udf("ref").alias("ref")).write.mode("overwrite").parquet(f"{a.output}/references")
    sinks.write_texts(hyps.select("experiment", "model", "file", normalize_udf("hyp").alias("hyp")), f"{a.output}/hypotheses", clean=a.clean)
    models = files.models(spark, a.hypotheses)
    models.write.mode("overwrite").parquet(f"{a.output}/models")  # folders without files too
    told = sinks.normalization_report(refs, hyps, sources={"ground_truth": a.references, "model_outputs": a.hypotheses}, destinations={"references": f"{a.output}/references", "hypotheses": f"{a.output}/hypotheses"})
    sinks.pretty(spark, told, f"{a.output}/normalization_report.json")
    print(f"normalised: {told['reference_files']} references, {sum(m['normalized_files'] for m in told['models'])} hypotheses")
    return 0


def measure(spark: SparkSession, a: argparse.Namespace) -> int:
    refs, models, hyps = (spark.read.parquet(f"{a.normalized}/{n}") for n in ("references", "models", "hypotheses"))
    rows = evaluate.measure(evaluate.pair(refs, models, hyps))
    rows.write.mode("overwrite").parquet(f"{a.output}/per_file_metrics")
    rows = spark.read.parquet(f"{a.output}/per_file_metrics")
    summary = evaluate.summarize(rows)
    sinks.write_csv(rows, f"{a.output}/per_file_metrics.csv", evaluate.PER_FILE)
    sinks.write_csv(summary, f"{a.output}/model_summary.csv")
    told = sinks.metrics_report(rows, summary, evaluate.extra(refs, hyps), inputs={"normalized": a.normalized}, outputs={"per_file_metrics": f"{a.output}/per_file_metrics.csv", "model_summary": f"{a.output}/model_summary.csv"})
    sinks.pretty(spark, told, f"{a.output}/metrics_report.json")
    print(told["status_counts"])
    return 0


def _texts(spark: SparkSession, path: str, pattern: str, name: str):
    """document, text of one file or of a folder's."""
    found = files.texts(spark, path if path.endswith(".txt") else f"{path}/{pattern}")
    return found.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("document"), F.col("text").alias(name))


def parsed(spark: SparkSession, a: argparse.Namespace) -> int:
    thresholds, found = (a.global_threshold, a.recovery_threshold, a.local_fuzzy_threshold), files.templates(spark, a.templates)
    docs = files.assign(_texts(spark, a.input, a.pattern, "text"), found)
    rows = docs.select("document", "template", parse.parsed(F.col("text"), {n: f for n, _, f in found}, thresholds, F.col("template")).alias("rows"))
    sinks.write_json(parse.documents(rows, "rows", "template", keep=["document"], thresholds=thresholds), a.output)
    counts = spark.read.json(a.output).select(F.explode("fields").alias("f")).agg(F.count("*").alias("n"), F.count_if(F.col("f.key.status") != "missing").alias("found")).first()
    print(f"keys found: {counts['found']}/{counts['n']} ({100 * counts['found'] / max(1, counts['n']):.2f}%)")
    return 0


def scored(spark: SparkSession, a: argparse.Namespace) -> int:
    thresholds, found = (a.global_threshold, a.recovery_threshold, a.local_fuzzy_threshold), files.templates(spark, a.templates)
    terms = files.terms_of(files.dictionaries(spark, a.dictionaries or f"{a.templates}/dictionaries.yaml"))
    pairs = evaluate.matched(_texts(spark, a.gt_dir, a.pattern, "gt_text"), _texts(spark, a.ocr_dir, a.pattern, "ocr_text"))
    by_name = {n: f for n, _, f in found}
    rows = fields.evaluate(files.assign(pairs, found), by_name, terms, thresholds=thresholds, threshold=a.dictionary_threshold, margin=a.dictionary_margin)
    rows.write.mode("overwrite").parquet(f"{a.output}/all_fields")
    rows = spark.read.parquet(f"{a.output}/all_fields")
    sinks.write_csv(rows, f"{a.output}/all_fields.csv", bom=True)
    sinks.write_csv(rows, f"{a.output}/documents", by=["document"], bom=True)
    for name, summary in (("field", fields.field_summary), ("document", fields.document_summary), ("category", fields.category_summary)):
        sinks.write_csv(summary(rows), f"{a.output}/{name}_summary.csv", bom=True)
    for side in ("ocr", "gt"):
        x = files.assign(pairs, found).select("document", "template", parse.parsed(F.col(f"{side}_text"), by_name, thresholds, F.col("template")).alias("rows"))
        sinks.write_json(parse.documents(x, "rows", "template", keep=["document"], thresholds=thresholds), f"{a.output}/parsed_{side}")
    fields.report(rows, f"{a.output}/report.json", inputs={"ocr_dir": a.ocr_dir, "gt_dir": a.gt_dir}, thresholds=thresholds, threshold=a.dictionary_threshold, margin=a.dictionary_margin)
    print(fields.console(rows).first().asDict())
    return 0


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    """0: done; 1: nothing to work on; 2: done, but calls failed."""
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("collatio").getOrCreate()
    try:
        return {"transcribe": transcribe, "normalize": normalize, "evaluate": measure, "parse": parsed, "fields": scored}[a.command](spark, a)
    except files.NoInput as e:
        print(f"nothing found: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
