"""Scores of fields before and after correction: keys from templates, values from dictionaries.

One Arrow function a document parses both sides, corrects and aligns; everything after it (flags, rates, sums) is native. Dictionaries are configuration, as templates are. Documents never meet: no shuffle before the summaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.text import pieces
from ..sources import shared, sinks
from .evaluate import error_rate
from .parse import AT_ONCE, GLOBAL, KNOWN, LOCAL, RECOVERY, Template, Templates, arrow_type, by_template, filled

THRESHOLD, MARGIN = 70.0, 15.0
COUNTS = [f"{side}_{unit}s" for unit in ("char", "word") for side in ("ref", "hyp")] + [f"{unit}_{edit}" for unit in ("char", "word") for edit in ("substitutions", "deletions", "insertions")]
COUNTED = f"struct<{','.join(f'{c}:long' for c in COUNTS)}>"
BEST = "struct<candidate:string,score:double,second_score:double,phrase:string>"
#: What of a parsed field is asked for later, of the truth and of the reading.
TRUTH = "struct<field_order:int,key_id:string,key_expected:string,key_found:string,key_status:string,field_id:string,category:string,value:string>"
READ = "struct<key_found:string,key_status:string,dictionary:string,value:string,boundary_status:string,region:string>"
SIDES = f"struct<gt:{TRUTH},ocr:{READ},key_post:string,value_post:string,whole:{BEST},region:{BEST},recovered:boolean,corrected:boolean,key_pre_counts:{COUNTED},key_post_counts:{COUNTED},value_pre_counts:{COUNTED},value_post_counts:{COUNTED}>"


def counted(ref: str, hyp: str) -> dict[str, int]:
    """Lengths and edit operations of two normalised texts."""
    a, b = ref.split(), hyp.split()
    edits = (0,) * 6 if ref == hyp else (*kernels.edits(ref, hyp), *kernels.edits(a, b))
    return dict(zip(COUNTS, (len(ref), len(hyp), len(a), len(b), *edits), strict=True))


class Terms:
    """A dictionary: the best and the second term for a text, kept for texts met before. Of equals the later term in the alphabet is the better."""

    def __init__(self, terms: list[str]):
        self.terms, self.known = list(terms), {}

    def _best(self, scored: list[tuple[float, str, str]]) -> dict | None:
        first, second = (sorted(scored, reverse=True)[:2] + [None, None])[:2]
        return first and {"candidate": first[1], "score": first[0], "second_score": second[0] if second else 0.0, "phrase": first[2]}

    def whole(self, text: str) -> dict | None:
        return self._keep(("whole", text), lambda: [(kernels.ratio(text, t), t, text) for t in self.terms])

    def within(self, region: str) -> dict | None:
        """Each term against the windows of about as many words; the first of its best windows counts."""
        words = region.split()

        def scored():
            for t in self.terms:
                n = len(t.split())
                windows = [" ".join(words[i : i + k]) for k in ([1] if n == 1 else range(n - 1, n + 2)) for i in range(len(words) - k + 1)]
                if windows:
                    best = max(windows, key=lambda w: kernels.ratio(w, t))
                    yield kernels.ratio(best, t), t, best

        return self._keep(("within", region), scored)

    def _keep(self, key: tuple[str, str], scored) -> dict | None:
        if not key[1]:
            return None
        if key not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[key] = self._best(list(scored()))
        return self.known[key]


def accepts(best: dict | None, threshold: float, margin: float) -> bool:
    return best is not None and best["score"] >= threshold and best["score"] - best["second_score"] >= margin


def process(gt: dict, ocr: dict, terms: Terms | None, threshold: float, margin: float) -> dict:
    """One field of both sides: what correction makes of key and value, and all edit counts."""
    key, pre = ocr["key_found"], ocr["value"]
    whole = terms.whole(pre) if terms and ocr["category"] == "dictionary" else None
    region = terms.within(ocr["region"]) if terms and ocr["category"] == "dictionary" and ocr["key_status"] == "missing" else None
    recovered = accepts(region, threshold, margin)
    post = region["candidate"] if recovered else whole["candidate"] if accepts(whole, threshold, margin) else pre
    key_post = ocr["key_text"] if key else key
    out = {"gt": gt, "ocr": ocr, "key_post": key_post, "value_post": post, "whole": whole, "region": region, "recovered": recovered, "corrected": region["phrase"] != post if recovered else post != pre}
    for part, true, before, after in (("key", gt["key_found"], key, key_post), ("value", gt["value"], pre, post)):
        counts = counted(true, before)
        out |= {f"{part}_pre_counts": counts, f"{part}_post_counts": counts if after == before else counted(true, after)}
    return out


def scorer(templates: Templates, terms: dict[str, list[str]], thresholds: tuple[float, float, float], threshold: float, margin: float):
    """The function of both texts and names of templates. Rows leave the worker by pieces of a batch, as Arrow arrays; equal texts of a piece are parsed once."""
    kind = arrow_type(f"array<{SIDES}>")

    @F.arrow_udf(f"array<{SIDES}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        compiled, dictionaries = {n: Template(f, thresholds) for n, f in templates.items()}, {n: Terms(t) for n, t in terms.items() if t}
        for truth, read, names in batches:
            for part in pieces(truth, AT_ONCE):
                for few in pieces(read[part], AT_ONCE):
                    rows = slice(part.start + few.start, part.start + few.stop)
                    of = names[rows].to_pylist()
                    both = by_template(filled(truth[rows]) + filled(read[rows]), of + of, compiled)
                    yield pa.array([[process(x, y, dictionaries.get(y["dictionary"]), threshold, margin) for x, y in zip(f, g, strict=True)] for f, g in zip(both[: len(of)], both[len(of) :], strict=True)], kind)

    return run


STAGES = ("pre", "post")


def evaluate(pairs: DataFrame, templates: Templates, terms: dict[str, list[str]], *, thresholds: tuple[float, float, float] = (GLOBAL, RECOVERY, LOCAL), threshold: float = THRESHOLD, margin: float = MARGIN, strict: bool = True) -> DataFrame:
    """pairs: document, template, gt_text, ocr_text (documents that both sides have). A row for each document and field, before (pre) and after (post) correction.

    A key that the truth itself lacks is an error of the data and ends the run, unless strict is false: guard() then lists them. Null texts are empty.
    Columns of names without stage keep the meaning of before. Texts of corrected keys are shown only where a key was corrected.
    """
    x = pairs.select("document", "template", F.explode(scorer(templates, terms, thresholds, threshold, margin)("gt_text", "ocr_text", "template")).alias("x"))
    lacks = F.col("x.gt.key_status") == "missing"
    if strict:
        x = x.where(F.when(lacks, F.raise_error(F.concat(F.lit("the truth lacks a key: "), "document", F.lit(" "), "x.gt.key_id")).cast("boolean")).otherwise(True))
    gt, ocr = (lambda c: F.col(f"x.gt.{c}")), (lambda c: F.col(f"x.ocr.{c}"))
    detected, whole, back = ocr("key_status") != "missing", ocr("boundary_status") == "ok", F.col("x.recovered")
    key_corrected = F.col("x.key_post") != ocr("key_found")
    best = F.when(back, F.col("x.region")).otherwise(F.col("x.whole"))
    two = lambda c: F.round(c, 2)
    evaluable = {"pre": whole, "post": whole | back}
    values, keys = {"pre": ocr("value"), "post": F.col("x.value_post")}, {"pre": ocr("key_found"), "post": F.col("x.key_post")}
    key_right = {s: keys[s] == gt("key_found") for s in STAGES}
    value_right = {s: F.when(evaluable[s], values[s] == gt("value")) for s in STAGES}

    def rate(part: str, stage: str, unit: str) -> Column:
        c = F.col(f"x.{part}_{stage}_counts")
        errors = reduce(Column.__add__, (c[f"{unit}_{e}"] for e in ("substitutions", "deletions", "insertions")))
        out = error_rate(errors, c[f"ref_{unit}s"], c[f"hyp_{unit}s"])
        return out if part == "key" else F.when(evaluable[stage], out)

    cols = {
        "document": F.col("document"), "template": F.col("template"), "order": gt("field_order"), "field_id": gt("field_id"), "category": gt("category"), "key_id": gt("key_id"), "key_expected": gt("key_expected"),
        "gt_key": gt("key_found"), "ocr_key": ocr("key_found"), **{f"ocr_key_{s}": F.when(key_corrected, keys[s]).otherwise("") for s in STAGES}, "key_status": ocr("key_status"), "key_detected": detected,
        "key_correct": key_right["pre"], **{f"key_correct_{s}": key_right[s] for s in STAGES},
        **{f"key_{n}{s and '_' + s}": rate("key", s or "pre", u) for s in ("", *STAGES) for n, u in (("cer", "char"), ("wer", "word"))},
        "key_correction_applied": key_corrected, "key_correction_source": F.when(key_corrected, "template_expected").otherwise(""),
        "gt_value": gt("value"), **{f"ocr_value_{s}": values[s] for s in STAGES}, "boundary_status": ocr("boundary_status"), **{f"value_evaluable_{s}": evaluable[s] for s in STAGES},
        "value_source_pre": F.when(whole, "normal").otherwise("unavailable"), "value_source_post": F.when(back, "dictionary_local_recovery").when(whole, "normal").otherwise("unavailable"),
        **{f"skip_reason_{s}": F.when(evaluable[s], "").otherwise(ocr("boundary_status")) for s in STAGES},
        "local_recovery_applied": back, "local_recovery_region": F.when((gt("category") == "dictionary") & ~detected, ocr("region")).otherwise(""), "local_recovery_match": F.coalesce("x.region.phrase", F.lit("")), "local_recovery_candidate": F.coalesce("x.region.candidate", F.lit("")),
        "local_recovery_score": two(F.col("x.region.score")), "local_recovery_second_score": two(F.col("x.region.second_score")), "local_recovery_margin": two(F.col("x.region.score") - F.col("x.region.second_score")),
        **{f"value_correct_{s}": value_right[s] for s in STAGES}, **{f"field_correct_{s}": F.when(evaluable[s], key_right[s] & value_right[s]) for s in STAGES},
        "dictionary": F.coalesce(ocr("dictionary"), F.lit("")), "correction_applied": F.col("x.corrected"), "correction_candidate": F.coalesce(best["candidate"], F.lit("")),
        "correction_score": two(best["score"]), "correction_second_score": two(best["second_score"]), "correction_margin": two(best["score"] - best["second_score"]),
        **{f"value_{n}_{s}": rate("value", s, u) for s in STAGES for n, u in (("cer", "char"), ("wer", "word"))},
        **{f"_{part}_{s}": F.col(f"x.{part}_{s}_counts") for part in ("key", "value") for s in STAGES}, "_gt_key_status": gt("key_status"),
    }
    return x.select(*(c.alias(n) for n, c in cols.items()))


def guard(fields: DataFrame) -> DataFrame:
    """Keys that the ground truth itself lacks; must be empty."""
    return fields.where("_gt_key_status = 'missing'").select("document", "key_id")


def count(c: Column | str) -> Column:
    return F.count_if(F.col(c) if isinstance(c, str) else c)


def severity(part: str, stage: str, usable: str) -> tuple[Column, Column, Column]:
    """Number, CER and WER of items that are usable and not exact: errors of all over references of all, null over none."""
    wrong = F.col(usable) & (F.col(f"{part}_correct_{stage}") == False)  # noqa: E712  null (not evaluable) stays out
    total = lambda c: F.sum(F.when(wrong, F.col(f"_{part}_{stage}")[c]))
    rates = [error_rate(sum((total(f"{u}_{e}") for e in ("deletions", "insertions")), total(f"{u}_substitutions")), total(f"ref_{u}s"), total(f"hyp_{u}s")) for u in ("char", "word")]
    return F.count_if(wrong), *rates


def shares(df: DataFrame, **names: tuple[str, str]) -> DataFrame:
    """df with quotients of two columns, null over nothing."""
    return df.withColumns({n: F.try_divide(a, b) for n, (a, b) in names.items()})


def field_summary(fields: DataFrame) -> DataFrame:
    """By field over all templates and documents."""
    key = severity("key", "pre", "key_detected")
    agg = [F.min_by("category", F.struct("document", "order")).alias("category"), F.array_join(F.array_sort(F.collect_set("key_expected")), " | ").alias("key_expected"), F.array_join(F.array_sort(F.collect_set("template")), " | ").alias("templates"), F.count("*").alias("occurrences")]
    agg += [count("key_detected").alias("key_detected"), count(~F.col("key_detected")).alias("key_missing"), count("key_correct_pre").alias("key_exact"), key[0].alias("key_non_exact_detected"), key[1].alias("key_cer_non_exact"), count("key_correction_applied").alias("key_corrections_applied")]
    for s in STAGES:
        n, cer, wer = severity("value", s, f"value_evaluable_{s}")
        agg += [count(f"value_evaluable_{s}").alias(f"value_evaluable_{s}"), count(~F.col(f"value_evaluable_{s}")).alias(f"value_skipped_{s}"), count(f"value_correct_{s}").alias(f"value_exact_{s}"), n.alias(f"value_non_exact_{s}"), cer.alias(f"value_cer_non_exact_{s}"), wer.alias(f"value_wer_non_exact_{s}"), count(f"field_correct_{s}").alias(f"field_correct_{s}")]
    agg += [count("correction_applied").alias("value_corrections_applied")]
    out = fields.groupBy("field_id").agg(*agg).withColumn("total_corrections_applied", F.col("key_corrections_applied") + F.col("value_corrections_applied"))
    out = out.withColumns({f"value_wer_non_exact_{s}": F.when(F.col("category") == "string", F.col(f"value_wer_non_exact_{s}")) for s in STAGES})
    out = shares(out, key_detection_rate=("key_detected", "occurrences"), key_exact_rate=("key_exact", "occurrences"))
    for s in STAGES:
        out = shares(out, **{f"value_coverage_{s}": (f"value_evaluable_{s}", "occurrences"), f"value_exact_rate_{s}": (f"value_exact_{s}", f"value_evaluable_{s}"), f"field_accuracy_conditional_{s}": (f"field_correct_{s}", f"value_evaluable_{s}"), f"field_success_rate_{s}": (f"field_correct_{s}", "occurrences")})
    return out


def document_summary(fields: DataFrame) -> DataFrame:
    agg = [F.min("template").alias("template"), F.count("*").alias("fields_total"), count("key_detected").alias("keys_detected"), count(~F.col("key_detected")).alias("keys_missing"), count("key_correct_pre").alias("keys_exact"), count("key_correction_applied").alias("key_corrections_applied")]
    for s in STAGES:
        agg += [count(f"value_evaluable_{s}").alias(f"values_evaluable_{s}"), count(~F.col(f"value_evaluable_{s}")).alias(f"values_skipped_{s}"), count(f"value_correct_{s}").alias(f"values_exact_{s}"), count(f"field_correct_{s}").alias(f"fields_correct_{s}")]
    out = fields.groupBy("document").agg(*agg, count("correction_applied").alias("value_corrections_applied")).withColumn("total_corrections_applied", F.col("key_corrections_applied") + F.col("value_corrections_applied"))
    out = shares(out, key_detection_rate=("keys_detected", "fields_total"), key_exact_rate=("keys_exact", "fields_total"))
    for s in STAGES:
        out = shares(out, **{f"value_coverage_{s}": (f"values_evaluable_{s}", "fields_total"), f"value_exact_rate_{s}": (f"values_exact_{s}", f"values_evaluable_{s}"), f"field_accuracy_conditional_{s}": (f"fields_correct_{s}", f"values_evaluable_{s}"), f"field_success_rate_{s}": (f"fields_correct_{s}", "fields_total")})
    return out


REPORTED = (("dictionary", "pre"), ("dictionary", "post"), ("numeric", "pre"), ("string", "pre"))


def category_summary(fields: DataFrame) -> DataFrame:
    """Five rows, also over nothing: keys, dictionary before and after, numeric, string. One pass over the fields; columns that a row hasn't are null."""
    spark, zero = fields.sparkSession, lambda c: F.coalesce(c, F.lit(0).cast("long"))
    n, cer, _ = severity("key", "pre", "key_detected")
    status = [F.count_if(F.col("key_status") == s).alias(f"items_{s}") for s in ("missing", "recovered", "local", "found")]
    key = fields.agg(F.count("*").alias("items_total"), count("key_detected").alias("items_detected"), *status, count("key_correct_pre").alias("items_exact"), n.alias("items_non_exact"), cer.alias("cer_non_exact"))
    key = shares(key.select(F.lit("key").alias("category"), F.lit("pre").alias("stage"), "*"), detection_rate=("items_detected", "items_total"), exact_rate=("items_exact", "items_total"))
    agg = []
    for s in STAGES:
        n, cer, wer = severity("value", s, f"value_evaluable_{s}")
        agg.append(F.struct(F.lit(s).alias("stage"), count(f"value_evaluable_{s}").alias("items_evaluated"), count(f"value_correct_{s}").alias("items_exact"), n.alias("items_non_exact"), cer.alias("cer_non_exact"), wer.alias("wer_non_exact")))
    values = fields.groupBy("category").agg(F.count("*").alias("items_total"), F.array(*agg).alias("of")).select("category", "items_total", F.inline("of"))
    named = spark.createDataFrame(REPORTED, "category string, stage string").join(values, ["category", "stage"], "left")
    named = named.withColumns({c: zero(F.col(c)) for c in ("items_total", "items_evaluated", "items_exact", "items_non_exact")}).withColumn("items_skipped", F.col("items_total") - F.col("items_evaluated")).withColumn("wer_non_exact", F.when(F.col("category") == "string", F.col("wer_non_exact")))
    return key.unionByName(shares(named, coverage=("items_evaluated", "items_total"), exact_rate=("items_exact", "items_evaluated")), allowMissingColumns=True)


def console(fields: DataFrame) -> DataFrame:
    """The counts that a run prints: one row."""
    out = fields.agg(F.count_distinct("document").alias("documents"), F.count("*").alias("fields"), count("key_detected").alias("keys_detected"), count("key_correct_pre").alias("keys_exact_pre"), count("key_correct_post").alias("keys_exact_post"), count("key_correction_applied").alias("keys_corrected"), *(count(~F.col(f"value_evaluable_{s}")).alias(f"values_skipped_{s}") for s in STAGES))
    return out.withColumns({f"{c}_percent": F.round(100 * F.try_divide(c, "fields"), 2) for c in ("keys_detected", "keys_exact_pre", "keys_exact_post")})


def report(fields: DataFrame, path: str, *, inputs: dict[str, str], thresholds: tuple[float, float, float] = (GLOBAL, RECOVERY, LOCAL), threshold: float = THRESHOLD, margin: float = MARGIN) -> None:
    """Parameters, policy of metrics and the three summaries as one JSON file. Documents may be many: their rows are written by the executors and never on the driver."""
    rows = lambda df, by: [r.asDict() for r in df.orderBy(*by).collect()]  # noqa: E731  as many as fields and categories
    names = ("global_threshold", "recovery_threshold", "local_fuzzy_threshold", "dictionary_threshold", "dictionary_margin")
    of_fields, spark = rows(field_summary(fields), ["field_id"]), fields.sparkSession
    documents = sinks.write_rows(document_summary(fields).orderBy("document"), shared.new_folder(spark, "rows"))
    data = {
        **inputs, "documents": spark.read.text(documents).count(), "fields": sum(f["occurrences"] for f in of_fields), "parameters": dict(zip(names, (*thresholds, threshold, margin), strict=True)),
        "metric_policy": {"value_exact_rate_denominator": "evaluable_items", "error_severity_subset": "evaluable_non_exact_items_only", "error_aggregation": "micro_sum_errors_over_sum_reference_units", "missing_keys_excluded_from_key_cer_non_exact": True},
        "key_postprocessing": {"enabled": True, "source": "template_expected", "detected_keys_only": True, "fill_missing_keys": False, "public_pre_post_text_only_when_changed": True},
        "field_summary": of_fields, "document_summary": sinks.Rows(documents), "category_summary": rows(category_summary(fields), ["category", "stage"]),
    }
    sinks.by_line(spark, data, path)
    shared.delete(spark, documents)
