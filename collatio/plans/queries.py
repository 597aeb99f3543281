"""Queries over the test tables and their SQL in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate, fields, parse, runs
from ..sources import files, shared, sinks
from . import forms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The SQL of a view, its tables read from sf_dir."""
    sql = sql.replace(", 'g')", ")")
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# normalisation: whole texts of documents, with markup added so that every rule has work

TAGGED = "concat(text, ' <Unclear >x</ unclear> <gap/> </gap> 12-06 ſß')"
_FOLDED = "regexp_replace(regexp_replace({}, '(?i)<\\s*/?\\s*unclear\\s*>', ' ', 'g'), '(?i)<\\s*(?:gap|illegible)\\s*/?\\s*>', ' ', 'g')".format(TAGGED)
for _a, _b in T.FOLDS:
    _FOLDED = f"replace({_FOLDED}, '{_a}', '{_b}')"
NORMAL = f"trim(regexp_replace(regexp_replace(lower({_FOLDED}), '[\\p{{P}}\\p{{S}}]', ' ', 'g'), '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
SQL_NORMAL = f"WITH n AS (SELECT doc_id, {NORMAL} AS t FROM documents) "


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(TAGGED).alias("text"))


@query(SQL_NORMAL + "SELECT doc_id, md5(t) AS normalized_md5, length(t)::BIGINT AS characters FROM n")
def normalize_global(spark, sf_dir):
    t = T.normalized(F.col("text"))
    return tagged(spark, sf_dir).select("doc_id", F.md5(t.cast("binary")).alias("normalized_md5"), F.length(t).cast("long").alias("characters"))


@query("SELECT count(*)::BIGINT AS texts, 0::BIGINT AS different FROM documents")
def normalize_udf_equals_native(spark, sf_dir):
    x = tagged(spark, sf_dir).select(T.normalized(F.col("text")).alias("a"), T.normalize_udf("text").alias("b"))
    return x.agg(F.count("*").alias("texts"), F.count_if(F.col("a") != F.col("b")).alias("different"))


@query(SQL_NORMAL + "SELECT doc_id, len(list_filter(string_split(t, ' '), lambda w: w <> ''))::BIGINT AS tokens, 0::BIGINT AS misplaced FROM n")
def tokenize_offsets(spark, sf_dir):
    x = tagged(spark, sf_dir).withColumn("found", T.tokenize_udf("text"))
    return x.select("doc_id", F.size("found").cast("long").alias("tokens"), T.misplaced(F.col("text"), F.col("found")).cast("long").alias("misplaced"))


@query(SQL_NORMAL + "SELECT w AS word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(t, ' ')) AS w FROM n) WHERE w <> '' GROUP BY w")
def word_tokens(spark, sf_dir):
    return tagged(spark, sf_dir).select(F.explode(T.words(T.normalized(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*)::BIGINT AS texts, sum(length(regexp_replace(text, '[^\\n]', '', 'g')) + 1)::BIGINT AS lines FROM documents GROUP BY lang")
def characters_and_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("texts"), F.sum(F.size(F.split("text", "\n"))).alias("lines"))


@query(SQL_NORMAL + "SELECT g AS ngram, count(*)::BIGINT AS n FROM (SELECT unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS g FROM (SELECT string_split(t, ' ') AS ws FROM n)) GROUP BY g HAVING count(*) > 1")
def token_ngrams(spark, sf_dir):
    """Short texts have no array, so no row: a filter on their words would normalise every text a second time."""
    x = tagged(spark, sf_dir).select(T.words(T.normalized(F.col("text"))).alias("ws"))
    grams = F.transform(F.sequence(F.lit(0), F.size("ws") - 3), lambda i: F.concat_ws(" ", *(F.get("ws", i + k) for k in range(3))))
    return x.select(F.explode(F.when(F.size("ws") >= 3, grams)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n")).where("n > 1")


# pairs: the beginning of every document in four models' texts

PAIRS = f"WITH raw AS ({forms.PAIRS}), p AS (SELECT model, file, ref, coalesce(hyp, '') AS hyp, CASE WHEN hyp IS NULL THEN 'missing_hypothesis' WHEN hyp = '' THEN 'empty_hypothesis' ELSE 'ok' END AS status, list_filter(string_split(ref, ' '), lambda w: w <> '') AS rw, list_filter(string_split(coalesce(hyp, ''), ' '), lambda w: w <> '') AS hw FROM raw), "
#: Words as letters of one byte, from "!" on: their places among the pair's distinct words.
CODED = "c AS (SELECT *, list_distinct(list_concat(rw, hw)) AS u FROM p), d AS (SELECT *, levenshtein(ref, hyp)::BIGINT AS ce, levenshtein(array_to_string(list_transform(rw, lambda w: chr((32 + list_position(u, w))::INT)), ''), array_to_string(list_transform(hw, lambda w: chr((32 + list_position(u, w))::INT)), ''))::BIGINT AS we, coalesce(list_sum(list_transform(list_distinct(rw), lambda w: least(len(list_filter(rw, lambda x: x = w)), len(list_filter(hw, lambda x: x = w))))), 0)::BIGINT AS wm, length(ref)::BIGINT AS rc, length(hyp)::BIGINT AS hc, len(rw)::BIGINT AS rn, len(hw)::BIGINT AS hn FROM c) "
SQL_PAIRS = PAIRS + CODED


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, forms.PAIRS, "documents").repartition(spark.sparkContext.defaultParallelism, "file").withColumn("experiment", F.lit("experiment_001"))
    references = raw.where("model = 'm_exact'").select("file", "ref")
    models = spark.createDataFrame([("experiment_001", m) for m in ("m_exact", "m_ocr", "m_drop", "m_more")], "experiment string, model string")
    return evaluate.pair(references, models, raw.where("hyp is not null").select("experiment", "model", "file", "hyp"))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.measure(pairs(spark, sf_dir))


@query(SQL_PAIRS + "SELECT model, file, ce AS character_errors FROM d")
def char_edit_total(spark, sf_dir):
    return pairs(spark, sf_dir).select("model", "file", evaluate.edits("character").alias("character_errors"))


@query(SQL_PAIRS + "SELECT model, file, we AS word_errors FROM d")
def word_edit_total(spark, sf_dir):
    return pairs(spark, sf_dir).select("model", "file", evaluate.edits("word").alias("word_errors"))


@query("SELECT (SELECT 4 * count(*) FROM documents)::BIGINT AS pairs, 0::BIGINT AS violations")
def edit_invariants(spark, sf_dir):
    x = pairs(spark, sf_dir).withColumn("e", evaluate.character_edits("ref", "hyp"))
    total = F.col("e.character_substitutions") + F.col("e.character_deletions") + F.col("e.character_insertions")
    plain = F.call_function("levenshtein", F.col("ref"), F.col("hyp"), total.cast("int"))  # beyond the total it is -1: only the band up to it is filled
    wrong = (total != plain) | (F.col("e.character_deletions") - F.col("e.character_insertions") != F.length("ref") - F.length("hyp")) | (total > F.greatest(F.length("ref"), F.length("hyp")))
    return x.agg(F.count("*").alias("pairs"), F.count_if(wrong).alias("violations"))


@query(SQL_PAIRS + "SELECT model, file, round(CASE WHEN rc > 0 THEN ce / rc WHEN hc = 0 THEN 0.0 END, 6) AS cer, round(CASE WHEN rn > 0 THEN we / rn WHEN hn = 0 THEN 0.0 END, 6) AS wer FROM d")
def cer_wer_per_file(spark, sf_dir):
    return rounded(measured(spark, sf_dir).select("model", "file", "cer", "wer"))


SHARES = "round(CASE WHEN hn > 0 THEN wm / hn WHEN rn = 0 THEN 1.0 ELSE 0.0 END, 6) AS {0}word_precision, round(CASE WHEN rn > 0 THEN wm / rn WHEN hn = 0 THEN 1.0 ELSE 0.0 END, 6) AS {0}word_recall, round(CASE WHEN rn + hn > 0 THEN 2 * wm / (rn + hn) ELSE 1.0 END, 6) AS {0}word_f1"


@query(SQL_PAIRS + f"SELECT model, file, wm AS word_matches, {SHARES.format('')} FROM d")
def bag_overlap(spark, sf_dir):
    x = pairs(spark, sf_dir).withColumn("word_matches", evaluate.bag_matches("ref", "hyp"))
    r, h = (F.size(T.words(F.col(c))) for c in ("ref", "hyp"))
    named = [c.alias(n) for c, n in zip(evaluate.shares(F.col("word_matches"), r, h), ("word_precision", "word_recall", "word_f1"), strict=True)]
    return rounded(x.select("model", "file", "word_matches", *named))


#: The longest common subsequence of two strings a and b in DuckDB: a row of the table for each letter of a; each place of the row is the larger of the one above, the one before, and (for equal letters) one more than that above and before.
LCS = "list_reduce(list_concat([list_transform(range(0, length(b) + 1), lambda i: 0)], list_transform(string_split(a, ''), lambda c: list_transform(list_concat([''], string_split(b, '')), lambda d: CASE WHEN c = d THEN 1 ELSE 0 END))), lambda above, hits: list_reduce(list_concat([[0]], list_transform(range(2, len(above) + 1), lambda j: [greatest(above[j], above[j - 1] + hits[j])])), lambda row, x: list_append(row, greatest(row[-1], x[1]))))[-1]"


@query(f"WITH n AS ({forms.NAMES}), d AS (SELECT DISTINCT a, b FROM n), s AS (SELECT a, b, CASE WHEN b = '' THEN 0.0 ELSE 200.0 * {LCS} / (length(a) + length(b)) END AS ratio FROM d) SELECT name, reading, round(ratio, 6) AS ratio FROM n JOIN s USING (a, b)")
def indel_ratio(spark, sf_dir):
    return rounded(view(spark, sf_dir, forms.NAMES, "part").select("name", "reading", parse.ratio_udf("a", "b").alias("ratio")))


#: How the models' texts differ says which edits there are: a missing or empty text deletes everything, the others only replace, only delete or only insert.
_SPLIT = ", ".join(f"(CASE WHEN status <> 'ok' OR model = 'm_drop' THEN {c} ELSE 0 END)::BIGINT AS {k}_deletions, (CASE WHEN status = 'ok' AND model = 'm_ocr' THEN {c} ELSE 0 END)::BIGINT AS {k}_substitutions, (CASE WHEN status = 'ok' AND model = 'm_more' THEN {c} ELSE 0 END)::BIGINT AS {k}_insertions" for k, c in (("character", "ce"), ("word", "we")))


@query(SQL_PAIRS + f"SELECT 'experiment_001' AS experiment, model, file, status, rc AS reference_characters, hc AS hypothesis_characters, ce AS character_errors, round(CASE WHEN rc > 0 THEN ce / rc WHEN hc = 0 THEN 0.0 END, 6) AS cer, rn AS reference_words, hn AS hypothesis_words, we AS word_errors, round(CASE WHEN rn > 0 THEN we / rn WHEN hn = 0 THEN 0.0 END, 6) AS wer, wm AS word_matches, {_SPLIT}, {SHARES.format('')}, ref = hyp AS exact_match FROM d")
def per_file_metrics(spark, sf_dir):
    return rounded(measured(spark, sf_dir))


TOTALS = "t AS (SELECT model, count(*)::BIGINT AS reference_files, count_if(status <> 'missing_hypothesis')::BIGINT AS found_hypotheses, count_if(status = 'missing_hypothesis')::BIGINT AS missing_hypotheses, count_if(status = 'empty_hypothesis')::BIGINT AS empty_hypotheses, count_if(ref = hyp)::BIGINT AS exact_matches, sum(rc)::BIGINT AS rc, sum(ce)::BIGINT AS ce, sum(rn)::BIGINT AS rn, sum(hn)::BIGINT AS hn, sum(we)::BIGINT AS we, sum(wm)::BIGINT AS wm FROM d GROUP BY model)"


@query(SQL_PAIRS.rstrip() + f", {TOTALS} SELECT 'experiment_001' AS experiment, model, reference_files, found_hypotheses, missing_hypotheses, empty_hypotheses, exact_matches, round(exact_matches / reference_files, 6) AS exact_match_rate, ce AS character_errors, we AS word_errors, wm AS total_word_matches, round(ce / rc, 6) AS micro_cer, round(we / rn, 6) AS micro_wer, {SHARES.format('micro_')} FROM t")
def model_summary(spark, sf_dir):
    names = "experiment model reference_files found_hypotheses missing_hypotheses empty_hypotheses exact_matches exact_match_rate character_errors word_errors total_word_matches micro_cer micro_wer micro_word_precision micro_word_recall micro_word_f1".split()
    return rounded(evaluate.summarize(measured(spark, sf_dir)).select(*names))


_STATS = ", ".join(f"round({f}({c}), 6) AS macro_{c}_{a}" for c in ("cer", "wer") for f, a in (("avg", "mean"), ("median", "median"), ("stddev_pop", "population_stddev"), ("min", "min"), ("max", "max")))


@query(SQL_PAIRS.rstrip() + f", r AS (SELECT model, CASE WHEN rc > 0 THEN ce / rc WHEN hc = 0 THEN 0.0 END AS cer, CASE WHEN rn > 0 THEN we / rn WHEN hn = 0 THEN 0.0 END AS wer FROM d) SELECT model, {_STATS} FROM r GROUP BY model")
def macro_stats(spark, sf_dir):
    out = evaluate.summarize(measured(spark, sf_dir))
    return rounded(out.select("model", *(c for c in out.columns if c.startswith("macro_"))))


@query(PAIRS + "k AS (SELECT * FROM p) SELECT status, count(*)::BIGINT AS n FROM k GROUP BY status")
def status_counts(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT 'missing' AS kind, concat('c', c_custkey) AS file FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT 'extra', concat('c', o_custkey) FROM orders WHERE o_custkey % 5 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
def missing_extra_files(spark, sf_dir):
    """Customers without orders; customers of orders that a list without every fifth customer lacks."""
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("file")
    references = table(spark, sf_dir, "customer").select(name("c_custkey"))
    hypotheses = table(spark, sf_dir, "orders").select(name("o_custkey"), F.lit("e").alias("experiment"), F.lit("m").alias("model")).distinct()
    models = spark.createDataFrame([("e", "m")], "experiment string, model string")
    lacking = references.where("cast(substring(file, 2) as long) % 5 <> 0")
    return evaluate.missing(references, models, hypotheses).select(F.lit("missing").alias("kind"), "file").unionAll(evaluate.extra(lacking, hypotheses).select(F.lit("extra").alias("kind"), "file"))


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def inner_matched_docs(spark, sf_dir):
    return evaluate.matched(table(spark, sf_dir, "labels").select("doc_id", "quality"), table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


# forms: a filled form for each customer

_NESTED = ", ".join(f"'{t}'" for t in forms.NESTED)
CLOSED = f"""WITH f AS ({forms.FORMS}), x AS (
  SELECT document, kind, term, place, 1 AS field_order, 'k1' AS key_id, 'name' AS field_id, 'string' AS category, name AS v, 'Name of owner' AS key_expected FROM f
  UNION ALL SELECT document, kind, term, place, 2, 'k2', 'made', 'numeric', made, 'Made on' FROM f
  UNION ALL SELECT document, kind, term, place, 3, 'k3', 'place', 'string', place, 'in' FROM f
  UNION ALL SELECT document, kind, term, place, 4, 'k4', 'craft', 'dictionary', term, 'Kind of craft' FROM f
  UNION ALL SELECT document, kind, term, place, 5, 'k5', 'seal', 'string', seal, 'Sealed by' FROM f
  UNION ALL SELECT document, kind, term, place, 6, 'k6', 'number', 'numeric', number, 'Entry number' FROM f),
y AS (SELECT *, CASE WHEN kind = 2 AND field_order = 4 THEN 'missing' WHEN kind = 1 AND field_order = 2 THEN 'recovered' WHEN field_order IN (3, 5) THEN 'local' ELSE 'found' END AS key_status,
  CASE WHEN kind = 2 AND field_order = 3 THEN 'next_key_missing' WHEN kind = 2 AND field_order = 4 THEN 'key_missing' ELSE 'ok' END AS boundary_status,
  CASE WHEN kind = 2 AND field_order = 3 THEN concat(place, ' ', term) WHEN kind = 2 AND field_order = 4 THEN '' WHEN kind = 3 AND field_order = 4 THEN replace(term, 'i', 'j') WHEN kind = 4 AND field_order = 6 THEN concat('9', v) ELSE v END AS pre,
  kind = 2 AND field_order = 4 AND term NOT IN ({_NESTED}) AS recovered_here, lower(key_expected) AS gt_key,
  CASE WHEN kind = 2 AND field_order = 4 THEN '' WHEN kind = 1 AND field_order = 2 THEN 'mafe on' WHEN kind = 5 AND field_order = 5 THEN 'sealid by' ELSE lower(key_expected) END AS ocr_key FROM x),
z AS (SELECT *, CASE WHEN kind = 3 AND field_order = 4 OR recovered_here THEN term ELSE pre END AS post, boundary_status = 'ok' AS epre, boundary_status = 'ok' OR recovered_here AS epost,
  CASE WHEN kind = 3 AND field_order = 4 THEN length(term) - length(replace(term, 'i', '')) WHEN kind = 4 AND field_order = 6 THEN 1 ELSE 0 END AS errors,
  CASE WHEN kind = 3 AND field_order = 4 THEN len(list_filter(string_split(term, ' '), lambda w: contains(w, 'i'))) WHEN kind = 4 AND field_order = 6 THEN 1 ELSE 0 END AS word_errors,
  key_status <> 'missing' AND ocr_key <> gt_key AS key_fixed, CASE WHEN key_status = 'missing' THEN length(gt_key) WHEN ocr_key <> gt_key THEN 1 ELSE 0 END AS key_errors,
  CASE WHEN key_status = 'missing' THEN len(string_split(gt_key, ' ')) WHEN ocr_key <> gt_key THEN 1 ELSE 0 END AS key_word_errors FROM y)
"""


def form_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small tables are one file, one task: forms are dealt to all before they are parsed."""
    return view(spark, sf_dir, forms.FORMS, "customer", "nation").repartition(spark.sparkContext.defaultParallelism, "document")


def parsed_forms(spark: SparkSession, sf_dir: str, text: str = "ocr_text") -> DataFrame:
    """Exploded where they are made: of a column that is exploded later Spark infers that it isn't empty, and parses all a second time for that, before the forms are dealt, in the one task that reads them."""
    return form_texts(spark, sf_dir).select("document", F.explode(parse.parsed(F.col(text), forms.FORM)).alias("f")).select("document", "f.*")


TERMS = {"crafts": list(forms.CRAFTS)}


def evaluated(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    pairs = form_texts(spark, sf_dir).select("document", F.lit("form").alias("template"), "gt_text", "ocr_text")
    return fields.evaluate(pairs, {"form": forms.FORM}, TERMS, **options)


def windows(spark: SparkSession, sf_dir: str, column) -> DataFrame:
    return form_texts(spark, sf_dir).select("document", F.explode(column).alias("w")).select("document", "w.*")


@query(CLOSED + "SELECT document, key_id, field_order, CASE ocr_key WHEN 'mafe on' THEN 85.71 ELSE 100.0 END AS score, ocr_key AS text FROM z WHERE key_id IN ('k1', 'k2', 'k4', 'k6') AND key_status <> 'missing'")
def key_candidates(spark, sf_dir):
    """All windows that global keys may be at 80 points, weaker ones with the start or end of a stronger one left out."""
    return windows(spark, sf_dir, parse.candidates(F.col("ocr_text"), forms.FORM, 80.0)).select("document", "key_id", "field_order", "score", "text")


@query(CLOSED + "SELECT document, key_id, field_order, 100.0 AS score, ocr_key AS text FROM z WHERE key_id IN ('k1', 'k2', 'k4', 'k6') AND key_status = 'found'")
def ordered_keys(spark, sf_dir):
    return windows(spark, sf_dir, parse.ordered(F.col("ocr_text"), forms.FORM)).select("document", "key_id", "field_order", "score", "text")


@query(CLOSED + "SELECT document, key_id, ocr_key AS key_found, CASE ocr_key WHEN 'sealid by' THEN 88.89 ELSE 100.0 END AS key_score FROM z WHERE key_status = 'local'")
def local_keys(spark, sf_dir):
    return parsed_forms(spark, sf_dir).where("key_status = 'local'").select("document", "key_id", "key_found", "key_score")


@query(CLOSED + "SELECT document, field_order, key_id, key_status, boundary_status, pre AS value, CASE WHEN field_order = 4 AND kind = 2 THEN '' WHEN kind = 1 AND field_order = 2 THEN 'Mafe on' WHEN kind = 5 AND field_order = 5 THEN 'Sealid by' ELSE key_expected END AS key_raw FROM z")
def parsed_fields(spark, sf_dir):
    return parsed_forms(spark, sf_dir).select("document", "field_order", "key_id", "key_status", "boundary_status", "value", "key_raw")


@query(f"WITH f AS ({forms.FORMS}) SELECT document, concat(': ', replace(name, 'customer ', 'Customer#'), '.') AS raw_name, concat(number, '.') AS raw_number FROM f WHERE kind NOT IN (1, 4)")
def raw_values(spark, sf_dir):
    """Values as they stand in the text, from the end of their key to the beginning of the next."""
    x = parsed_forms(spark, sf_dir).groupBy("document").agg(*(F.max(F.when(F.col("field_id") == n, F.col("raw_value"))).alias(f"raw_{n}") for n in ("name", "number")))
    return x.where("cast(substring(document, 2) as long) % 10 not in (1, 4)")


@query(CLOSED + "SELECT document, key_status, count(*)::BIGINT AS n FROM z GROUP BY ALL")
def key_status_counts(spark, sf_dir):
    x = form_texts(spark, sf_dir).select("document", parse.parsed(F.col("ocr_text"), forms.FORM).alias("rows"))
    x = x.select("document", F.explode(parse.key_status_counts(F.col("rows"))).alias("key_status", "n"))
    return x.select("document", "key_status", F.col("n").cast("long").alias("n"))


@query(CLOSED + "SELECT document, 85.71 AS key_score, 'mafe on' AS key_found FROM z WHERE key_status = 'recovered'")
def recovered_keys(spark, sf_dir):
    return parsed_forms(spark, sf_dir).where("key_status = 'recovered'").select("document", "key_score", "key_found")


@query(CLOSED + "SELECT document, concat(place, ' ', term) AS region, true AS region_has_left, true AS region_has_right FROM z WHERE key_status = 'missing'")
def search_region(spark, sf_dir):
    return parsed_forms(spark, sf_dir).where("key_status = 'missing'").select("document", "region", "region_has_left", "region_has_right")


@query(CLOSED + "SELECT document, field_order, CASE WHEN field_order = 6 THEN NULL WHEN kind = 2 AND field_order = 3 THEN 5 ELSE field_order + 1 END AS next_found, CASE WHEN field_order = 1 THEN NULL WHEN kind = 2 AND field_order = 5 THEN 3 ELSE field_order - 1 END AS last_found FROM z")
def neighbor_windows(spark, sf_dir):
    """The nearest found keys after and before each field, by windows over the parsed rows."""
    found = F.when(F.col("key_status") != "missing", F.col("field_order"))
    w = Window.partitionBy("document").orderBy("field_order")
    after = F.first(found, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = F.last(found, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return parsed_forms(spark, sf_dir).select("document", "field_order", after.alias("next_found"), before.alias("last_found"))


@query(CLOSED + "SELECT document, pre AS value, term AS candidate FROM z WHERE kind = 3 AND field_order = 4")
def dictionary_correction(spark, sf_dir):
    return evaluated(spark, sf_dir).where("correction_applied and not local_recovery_applied").select("document", F.col("ocr_value_pre").alias("value"), F.col("correction_candidate").alias("candidate"))


@query(CLOSED + "SELECT document, term AS candidate, term AS observed, 100.0 AS score, concat(place, ' ', term) AS region FROM z WHERE recovered_here")
def local_recovery(spark, sf_dir):
    x = evaluated(spark, sf_dir).where("local_recovery_applied")
    return x.select("document", F.col("local_recovery_candidate").alias("candidate"), F.col("local_recovery_match").alias("observed"), F.col("local_recovery_score").alias("score"), F.col("local_recovery_region").alias("region"))


_DICTIONARY = " UNION ALL ".join(f"SELECT '{t}' AS term" for t in forms.CRAFTS)


@query(CLOSED + f", d AS ({_DICTIONARY}), texts AS (SELECT DISTINCT pre AS a FROM z WHERE field_order = 4 AND pre <> ''), pairs AS (SELECT a, term AS b FROM texts CROSS JOIN d), scored AS (SELECT a, b, 200.0 * {LCS} / (length(a) + length(b)) AS score FROM pairs), ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b DESC) AS place FROM scored), best AS (SELECT a, max(CASE WHEN place = 1 THEN b END) AS candidate, max(CASE WHEN place = 1 THEN score END) AS first, max(CASE WHEN place = 2 THEN score END) AS second FROM ranked WHERE place <= 2 GROUP BY a) SELECT document, candidate, round(first, 2) AS score, round(second, 2) AS second_score, round(first - second, 2) AS margin FROM z JOIN best ON pre = a WHERE field_order = 4")
def dictionary_top2(spark, sf_dir):
    """Best and second term for each form's value."""
    x = evaluated(spark, sf_dir).where("category = 'dictionary' and ocr_value_pre <> ''")
    return x.select("document", *(F.col(f"correction_{c}").alias(c) for c in ("candidate", "score", "second_score", "margin")))


@query(CLOSED + "SELECT document, key_id, ocr_key AS ocr_key_pre, gt_key AS ocr_key_post, 'template_expected' AS key_correction_source FROM z WHERE key_fixed")
def key_canonicalization(spark, sf_dir):
    return evaluated(spark, sf_dir).where("key_correction_applied").select("document", "key_id", "ocr_key_pre", "ocr_key_post", "key_correction_source")


@query(
    CLOSED
    + "SELECT document, field_id, boundary_status, epre AS value_evaluable_pre, epost AS value_evaluable_post, CASE WHEN epre THEN 'normal' ELSE 'unavailable' END AS value_source_pre, CASE WHEN recovered_here THEN 'dictionary_local_recovery' WHEN epre THEN 'normal' ELSE 'unavailable' END AS value_source_post, CASE WHEN epre THEN '' ELSE boundary_status END AS skip_reason_pre, CASE WHEN epost THEN '' ELSE boundary_status END AS skip_reason_post, "
    "recovered_here AS local_recovery_applied, kind = 3 AND field_order = 4 AS correction_applied, CASE WHEN epre THEN v = pre END AS value_correct_pre, CASE WHEN epost THEN v = post END AS value_correct_post FROM z"
)
def value_states(spark, sf_dir):
    names = "document field_id boundary_status value_evaluable_pre value_evaluable_post value_source_pre value_source_post skip_reason_pre skip_reason_post local_recovery_applied correction_applied value_correct_pre value_correct_post".split()
    return evaluated(spark, sf_dir).select(*names)


def _rates(name: str, errors: str, size: str, condition: str = "true") -> str:
    return f"CASE WHEN {condition} THEN round({errors} / {size}, 6) END AS {name}"


_WORDS = "len(string_split({}, ' '))"
_POST = "CASE WHEN post = v THEN 0 ELSE {} END"
ALL_FIELDS = ", ".join(
    [
        "document, 'form' AS template, field_order, field_id, category, key_id, key_expected, gt_key, ocr_key, CASE WHEN key_fixed THEN ocr_key ELSE '' END AS ocr_key_pre, CASE WHEN key_fixed THEN gt_key ELSE '' END AS ocr_key_post, key_status, key_status <> 'missing' AS key_detected",
        "ocr_key = gt_key AS key_correct, ocr_key = gt_key AS key_correct_pre, key_status <> 'missing' AS key_correct_post, key_fixed AS key_correction_applied, CASE WHEN key_fixed THEN 'template_expected' ELSE '' END AS key_correction_source",
        *(_rates(f"key_cer{s}", "key_errors", "length(gt_key)") for s in ("", "_pre")),
        *(_rates(f"key_wer{s}", "key_word_errors", _WORDS.format("gt_key")) for s in ("", "_pre")),
        "CASE WHEN key_status = 'missing' THEN 1.0 ELSE 0.0 END AS key_cer_post, CASE WHEN key_status = 'missing' THEN 1.0 ELSE 0.0 END AS key_wer_post",
        "v AS gt_value, pre AS ocr_value_pre, post AS ocr_value_post, boundary_status, epre AS value_evaluable_pre, epost AS value_evaluable_post, CASE WHEN epre THEN v = pre END AS value_correct_pre, CASE WHEN epost THEN v = post END AS value_correct_post",
        "CASE WHEN epre THEN v = pre AND ocr_key = gt_key END AS field_correct_pre, CASE WHEN epost THEN v = post AND key_status <> 'missing' END AS field_correct_post, CASE WHEN category = 'dictionary' THEN 'crafts' ELSE '' END AS dictionary",
        _rates("value_cer_pre", "errors", "length(v)", "epre"),
        _rates("value_wer_pre", "word_errors", _WORDS.format("v"), "epre"),
        _rates("value_cer_post", _POST.format("errors"), "length(v)", "epost"),
        _rates("value_wer_post", _POST.format("word_errors"), _WORDS.format("v"), "epost"),
    ]
)
SHOWN = "document template field_order field_id category key_id key_expected gt_key ocr_key ocr_key_pre ocr_key_post key_status key_detected key_correct key_correct_pre key_correct_post key_correction_applied key_correction_source key_cer key_wer key_cer_pre key_wer_pre key_cer_post key_wer_post gt_value ocr_value_pre ocr_value_post boundary_status value_evaluable_pre value_evaluable_post value_correct_pre value_correct_post field_correct_pre field_correct_post dictionary value_cer_pre value_wer_pre value_cer_post value_wer_post".split()


@query(CLOSED + f"SELECT {ALL_FIELDS} FROM z")
def all_fields(spark, sf_dir):
    return rounded(evaluated(spark, sf_dir).withColumnRenamed("order", "field_order").select(*SHOWN))


def _severity(stage: str) -> str:
    e, v = f"e{stage}", stage
    wrong = f"{e} AND v <> {v}"
    part = lambda n, size: f"round(sum(CASE WHEN {wrong} THEN {n} END) / sum(CASE WHEN {wrong} THEN {size} END), 6)"
    return f"count_if({wrong})::BIGINT AS value_non_exact_{stage}, {part('errors', 'length(v)')} AS value_cer_non_exact_{stage}, CASE WHEN min(category) = 'string' THEN {part('word_errors', _WORDS.format('v'))} END AS value_wer_non_exact_{stage}"


def _counts(keys: str, values: str, fields_: str, total: str) -> str:
    """Columns that the summaries of fields and of documents share."""
    out = [
        f"count(*)::BIGINT AS {total}, count_if(key_status <> 'missing')::BIGINT AS {keys}_detected, count_if(key_status = 'missing')::BIGINT AS {keys}_missing, count_if(ocr_key = gt_key)::BIGINT AS {keys}_exact, count_if(key_fixed)::BIGINT AS key_corrections_applied",
        "round(count_if(key_status <> 'missing') / count(*), 6) AS key_detection_rate, round(count_if(ocr_key = gt_key) / count(*), 6) AS key_exact_rate, count_if(kind = 3 AND field_order = 4)::BIGINT AS value_corrections_applied, count_if(key_fixed OR kind = 3 AND field_order = 4)::BIGINT AS total_corrections_applied",
    ]
    for s, right in (("pre", "v = pre AND ocr_key = gt_key"), ("post", "v = post AND key_status <> 'missing'")):
        out.append(f"count_if(e{s})::BIGINT AS {values}_evaluable_{s}, count_if(NOT e{s})::BIGINT AS {values}_skipped_{s}, round(count_if(e{s}) / count(*), 6) AS value_coverage_{s}, count_if(e{s} AND v = {s})::BIGINT AS {values}_exact_{s}, round(count_if(e{s} AND v = {s}) / nullif(count_if(e{s}), 0), 6) AS value_exact_rate_{s}")
        out.append(f"count_if(e{s} AND {right})::BIGINT AS {fields_}_correct_{s}, round(count_if(e{s} AND {right}) / nullif(count_if(e{s}), 0), 6) AS field_accuracy_conditional_{s}, round(count_if(e{s} AND {right}) / count(*), 6) AS field_success_rate_{s}")
    return ", ".join(out)


_KEY_SEVERITY = "round(sum(CASE WHEN key_fixed THEN key_errors END) / sum(CASE WHEN key_fixed THEN length(gt_key) END), 6)"


@query(CLOSED + f"SELECT field_id, min(category) AS category, min(key_expected) AS key_expected, 'form' AS templates, {_counts('key', 'value', 'field', 'occurrences')}, count_if(key_fixed)::BIGINT AS key_non_exact_detected, {_KEY_SEVERITY} AS key_cer_non_exact, {_severity('pre')}, {_severity('post')} FROM z GROUP BY field_id")
def field_summary(spark, sf_dir):
    return rounded(fields.field_summary(evaluated(spark, sf_dir)))


@query(CLOSED + f"SELECT document, 'form' AS template, {_counts('keys', 'values', 'fields', 'fields_total')} FROM z GROUP BY document")
def document_summary(spark, sf_dir):
    return rounded(fields.document_summary(evaluated(spark, sf_dir)))


def _category(name: str, stage: str) -> str:
    e, v = f"e{stage}", stage
    wer = f"round(sum(CASE WHEN {e} AND v <> {v} THEN word_errors END) / sum(CASE WHEN {e} AND v <> {v} THEN {_WORDS.format('v')} END), 6)" if name == "string" else "NULL"
    return f"SELECT '{name}' AS category, '{stage}' AS stage, count(*)::BIGINT AS items_total, NULL AS items_detected, NULL AS items_missing, NULL AS items_recovered, NULL AS items_local, NULL AS items_found, NULL AS detection_rate, count_if({e})::BIGINT AS items_evaluated, count_if(NOT {e})::BIGINT AS items_skipped, round(count_if({e}) / count(*), 6) AS coverage, count_if({e} AND v = {v})::BIGINT AS items_exact, round(count_if({e} AND v = {v}) / count_if({e}), 6) AS exact_rate, count_if({e} AND v <> {v})::BIGINT AS items_non_exact, round(sum(CASE WHEN {e} AND v <> {v} THEN errors END) / sum(CASE WHEN {e} AND v <> {v} THEN length(v) END), 6) AS cer_non_exact, {wer} AS wer_non_exact FROM z WHERE category = '{name}'"


@query(
    CLOSED
    + "SELECT 'key' AS category, 'pre' AS stage, count(*)::BIGINT AS items_total, count_if(key_status <> 'missing')::BIGINT AS items_detected, count_if(key_status = 'missing')::BIGINT AS items_missing, count_if(key_status = 'recovered')::BIGINT AS items_recovered, count_if(key_status = 'local')::BIGINT AS items_local, count_if(key_status = 'found')::BIGINT AS items_found, round(count_if(key_status <> 'missing') / count(*), 6) AS detection_rate, NULL AS items_evaluated, NULL AS items_skipped, NULL AS coverage, count_if(ocr_key = gt_key)::BIGINT AS items_exact, round(count_if(ocr_key = gt_key) / count(*), 6) AS exact_rate, "
    f"count_if(key_fixed)::BIGINT AS items_non_exact, {_KEY_SEVERITY} AS cer_non_exact, NULL AS wer_non_exact FROM z UNION ALL " + " UNION ALL ".join(_category(n, s) for n, s in fields.REPORTED)
)
def category_summary(spark, sf_dir):
    return rounded(fields.category_summary(evaluated(spark, sf_dir)))


@query(CLOSED + "SELECT count(DISTINCT document)::BIGINT AS documents, count(*)::BIGINT AS fields, count_if(key_status <> 'missing')::BIGINT AS keys_detected, count_if(ocr_key = gt_key)::BIGINT AS keys_exact_pre, count_if(key_status <> 'missing')::BIGINT AS keys_exact_post, count_if(key_fixed)::BIGINT AS keys_corrected, count_if(NOT epre)::BIGINT AS values_skipped_pre, count_if(NOT epost)::BIGINT AS values_skipped_post, round(100 * count_if(key_status <> 'missing') / count(*), 2) AS keys_detected_percent, round(100 * count_if(ocr_key = gt_key) / count(*), 2) AS keys_exact_pre_percent, round(100 * count_if(key_status <> 'missing') / count(*), 2) AS keys_exact_post_percent FROM z")
def run_console(spark, sf_dir):
    return fields.console(evaluated(spark, sf_dir))


@query(CLOSED + "SELECT document, key_id FROM z WHERE key_status = 'missing'")
def gt_guard_violations(spark, sf_dir):
    """With the readings in the truth's place: the forms that lack a key."""
    pairs = form_texts(spark, sf_dir).select("document", F.lit("form").alias("template"), F.col("ocr_text").alias("gt_text"), F.col("gt_text").alias("ocr_text"))
    return fields.guard(fields.evaluate(pairs, {"form": forms.FORM}, TERMS, strict=False))


@query("SELECT 'form' AS template, 6::BIGINT AS fields, 3::BIGINT AS strings, 2::BIGINT AS numerics, 1::BIGINT AS dictionaries, 2::BIGINT AS local_keys, (SELECT 6 * count(*) FROM nation)::BIGINT AS instances UNION ALL SELECT 'short', 2, 1, 1, 0, 0, (SELECT 2 * count(*) FROM region)")
def template_stats(spark, sf_dir):
    """Two templates, written as YAML and loaded: fields by category, and fields of all documents that a template lists."""
    folder = shared.new_folder(spark, "templates")
    for i, (name, of, key, documents) in enumerate((("form", forms.FORM, "n_nationkey", "nation"), ("short", forms.FORM[:2], "r_regionkey", "region"))):
        listed = [f"{name}{r[0]}" for r in table(spark, sf_dir, documents).select(key).collect()]  # two fixed tables
        shared.write_text(spark, f"{folder}/template{i}.yaml", forms.as_yaml(name, listed, of))
    x = files.template_fields(spark, files.templates(spark, folder))
    kinds = (F.count_if(F.col("category") == c).alias(f"{n}") for c, n in (("string", "strings"), ("numeric", "numerics"), ("dictionary", "dictionaries")))
    return x.groupBy("template").agg(F.count("*").alias("fields"), *kinds, F.count_if(F.col("scope") == "local").alias("local_keys"), F.sum("documents").alias("instances"))


@query("SELECT concat('d', n_nationkey) AS document, CASE WHEN n_nationkey % 2 = 0 THEN 'template1' WHEN n_nationkey % 3 = 0 THEN 'template2' ELSE 'template3' END AS template FROM nation")
def template_assignment(spark, sf_dir):
    """Every nation's document, with templates that list the even ones, those divisible by three, and all."""
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # a fixed table
    found = [(f"template{i}", [f"d{k}" for k in keys if k % m == 0], []) for i, m in ((1, 2), (2, 3), (3, 1))]
    return files.assign(table(spark, sf_dir, "nation").select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("document")), found)


_TERMS = ", ".join(f"('crafts', '{t}')" for t in forms.CRAFTS)


@query(f"SELECT * FROM (VALUES {_TERMS}, ('places', 'saint x')) t(dictionary, term)")
def dictionary_terms(spark, sf_dir):
    """Dictionaries from YAML: terms normalised, empty ones and what is no list left out."""
    path = f"{shared.new_folder(spark, 'dictionaries')}/dictionaries.yaml"
    lines = ["dictionaries:", "  crafts:", *(f"    - {t.upper()}" for t in forms.CRAFTS), "  places: ['Saint-X.', '', '...']", "  note: no list"]
    shared.write_text(spark, path, "\n".join(lines) + "\n")
    return files.dictionaries(spark, path)


# runs: the events as a call log

LOG = f"WITH l AS ({forms.RUNS}) "


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, forms.RUNS, "events")


@query(LOG + "SELECT experiment_id, model, count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'skipped')::BIGINT AS skipped, count_if(status = 'error')::BIGINT AS errors FROM l GROUP BY ALL")
def run_totals(spark, sf_dir):
    return runs.totals(log(spark, sf_dir), ["experiment_id", "model"])


@query(LOG + "SELECT experiment_id, count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'skipped')::BIGINT AS skipped, count_if(status = 'error')::BIGINT AS errors, CASE WHEN count_if(status = 'error') = 0 THEN 'completed' ELSE 'completed_with_errors' END AS status FROM l GROUP BY experiment_id")
def run_manifest(spark, sf_dir):
    return runs.manifest(log(spark, sf_dir))


@query(LOG + "SELECT model, count(*)::BIGINT AS calls, round(avg(round(wall_seconds, 6)), 6) AS mean_seconds, round(max(wall_seconds), 6) AS max_seconds, sum(tokens)::BIGINT AS tokens, round(sum(tokens) / sum(round(wall_seconds, 6)), 6) AS tokens_per_second FROM l WHERE status = 'completed' GROUP BY model")
def duration_metrics(spark, sf_dir):
    """Durations as the server gives them, in nanoseconds, become seconds first."""
    ns = log(spark, sf_dir).withColumn("ns", F.round(F.col("wall_seconds") * 1e9).cast("long"))
    return rounded(runs.latency(ns.withColumn("wall_seconds", T.seconds(F.col("ns")))))


@query(LOG + "SELECT model, image FROM (SELECT DISTINCT image FROM l) CROSS JOIN (SELECT DISTINCT model FROM l) EXCEPT SELECT model, image FROM l WHERE status = 'completed'")
def resume_pending(spark, sf_dir):
    """Images of which some model has no text yet, over all models that were ever called."""
    x = log(spark, sf_dir)
    return runs.pending(x.select("image").distinct(), x.select("model").distinct(), x.where("status = 'completed'").select("model", "image")).select("model", "image")


@query(LOG + "SELECT row_number() OVER (ORDER BY CAST(regexp_extract(image, '\\d+') AS BIGINT))::INT AS place, image FROM l QUALIFY place <= 12")
def natural_order_topn(spark, sf_dir):
    x = log(spark, sf_dir).select("image", T.natural_key(F.col("image")).alias("k")).orderBy("k").limit(12)
    return x.select(F.row_number().over(Window.orderBy("k")).alias("place"), "image")  # twelve rows


@query(LOG + "SELECT DISTINCT model, replace(model, ':', '_') AS folder, concat('experiment_', lpad(experiment_id::VARCHAR, 3, '0')) AS experiment FROM l")
def model_folder_names(spark, sf_dir):
    return log(spark, sf_dir).select("model", T.folder_name(F.col("model")).alias("folder"), T.experiment_name(F.col("experiment_id")).alias("experiment")).distinct()


@query(LOG + "SELECT max(experiment_id) + 1 AS next_id FROM l")
def next_experiment_id(spark, sf_dir):
    return runs.next_experiment(log(spark, sf_dir).select(T.experiment_name(F.col("experiment_id")).alias("folder")).distinct())


@query("SELECT user_id, array_to_string(list_distinct_ordered, ',') AS models FROM (SELECT user_id, list(event_type ORDER BY first_ts, event_type) AS list_distinct_ordered FROM (SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY ALL) GROUP BY user_id)")
def ordered_distinct_models(spark, sf_dir):
    """Each user's kinds of events in order of appearance: merging the lists of two runs keeps the first places."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("t"))
    listed = first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_type"))), lambda s: s["event_type"]).alias("all"))
    return listed.select("user_id", F.array_join(runs.joined_models(F.slice("all", 1, 1), F.col("all")), ",").alias("models"))


# sources and sinks: written into a new folder, and read back


def _echo():
    """Stands in for a model: gives back the image's own bytes as its text; images of nothing fail."""

    def ask(model: str, prompt: str, image: bytes) -> dict:
        if not image:
            raise runs.CallError("nothing to see")
        return {"message": {"content": image.decode()}, "total_duration": 1_500_000_000, "load_duration": None, "eval_count": len(image), "done_reason": prompt}

    return ask


_WORK = "SELECT concat('model:', CAST(doc_id % 2 AS STRING)) AS model, concat('d', CAST(doc_id AS STRING), '.png') AS image, CASE WHEN doc_id % 13 = 1 THEN '' ELSE translate(text, chr(13), ' ') END AS text FROM documents"


def transcribed(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    work = view(spark, sf_dir, _WORK.replace("chr(13)", "'\\r'"), "documents").select("model", "image", runs.prompt(F.col("model"), {"model:1": "one"}, "all").alias("prompt"), F.encode("text", "UTF-8").alias("content"))
    return runs.transcribe(work, _echo, 7, folder)


@query(f"SELECT model, image, CASE WHEN text = '' THEN 'error' ELSE 'completed' END AS status, 7 AS experiment_id, CASE WHEN text <> '' THEN length(text) END::INT AS characters, CASE WHEN text <> '' THEN 1.5 END AS total_duration_seconds, CASE WHEN text <> '' THEN strlen(text) END::INT AS eval_count, CASE WHEN text <> '' THEN CASE model WHEN 'model:1' THEN 'one' ELSE 'all' END END AS done_reason, CASE WHEN text = '' THEN 'CallError: nothing to see' END AS error FROM ({_WORK})")
def call_log(spark, sf_dir):
    """A row for each call, errors included, appended to a log of JSON lines in two runs and read back."""
    path, out = f"{shared.new_folder(spark, 'log')}/log", transcribed(spark, sf_dir)
    for model in ("model:0", "model:1"):
        sinks.write_json(out.where(F.col("model") == model), path, append=True)
    names = "model image status experiment_id characters total_duration_seconds eval_count done_reason error".split()
    return spark.read.schema(runs.LOG).json(path).select(*names)


@query(f"SELECT 'experiment_007' AS experiment, replace(model, ':', '_') AS model, replace(image, '.png', '.txt') AS file, md5(text) AS text_md5 FROM ({_WORK}) WHERE text <> ''")
def transcription_files(spark, sf_dir):
    """The texts of a run as files, verbatim, found again by experiment and model."""
    root = shared.new_folder(spark, "outputs")
    transcribed(spark, sf_dir, f"{root}/experiment_007").write.format("noop").mode("overwrite").save()
    return files.hypotheses(spark, root).select("experiment", "model", "file", F.md5(F.col("hyp").cast("binary")).alias("text_md5"))


@query(SQL_PAIRS + "SELECT 'experiment_001' AS experiment, model, file, round(round(CASE WHEN rc > 0 THEN ce / rc WHEN hc = 0 THEN 0.0 END, 8), 6) AS cer, ce AS character_errors, ref = hyp AS exact_match FROM d")
def metrics_csv(spark, sf_dir):
    """Measures as CSV with a byte order mark and a folder for each model, read back."""
    path = f"{shared.new_folder(spark, 'csv')}/files"
    sinks.write_csv(measured(spark, sf_dir), path, ["experiment", "model", "file", "cer", "character_errors", "exact_match"], by=["model"], bom=True)
    back = spark.read.schema("experiment string, file string, cer double, character_errors long, exact_match boolean, model string").option("header", True).csv(path)
    return rounded(back)


@query(SQL_NORMAL + "SELECT 'e' AS experiment, lang AS model, doc_id, md5(t) AS text_md5 FROM n JOIN documents USING (doc_id)")
def normalized_tree(spark, sf_dir):
    """Normalised texts by experiment and model, read back."""
    path = f"{shared.new_folder(spark, 'normalized')}/texts"
    x = table(spark, sf_dir, "documents").select(F.lit("e").alias("experiment"), F.col("lang").alias("model"), "doc_id", T.normalized(F.expr(TAGGED)).alias("text"))
    sinks.write_texts(x, path)
    return spark.read.parquet(path).select("experiment", "model", "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT 'e' AS experiment, o_orderpriority AS model, count(DISTINCT o_custkey)::BIGINT AS normalized_files, (SELECT count(*) FROM customer WHERE c_custkey % 5 <> 0) - count(DISTINCT CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END)::BIGINT AS missing, count(DISTINCT CASE WHEN o_custkey % 5 = 0 THEN o_custkey END)::BIGINT AS extra FROM orders GROUP BY o_orderpriority")
def normalization_models(spark, sf_dir):
    """What the report of a normalisation says of each model: its files, the references it lacks, files without a reference."""
    references = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("file"))
    hypotheses = table(spark, sf_dir, "orders").select(F.lit("e").alias("experiment"), F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("file"))
    x = sinks.normalized_models(references, hypotheses)
    return x.select("experiment", "model", "normalized_files", *(F.size(c).cast("long").alias(n) for c, n in (("missing_ground_truth_files", "missing"), ("extra_output_files", "extra"))))


@query(SQL_PAIRS.rstrip() + f", {TOTALS}, s AS (SELECT status, count(*)::BIGINT AS n FROM d GROUP BY status) SELECT (SELECT count(*) FROM documents)::BIGINT AS reference_files, (SELECT count(*) FROM t)::BIGINT AS models, (SELECT n FROM s WHERE status = 'ok') AS ok, (SELECT n FROM s WHERE status = 'missing_hypothesis') AS missing_hypothesis, 1::BIGINT AS extra_files, 'normalized' AS evaluation_mode")
def metrics_report(spark, sf_dir):
    """The report of an evaluation, written as one JSON file and read back."""
    path, measures = f"{shared.new_folder(spark, 'report')}/metrics.json", measured(spark, sf_dir)
    extra = spark.createDataFrame([("experiment_001", "m_ocr", "extra.txt")], "experiment string, model string, file string")
    sinks.pretty(spark, sinks.metrics_report(measures, evaluate.summarize(measures), extra, inputs={"references": "documents"}, outputs={"per_file_metrics": "files"}), path)
    x = spark.read.option("multiLine", True).json(path)
    return x.select(F.col("inputs.reference_files").alias("reference_files"), F.size("model_summaries").cast("long").alias("models"), "status_counts.ok", "status_counts.missing_hypothesis", F.size(F.col("extra_output_files")[0]["files"]).cast("long").alias("extra_files"), "evaluation_mode")


@query(CLOSED + "SELECT document, 'form' AS template, field_order, key_id, key_status AS status, pre AS normalized, 88.0 AS global_threshold, CASE WHEN kind = 2 THEN 1 ELSE 0 END AS missing_keys FROM z")
def parsed_documents(spark, sf_dir):
    """Parsed documents in their nested shape as JSON, read back."""
    path = f"{shared.new_folder(spark, 'parsed')}/documents"
    x = form_texts(spark, sf_dir).select("document", F.lit("form").alias("template"), parse.parsed(F.col("ocr_text"), forms.FORM).alias("rows"))
    nested = parse.documents(x, "rows", "template", keep=["document"])
    sinks.write_json(nested, path)
    back = spark.read.schema(nested.schema).json(path)
    return back.select("document", "template", F.col("parameters.global_threshold").alias("global_threshold"), F.coalesce(F.col("key_status_counts")["missing"], F.lit(0)).alias("missing_keys"), F.explode("fields").alias("f")).select("document", "template", F.col("f.order").alias("field_order"), F.col("f.key.id").alias("key_id"), F.col("f.key.status").alias("status"), F.col("f.value.normalized").alias("normalized"), "global_threshold", "missing_keys")


@query("SELECT (SELECT count(*) FROM customer)::BIGINT AS documents, (SELECT 6 * count(*) FROM customer)::BIGINT AS fields, 6::BIGINT AS field_rows, (SELECT count(*) FROM customer)::BIGINT AS document_rows, 5::BIGINT AS category_rows, 70.0 AS dictionary_threshold, true AS canonical_keys")
def fields_report(spark, sf_dir):
    """The report of a field evaluation, written as one JSON file and read back by line: it has a row for each document."""
    folder = shared.new_folder(spark, "report")
    evaluated(spark, sf_dir).write.parquet(f"{folder}/fields")  # read by three summaries
    fields.report(spark.read.parquet(f"{folder}/fields"), f"{folder}/report.json", inputs={"ocr_dir": "ocr", "gt_dir": "gt"})
    shared.delete(spark, f"{folder}/fields")
    x, value = sinks.lines(spark, f"{folder}/report.json"), lambda name, path: F.max(F.when(F.col("name") == name, F.get_json_object("json", path)))
    rows = lambda key: F.count_if(F.col("name").isNull() & F.get_json_object("json", f"$.{key}").isNotNull())
    return x.agg(
        *(value(n, "$").cast("long").alias(n) for n in ("documents", "fields")), rows("field_id").alias("field_rows"), rows("document").alias("document_rows"), rows("stage").alias("category_rows"),
        value("parameters", "$.dictionary_threshold").cast("double").alias("dictionary_threshold"), value("key_postprocessing", "$.enabled").cast("boolean").alias("canonical_keys"),
    )


@query("SELECT row_number() OVER (ORDER BY n_nationkey)::INT AS place, concat('scan', n_nationkey, '.PNG') AS image, 1::BIGINT AS bytes, 'eA==' AS payload FROM nation QUALIFY place <= 12")
def image_files(spark, sf_dir):
    """Images of a folder in natural order of their names, the first twelve, with their payload."""
    folder = shared.new_folder(spark, "images")
    for r in table(spark, sf_dir, "nation").select("n_nationkey").collect():  # a fixed table
        shared.write_text(spark, f"{folder}/scan{r[0]}.PNG", "x")
        shared.write_text(spark, f"{folder}/note{r[0]}.txt", "x")
    found = files.images(spark, folder, 12).withColumn("place", F.row_number().over(Window.orderBy(T.natural_key(F.col("image")))))  # twelve rows
    payload = files.image_payload(spark, f"{folder}/*.PNG").withColumnRenamed("image", "stem")
    return found.join(payload, T.stem(F.col("path")) == F.col("stem")).select("place", "image", "bytes", "payload")


@query("SELECT 1 AS step, 1 AS experiment_id, 'running' AS status, 25::BIGINT AS images, 'a' AS models, '' AS refused UNION ALL SELECT 2, 1, 'completed', 25, 'a', '' UNION ALL SELECT 3, 1, 'running', 25, 'a,b', '' UNION ALL SELECT 4, 1, 'completed_with_errors', 25, 'a,b', 'images,parameters'")
def manifest_life(spark, sf_dir):
    """An experiment is begun, ends, is resumed with another model, refuses other images and parameters, and ends with errors."""
    folder = f"{shared.new_folder(spark, 'run')}/experiment_001"
    images = [f"scan{r[0]}.png" for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # a fixed table
    steps = [runs.open_experiment(spark, folder, 1, image_directory="scans", images=images, models=["a", "a"])]
    steps.append(runs.close_experiment(spark, folder, {"completed": 25, "skipped": 0, "errors": 0}))
    steps.append(runs.open_experiment(spark, folder, 1, image_directory="scans", images=images, models=["b", "a"], description="later"))
    refused = ""
    try:
        runs.open_experiment(spark, folder, 1, image_directory="scans", images=images[::-1], models=["a"], parameters=runs.DEFAULTS | {"seed": 1})
    except runs.Settings as e:
        refused = str(e).rpartition(": ")[2].replace(", ", ",")
    runs.close_experiment(spark, folder, {"completed": 24, "skipped": 0, "errors": 1})
    steps.append(runs.read_manifest(spark, folder))
    rows = [(i + 1, m["experiment_id"], m["status"], m["number_of_images"], ",".join(m["models"]), refused if i == 3 else "") for i, m in enumerate(steps)]
    return spark.createDataFrame(rows, "step int, experiment_id int, status string, images long, models string, refused string")


_MANIFESTS = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'scans' ELSE 'other' END AS directory, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 42 END AS seed, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'old' ELSE 'new' END AS words, c_custkey % 5 = 0 AS turned FROM customer"


@query(f"SELECT c_custkey, concat_ws(',', CASE WHEN directory <> 'scans' THEN 'image_directory' END, CASE WHEN turned THEN 'images' END, CASE WHEN seed <> 42 THEN 'parameters' END, CASE WHEN words = 'old' THEN 'description' END) AS differences FROM ({_MANIFESTS})")
def manifest_differences(spark, sf_dir):
    """What each of many asked runs would change of a saved one."""
    x = view(spark, sf_dir, _MANIFESTS, "customer")
    pages = F.array(F.lit("a"), F.lit("b"))
    named = lambda d, i, s, w: F.struct(d.alias("image_directory"), i.alias("images"), F.struct(s.alias("seed")).alias("parameters"), w.alias("description"))
    saved, asked = named(F.lit("scans"), pages, F.lit(42), F.lit("new")), named(F.col("directory"), F.when(F.col("turned"), F.reverse(pages)).otherwise(pages), F.col("seed"), F.col("words"))
    return x.select("c_custkey", saved.alias("saved"), asked.alias("asked")).select("c_custkey", F.array_join(runs.manifest_differences("saved", "asked"), ",").alias("differences"))


@query("SELECT concat('model:', n_name) AS model FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3)")
def unavailable_models(spark, sf_dir):
    """Requested models that a server doesn't have."""
    name = F.concat(F.lit("model:"), "n_name").alias("model")
    nations = table(spark, sf_dir, "nation")
    return runs.unavailable(nations.select(name), nations.where("n_regionkey < 3").select(name))


@query("SELECT concat('/data/scans/', c_custkey, '.png') AS path, concat(c_custkey, '.png') AS inside, concat('/data/scans/', c_custkey, '.png') AS outside, concat(c_custkey) AS stem FROM customer")
def relative_paths(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select(F.concat(F.lit("/data/scans/"), F.col("c_custkey").cast("string"), F.lit(".png")).alias("path"))
    return x.select("path", T.relative(F.col("path"), "/data/scans").alias("inside"), T.relative(F.col("path"), "/data/scan").alias("outside"), T.stem(F.col("path")).alias("stem"))
