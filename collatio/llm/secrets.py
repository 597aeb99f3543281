"""Secrets in texts, with DataFrame functions only: fixed patterns, and strings that look random to character Markov models.

What lies between the fixed patterns' finds is searched for runs of RUN or more of the characters of base64. A run is scored by the log-likelihood ratio of two first-order Markov chains over its characters: one of random strings, trained from what the fixed patterns find (half of its mass is uniform over the characters, for the kinds of random strings that the sample lacks), and one of ordinary identifiers, trained from the other words of fewer characters, both counted over a labelled sample of at most SAMPLE documents (those of least hash of doc_id). Separators (= _ -) don't count. A run with a mean ratio of MEAN nats a character or more becomes a span of kind markov; of another run, those parts between its separators that have RUN characters and reach that mean. Runs and parts without a digit need LETTERS nats. Only runs shorter than RUN characters are never scored.

Work is in proportion to a text's length, but for sums over its matches, which are added up in blocks of BLOCK.
Spans are code points, end exclusive. Nulls: a null text is empty and has no spans. Rows that repeat give equal rows; texts of any length are scanned whole; other columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The fixed patterns (Java's syntax), by kind, in the order of ties, with the code points that a match needs and, if not all of it, the part that counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
RUN, MEAN, LETTERS, SAMPLE, PRIOR = 16, 0.5, 1.0, 20_000, 4.0
BLOCK, FEW = 512, 500
#: Join names and values; they count neither for nor against a run.
SEPARATORS = frozenset(map(ord, "=_-"))
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{RUN},}}"
PIECE = f"[A-Za-z0-9+/]{{{RUN},}}"
#: What the search for random strings leaves out.
FIXED = f"{ASSIGN.replace('=-]+)', '=-]{12,})')}|(?-i:{ACCESS}|{HEX})"
#: What the chain of ordinary identifiers is trained from: runs too short to be candidates, so that secrets no pattern knows don't teach it.
WORD = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{4,{RUN - 1}}}(?![A-Za-z0-9+/_=-])"
SPAN = "struct<start:int,kind:int,end:int>"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def before_each(x: Column, zero, op) -> Column:
    """For each element of an array of numbers the op over those before it, in blocks: an array that grows by one is copied each time, so growth stays inside a block."""
    empty = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
    inner = lambda block: F.aggregate(block, empty, lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / BLOCK).cast("int")), lambda i: inner(F.slice(x, i * BLOCK + 1, F.lit(BLOCK))))
    step = lambda acc, b: F.struct(op(acc["at"], b["at"]).alias("at"), F.concat(acc["out"], F.transform(b["out"], lambda v: op(acc["at"], v))).alias("out"))
    return F.when(F.size(x) > BLOCK, F.aggregate(blocks, empty, step)["out"]).otherwise(inner(x)["out"])


def _add(a: Column, b: Column) -> Column:
    return a + b


MATCHES = "array<struct<start:int,kind:int,end:int,match:string>>"


def _spans(text: Column, pattern: str, kind: int, offset: Column | int = 0) -> Column:
    """All matches, leftmost non-overlapping, as structs (start, kind, end, match): what lies between them gives their places."""
    found, between = _matches(text, pattern), F.split(text, pattern, -1)
    gaps = F.transform(F.slice(between, F.lit(1), F.size(found)), lambda b: F.length(b))
    begins = F.zip_with(before_each(F.zip_with(gaps, found, lambda g, m: g + F.length(m)), 0, _add), gaps, lambda p, g: p + g + offset)
    spans = F.zip_with(begins, found, lambda p, m: F.struct(p.alias("start"), F.lit(kind).alias("kind"), (p + F.length(m)).alias("end"), m.alias("match")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(MATCHES))


def base_spans(text: Column) -> Column:
    """The fixed patterns' spans by start, then kind, as array<struct<start,kind,end,match>>."""
    assign = F.filter(_spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_replace(s["match"], VALUE, "")) >= 12)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def runs(text: Column) -> Column:
    """The runs of candidates between the finds of the fixed patterns."""
    parts, cuts = F.split(text, FIXED, -1), _matches(text, FIXED)
    sizes = F.zip_with(parts, cuts, lambda p, c: F.length(p) + F.coalesce(F.length(c), F.lit(0)))
    each = F.zip_with(parts, before_each(sizes, 0, _add), lambda p, at: _spans(p, CANDIDATE, 3, at))
    return F.when(~text.rlike(CANDIDATE), F.array().cast(MATCHES)).when(text.rlike(FIXED), F.flatten(each)).otherwise(_spans(text, CANDIDATE, 3))


def _chain(rows: DataFrame) -> Column:
    """Of rows (run, random) counts by pair of characters."""
    pairs = rows.where("length(run) > 1").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - 1), lambda i: F.ascii(F.substring("run", i, F.lit(1))) * 128 + F.ascii(F.substring("run", i + 1, F.lit(1))))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count_if(F.col("random")).alias("random"), F.count_if(~F.col("random")).alias("plain"))


def train(docs: DataFrame, *, sample: int = SAMPLE) -> list[float]:
    """The log ratio of each of 128 * 128 pairs of characters, at 128 * first + second. docs: doc_id, text."""
    few = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = docs.join(F.broadcast(few), "doc_id", "left_semi")  # sample rows at most
    random = some.select(F.explode(base_spans(F.col("text"))["match"]).alias("run")).select(F.explode(_matches(F.regexp_replace("run", VALUE, ""), "[A-Za-z0-9+/_=-]{12,}")).alias("run"), F.lit(True).alias("random"))
    words = some.select(F.explode(_matches(F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " "), WORD)).alias("run"), F.lit(False).alias("random"))
    counts = {r["pair"]: (r["random"], r["plain"]) for r in _chain(random.unionAll(words)).collect()}  # 128 * 128 rows at most
    letters = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    table, even = [0.0] * (128 * 128), 1 / len(letters)
    total = [sum(c[i] for c in counts.values()) for i in (0, 1)]
    share = {b: [(sum(counts.get(128 * a + b, (0, 0))[i] for a in letters) + even) / (total[i] + 1) for i in (0, 1)] for b in letters}
    for a in letters:
        sums = [sum(counts.get(128 * a + b, (0, 0))[i] for b in letters) for i in (0, 1)]
        for b in letters:
            # a character seen little before is followed by the characters of the whole sample
            x, y = ((counts.get(128 * a + b, (0, 0))[i] + PRIOR * share[b][i]) / (sums[i] + PRIOR) for i in (0, 1))
            if not {a, b} & SEPARATORS:
                table[128 * a + b] = round(math.log((0.5 * even + 0.5 * x) / y), 4)
    return table


def ratio(run: Column, table: Column) -> Column:
    """The sum of log ratios over a run's pairs of characters."""
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c))
    pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.element_at(table, a * 128 + F.coalesce(b, F.lit(0)) + 1))
    return F.aggregate(F.transform(F.array(codes), pairs)[0], F.lit(0.0), _add)


def annotate(df: DataFrame, text: str, table: list[float], base: str, spans: str) -> DataFrame:
    """df with two more columns: the spans of the fixed patterns, and all."""
    ratios, (fixed, found) = F.from_json(F.lit(json.dumps(table)), "array<double>"), C.own("fixed", "runs")

    def looks(s: Column) -> Column:
        need = F.when(s["match"].rlike("[0-9]"), MEAN).otherwise(LETTERS)
        return ratio(s["match"], ratios) >= need * F.greatest(F.length(F.translate(s["match"], "=_-", "")), F.lit(1))

    parts = lambda s: F.when(s["match"].rlike("[=_-]"), F.filter(_spans(s["match"], PIECE, 3, s["start"]), looks)).otherwise(F.array().cast(MATCHES))
    more = F.flatten(F.transform(found, lambda s: F.when(looks(s), F.array(s)).otherwise(parts(s))))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = df.withColumn(fixed, base_spans(F.col(text))).withColumn(found, runs(F.col(text)))
    return out.withColumn(base, plain(fixed)).withColumn(spans, plain(F.array_sort(F.concat(fixed, more)))).drop(fixed, found)


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, text, base (spans of the fixed patterns) and spans (all), each array<struct<start,kind,end>> in order of start, kind; kind is a place in KINDS."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return annotate(docs, "text", train(docs, sample=sample), "base", "spans")


def joined(spans: str) -> Column:
    """kind:start:end, by comma."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by the mark. A text with more than FEW spans is cut as an array of characters, whose slices need no search from its beginning."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        keep = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], keep).otherwise(acc["out"]).alias("out"))

    few = F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    def pieces(chars: Column) -> Column:
        ends = before_each(F.transform(spans, lambda s: s["end"]), 0, F.greatest)
        cut = F.zip_with(spans, ends, lambda s, at: F.when(s["start"] >= at, F.concat(F.slice(chars, at + 1, s["start"] - at), F.array(F.lit(mark)))).otherwise(F.array().cast("array<string>")))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.array_join(F.concat(F.flatten(cut), F.slice(chars, last + 1, F.greatest(F.size(chars) - last, F.lit(0)))), "")

    many = F.transform(F.array(F.split(text, "")), pieces)[0]
    return F.when(F.size(spans) > FEW, many).when(F.size(spans) > 0, few).otherwise(F.col(text))
