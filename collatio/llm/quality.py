"""Repetition rules from suffix arrays over a text's words.

The suffixes of all texts of a batch are sorted together by prefix doubling (Larsson, Sadakane, Faster Suffix Sorting, 2007: only groups that are still tied are sorted again); a text's number is part of a word, so suffixes of two texts never tie and never share a prefix. Longest common prefixes of neighbours come from the ranks of the doubling steps. A neighbour pair's common prefix is the string of the LCP interval that holds both suffixes; the deepest interval of a suffix has the larger of its two values, and that is the longest repeated substring that begins there. The union of these spans, where they have LEAST words or more, is what a text repeats.

A text fails if more than COVERED of its words lie in repeats, or if one repeat has more than LONGEST of its words (overlapping repeats as in "la la la" included).
Nulls: a null text has no words. Texts without words have zero counts and fail the base rule (under 50 words). Rows that repeat give equal rows; an empty table gives an empty result. Long texts are sorted whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

LEAST, COVERED, LONGEST = 8, 0.5, 0.3
#: Words sorted at once; a longer text is sorted alone.
WORDS_AT_ONCE = 200_000
_SPACE, _SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"


def repeat_lengths(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each position the words of the longest substring that begins there and begins elsewhere in the same text too. words: a number for each word; text: the number of its text, ascending."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.searchsorted(text, text, side="right")
    _, number = np.unique(words, return_inverse=True)
    first = np.unique(text.astype(np.int64) * (int(number.max()) + 1) + number, return_inverse=True)[1]
    sizes = np.bincount(first)
    rank = (np.cumsum(sizes) - sizes)[first]  # of a tied group: how many suffixes come before it
    levels, h = [rank], 1
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(tied):
            break
        after = tied + h
        inside = after < ends[tied]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[tied]))
        a, b = rank[tied][order], second[order]
        new_a = np.append(True, a[1:] != a[:-1])
        new_b = new_a | np.append(True, b[1:] != b[:-1])
        at = np.arange(len(order))
        rank = rank.copy()
        rank[tied[order]] = a + np.maximum.accumulate(np.where(new_b, at, 0)) - np.maximum.accumulate(np.where(new_a, at, 0))
        levels.append(rank)
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    x, y, common = suffixes[:-1], suffixes[1:], np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][x] == levels[0][y])
    for level in range(len(levels) - 1, -1, -1):
        p, q = x[live] + common[live], y[live] + common[live]
        fits = (p < ends[x[live]]) & (q < ends[y[live]])
        same = fits & (levels[level][np.minimum(p, n - 1)] == levels[level][np.minimum(q, n - 1)])
        common[live[same]] += 1 << level
    out = np.zeros(n, np.int64)
    out[x] = common
    out[y] = np.maximum(out[y], common)
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of spans."""
    d = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(d)[:n] > 0


def _measure(texts: list[bytes]) -> list[list]:
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split])
    total = int(sizes.sum())
    words = np.fromiter((h for ws in split for h in map(C.WORDS.__getitem__, ws)), np.uint64, total)
    text = np.repeat(np.arange(len(texts)), sizes)
    lengths = repeat_lengths(words, text)
    per = lambda x: np.bincount(text, x, minlength=len(texts)).astype(np.int64)
    three, many = np.flatnonzero(lengths >= 3), np.flatnonzero(lengths >= LEAST)
    twice = per(covered(three, np.full(len(three), 3), total))
    spans = per(covered(many, lengths[many], total))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, text, lengths)
    rows = []
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip(_SPACE)]
        rows.append([int(sizes[i]), len(t.translate(None, _SPACE).decode()), len(t) - len(t.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), int(twice[i]), int(spans[i]), int(longest[i])])
    return rows


def _run(batches):
    for batch in batches:
        texts, rows, at = batch.column(1).to_pylist(), [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= 6 * WORDS_AT_ONCE:
                size += len(texts[end])
                end += 1
            rows += _measure(texts[at:end])
            at = end
        yield pa.record_batch([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(7))], ["doc_id", *NAMES])


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def repetition(docs: DataFrame, *, key: str = "doc_id", text: str = "text", max_covered: float = COVERED, max_longest: float = LONGEST) -> DataFrame:
    """Per row of docs: doc_id, the first five counts of NAMES (long), base_failed, kept (boolean), the other counts."""
    C.prepare(docs.sparkSession)
    out = C.id_and_text(docs, key, text).mapInArrow(_run, "doc_id long, " + ", ".join(f"{x} long" for x in NAMES))
    base = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
    return out.selectExpr("doc_id", *NAMES[:5], f"({base}) as base_failed", f"not ({base}) and n_covered_words <= {max_covered} * n_words and longest_repeat <= {max_longest} * n_words as kept", *NAMES[5:])
