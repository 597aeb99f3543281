import random
import re

import numpy as np

from collatio.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(text):
    w = WORD.findall(text)
    n = len(w)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and w[i + k] == w[j + k]:
                    k += 1
                longest[i] = max(longest[i], k)
    mark = lambda least, size: len({p for i in range(n) if longest[i] >= least for p in range(i, i + (size or longest[i]))})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return [n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, mark(3, 3), mark(quality.LEAST, 0), max(longest, default=0)]


def texts():
    r = random.Random(3)
    yield from ("", " \n\t", "one", "la " * 90, "a b c a b c", "é\xa0ß x\n\n é\xa0ß x \né\xa0ß x", "<|> ## \x0b\x0c $%&", "x\ny\nx\n \n ")
    for _ in range(60):
        part = [" ".join(r.choice("abcdefg") for _ in range(r.randint(1, 14))) for _ in range(3)]
        yield r.choice([" ", "\n"]).join(r.choice(part) for _ in range(r.randint(1, 9)))


def test_counts_equal_brute_force():
    all_texts = list(texts())
    assert quality._measure([t.encode() for t in all_texts]) == [brute(t) for t in all_texts]


def test_no_words_at_all():
    assert quality._measure([b"", b"  "]) == [[0] * 7, [0] * 7]
    assert len(quality.repeat_lengths(np.zeros(0, np.uint64), np.zeros(0, np.int64))) == 0


def test_frames(spark):
    clean = " ".join(f"word{i}" for i in range(120))
    rows = [(1, clean, 5), (1, clean, 5), (2, None, 1), (3, clean + " " + clean, 0), (4, "short text", 0), (5, (clean + "\n") * 300, 2)]
    out = {(r.doc_id, r.base_failed, r.kept, r.n_words) for r in quality.repetition(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()}
    assert out == {(1, False, True, 120), (2, True, False, 0), (3, True, False, 240), (4, True, False, 2), (5, True, False, 36_000)}
    none = quality.repetition(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0 and none.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words", "longest_repeat"]
