import math
import random
from collections import Counter

import numpy as np

from collatio.llm import decontam


def corpus():
    r = random.Random(7)
    vocabulary = [f"{a}{b}{c}" for a in "btkm" for b in "aeio" for c in "lnrs"] + ["the", "of", "and"] * 20
    say = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", str(r.randint(0, 99))]) for _ in range(n))
    items = [(i, say(r.randint(8, 60))) for i in range(60)]
    docs = []
    for i in range(120):
        text = say(r.randint(5, 400))
        if i % 4 == 0:
            words = text.split()
            k = r.randrange(len(words))
            text = " ".join([*words[:k], items[i % 60][1].upper() if i % 8 else items[i % 60][1], *words[k:]])
        docs.append((i, text))
    return items, docs


def test_retrieval_equals_brute_force():
    items, docs = corpus()
    index = decontam.Index([(i, t.encode()) for i, t in items])
    split = {i: t.lower().split() for i, t in items}
    df = Counter(w for x in split.values() for w in set(x))
    mean = sum(map(len, split.values())) / len(items)

    def score(words, i):
        c = Counter(split[i])
        k = 1.2 * (0.25 + 0.75 * len(split[i]) / mean)
        return sum(math.log(1 + (60 - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + k) for w in set(words) if w in c)

    for _, text in docs:
        words = text.lower().split()
        starts = decontam.windows_of(len(words), index.window)
        terms = np.full((len(starts), index.window), len(index.term))
        first = np.zeros(terms.shape, bool)
        want = set()
        for row, s in enumerate(starts):
            w = words[s : s + index.window]
            terms[row, : len(w)] = [index.term.get(x.encode(), len(index.term)) for x in w]
            first[row, : len(w)] = [x not in w[:j] and x.encode() in index.term for j, x in enumerate(w)]
            want |= {(row, i) for i in split if score(w, i) >= 0.5 * score(split[i], i)}
        got = decontam.retrieve(index, terms, first)
        assert {(w, index.ids[i]) for w, i in zip(got[0].tolist(), got[1].tolist(), strict=True)} == want


def test_planted_items_are_found_and_others_not(spark):
    items, docs = corpus()
    rows = [(i, t, 0) for i, t in docs] + [(500, None, 0), (501, "", 0), (502, "word " * 30_000 + items[3][1], 0), (0, docs[0][1], 0)]
    more = [*items, (900, None), (901, " ")]
    for at_once in (20_000, 17):
        out = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string, item_id int"), spark.createDataFrame(more, "item_id long, text string"), items_at_once=at_once).collect()
        assert {(r.doc_id, r.item_id) for r in out} == {(i, i % 60) for i in range(0, 120, 4)} | {(502, 3)}
        assert len(out) == 31


def test_empty_sides(spark):
    docs, none = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, none).count() == 0
    assert decontam.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_parts():
    assert decontam.parts(b"What is it? A cat") == ([b"what", b"is", b"it?"], [b"a", b"cat"])
    assert decontam.parts(b"a b c d e f\n") == ([b"a", b"b", b"c", b"d"], [b"e", b"f"])


def found(items, *texts):
    """The (text, item id) pairs of matches."""
    index = decontam.Index([(i, t.encode()) for i, t in items])
    return {(i, index.ids[item]) for i, item, *_ in decontam.matches(index, [t.encode() for t in texts])}


def test_glued_and_changed_edge_words_of_short_answers():
    items, _ = corpus()
    question = " ".join(f"asks{i}" for i in range(20))
    for n in range(2, 12):
        answer = [f"tells{i}" for i in range(n)]
        item = f"{question}\n{' '.join(answer)}."
        texts = [f"before {item}%%% after", f"before ({question} {' '.join(answer[:-1])} changed after", f"{question} changed {' '.join(answer[1:])}", f"{question} and nothing else of it"]
        assert found([*items, (900, item)], *texts) == {(0, 900), (1, 900), (2, 900)}
    assert found([*items, (900, f"{question}\ntells.")], f"{question}\ntells.%%%", question) == {(0, 900)}


def test_a_scrambled_passage_does_not_hide_a_later_copy():
    items, _ = corpus()
    r = random.Random(9)
    words = items[5][1].split()
    mixed = " ".join(r.sample(words, len(words)))
    filler = " ".join(f"fill{i}" for i in range(400))
    assert found(items, f"{mixed} {filler} {items[5][1]} {filler}", f"{mixed} {filler}") == {(0, 5)}


def test_covered_equals_sets():
    r = random.Random(10)
    for _ in range(200):
        words, part = ([r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, n))] for n in (60, 12))
        starts = sorted(r.randint(0, len(words)) for _ in range(6))
        spans = [(s, min(len(words), s + 15)) for s in starts]
        size = decontam.size_of(part)
        want = decontam.grams(part, size)
        assert decontam.covered(words, spans, part) == [len(want & decontam.grams(words[a:b], size)) / len(want) if want else 1.0 for a, b in spans]


def test_long_items_copied_whole():
    items, _ = corpus()
    r = random.Random(11)
    for n in (1500, 4000):
        item = " ".join(f"long{r.randint(0, 3000)}" for _ in range(n))
        filler = " ".join(f"fill{i}" for i in range(700))
        assert found([*items, (900, item)], f"{filler} {item} {filler}", filler) == {(0, 900)}


def test_scores_do_not_depend_on_rounds(spark):
    items, docs = corpus()
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (900, None), (901, " ")], "item_id long, text string")
    one, many = ({(r.doc_id, r.item_id): (round(r.score, 3), r.at_word) for r in decontam.contaminated(docs, items, items_at_once=n).collect()} for n in (20_000, 17))
    assert one == many and len(one) == 30
