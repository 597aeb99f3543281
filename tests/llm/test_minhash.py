import random
from collections import Counter

import numpy as np

from collatio.llm import common, minhash


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    r = random.Random(8)
    say = lambda n: [f"w{r.randint(0, 400)}" for _ in range(n)]
    rows, passage = [], say(50)
    for family in range(6):
        base = say(r.randint(60, 200))
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = f"e{r.randint(0, 10**6)}"
            rows.append(" ".join(w))
    rows += [" ".join(say(r.randint(5, 60)) + passage) for _ in range(40)]
    rows += ["", None, " \n ", "one", "ONE", "one two", "a b c d", "a b c d", "x " * 30_000]
    ids = r.sample(range(10_000), len(rows))
    return list(zip(ids, rows, strict=True))


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, rep int")
    for k in (4, 5):
        out = minhash.near_duplicates(df, shingle=k).collect()
        want = brute(rows, k, 80)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in out) and len(out) == len(rows)


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()) == [(4, 4, True), (4, 4, True), (9, 4, False)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_ids_with_several_texts(spark):
    one, two = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(4, one), (4, two), (7, two + " end"), (2, one + " end"), (None, one), (None, two), (9, None), (9, "x"), (8, "x")]
    want = [(4, 2, False), (4, 4, True), (7, 4, False), (2, 2, True), (None, None, True), (None, None, True), (9, 9, True), (9, 8, False), (8, 8, True)]
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_groups_in_blocks_and_shared_texts_in_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "GROUP", 3)
    monkeypatch.setattr(minhash, "FAN", 4)
    rows = corpus()
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, 4, 80)


def test_prefixes_equal_plain_order(spark):
    rows = [(i, t) for i, t in corpus() if t and len(t.split()) > 4][:120]
    got = {}
    for r in minhash.prefixes(spark.createDataFrame([(i, bytearray(t.encode())) for i, t in rows], "doc_id long, text binary"), common.Scratch(spark, "test"), 4, 80).collect():
        got.setdefault(r.rep, set()).add((r.token, r.n, r.place))
    sets = {i: common.shingles(common.words_of(t.encode()), 4).view(np.int64).tolist() for i, t in rows}
    df = Counter(x for s in sets.values() for x in s)
    for i, s in sets.items():
        n = len(s)
        first = sorted(s, key=lambda x: (df[x], x))[: n - -(-80 * n // 100) + 1]
        alone = sum(df[x] == 1 for x in s)
        assert got.get(i, set()) == {(x, n, alone + j) for j, x in enumerate(sorted((x for x in first if df[x] > 1), key=lambda x: (df[x], x)))}


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(1)
    for n in (1, 3, 50, 5000):
        x = r.integers(0, 2**63, n).astype(np.uint64)
        assert minhash.sketch(x).max() < np.iinfo(np.uint64).max
    a = r.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:889], r.integers(0, 2**63, 111).astype(np.uint64)])
    assert abs((minhash.sketch(a) == minhash.sketch(b)).mean() - 889 / 1111) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 199)]
    out = common.connected_components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "test")).collect()
    got = {r.node: r.component for r in out}
    assert len(out) == len(got) and got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 199: 199, 200: 199}
