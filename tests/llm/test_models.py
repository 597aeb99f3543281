import math
import random
from collections import Counter

import numpy as np

from collatio.llm import ordinal, toxicity


def make(spark):
    r = random.Random(4)
    plain = [f"{a}{b}" for a in ("mel", "tor", "vin", "pas", "lum") for b in ("an", "er", "ok", "is")]
    bad = ["grumbo", "fletzig", "zorkul"]
    docs, labels = [], []
    for i in range(400):
        toxic, low = i % 5 == 0, i % 7 == 0
        words = [r.choice(plain) for _ in range(r.randint(20, 80))]
        if toxic:
            words[r.randrange(len(words))] = r.choice(bad)
            words.append(r.choice(bad))
        docs.append((i, " ".join(w + "***" if low else w for w in words), "x"))
        labels.append((i, 1 - low, int(toxic)))
    docs += [(1000, None, "x"), (1001, "", "x"), (1001, "", "x"), (1002, "grumbo " * 20_000, "x")]
    labels += [(1000, None, None), (None, 1, 1), (3, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {a: (b, c) for a, b, c in labels}


def test_toxicity_held_out(spark):
    docs, labels, truth = make(spark)
    out = toxicity.score(docs, labels).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert len(held) > 50 and all(r.predicted == truth[r.doc_id][1] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    by = {r.doc_id: r for r in out}
    assert by[1002].predicted == 1 and by[1002].neighbours and by[1000].predicted == by[1001].predicted == 0
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score(docs.limit(3), labels.limit(0)).collect()} == {0.0}


def plain_vector(words, idf, unknown):
    c = Counter(w.strip("*.,_").lower()[: toxicity.STEM] for w in words)
    c.pop("", None)
    v = {t: (1 + math.log(k)) * idf.get(t, unknown) for t, k in c.items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    return {t: x / size for t, x in v.items()}


def test_nearest_equals_brute_force_over_all_terms(monkeypatch):
    r = random.Random(1)
    names = ["".join(r.choice("abcdef") for _ in range(r.randint(1, 7))) for _ in range(400)]
    say = lambda: " ".join(r.choice(names[: r.choice([20, 400])]) + r.choice(["", "", ".", "**"]) for _ in range(r.randint(0, 40)))
    texts = [(i, int(i % 3 == 0), say()) for i in range(400)]
    toxic, other = Counter(), Counter()
    for _, y, t in texts:
        (toxic if y else other).update(set(toxicity.terms_of(t.encode())))
    terms = sorted(set(toxic) | set(other))
    p, n = sum(y for _, y, _ in texts), sum(1 - y for _, y, _ in texts)
    for wide in (1000, 30, 0):
        monkeypatch.setattr(toxicity, "WIDE", wide)
        weights = toxicity.Weights(terms, np.array([toxic[t] for t in terms]), np.array([other[t] for t in terms]), p, n)
        index = toxicity.Index([(i, y, *weights.vector(t.encode())) for i, y, t in texts], len(terms), p / (p + n))
        idf = dict(zip(terms, weights.idf.tolist(), strict=True))
        plain = {i: plain_vector(t.split(), idf, weights.unknown) for i, _, t in texts}
        for query in [*(t for _, _, t in texts[::9]), "unknown words only", "", say() + " zzzz yyyy", f"{names[0]} " * 500]:
            q = plain_vector(query.split(), idf, weights.unknown)
            every = sorted(((sum(x * v.get(t, 0) for t, x in q.items()), i) for i, v in plain.items()), reverse=True)
            want = [x for x, _ in every[: toxicity.NEAREST] if x > 0]
            at, w = weights.vector(query.encode())
            places, cosines = index.nearest(at, w) if len(at) else ([], [])
            assert np.allclose(cosines, want, atol=1e-4)
            near = {i for x, i in every if x > 0 and x > want[-1] - 1e-4} if want else set()
            assert set(index.ids[places].tolist() if len(at) else []) <= near


def test_terms_lean_only_with_support():
    lean = toxicity.leaning(np.array([1, 300, 0, 50, 300]), np.array([0, 0, 400, 100, 10]), 1000, 2000)
    assert lean[0] == lean[2] == lean[3] == 0 and lean[1] > 2 and lean[4] > 2


def test_curve():
    votes = np.concatenate([np.linspace(0, 0.4, 300), np.linspace(0.3, 1, 100)])
    labels = (np.random.default_rng(3).random(400) < 1 / (1 + np.exp(-20 * (votes - 0.35)))).astype(int)
    slope, middle = toxicity.curve(votes, labels)
    assert 8 < slope < 40 and abs(middle - 0.35) < 0.06
    chance = 1 / (1 + np.exp(-slope * (votes - middle)))
    assert abs(chance.mean() - labels.mean()) < 0.02
    assert toxicity.curve(votes, np.zeros(400)) == (8.0, 0.5) and toxicity.curve(np.zeros(0), np.zeros(0)) == (8.0, 0.5)


def test_ordinal_held_out(spark):
    docs, labels, truth = make(spark)
    out = ordinal.score(docs, labels).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert all(r.kept == (truth[r.doc_id][0] == 1) for r in held)
    assert all(r.p_at_least_1 >= r.p_at_least_2 and abs(r.expected_grade - r.p_at_least_1 - r.p_at_least_2) < 1e-9 for r in out)
    assert ordinal.score(docs.limit(0), labels).count() == 0
    assert all(abs(r.expected_grade - 1) < 1e-9 for r in ordinal.score(docs.limit(3), labels.limit(0)).collect())


def test_ordinal_learns_order():
    r = np.random.default_rng(2)
    rows = []
    for _ in range(1500):
        z = r.normal()
        rows.append((np.array([5, 9], np.int32), np.array([z, 1], np.float32), int(z > -0.5) + int(z > 0.7)))
    m = ordinal.fit(rows)
    assert m.thresholds[0] < m.thresholds[1]
    grade = lambda z: m.tails(np.array([5, 9]), np.array([z, 1])).sum()
    assert grade(-2) < 0.2 < grade(0) < 1.5 < grade(2)


def test_ordinal_gradient_and_thresholds():
    """The fitted weights and thresholds are where the loss, written out plainly, is least."""
    r = np.random.default_rng(6)
    rows = []
    for _ in range(600):
        x = r.normal(size=3)
        z = 1.5 * x[0] - x[1] + r.logistic()
        rows.append((np.array([3, 7, 11], np.int32), x.astype(np.float32), int(z > -1) + int(z > 0.5) + int(z > 2)))
    m = ordinal.fit(rows, grades=4, epochs=150)

    def loss(w, cuts):
        edges = [-math.inf, *cuts, math.inf]
        chance = lambda c, z: 1 / (1 + math.exp(min(700, -(c - z))))
        return -sum(math.log(max(1e-12, chance(edges[g + 1], float(x @ w)) - chance(edges[g], float(x @ w)))) for _, x, g in rows) / len(rows)

    w, cuts = m.weights[[3, 7, 11]], list(m.thresholds)
    best = loss(w, cuts)
    for i in range(3):
        for step in (-0.3, 0.3):
            assert loss(w + step * np.eye(3)[i], cuts) > best and loss(w, [c + step * (k == i) for k, c in enumerate(cuts)]) > best
    assert abs(w[0] - 1.5) < 0.35 and abs(w[1] + 1) < 0.35 and all(a < b for a, b in zip(cuts, cuts[1:], strict=False))
    tails = m.tails(np.array([3, 7, 11]), np.array([0.5, 0.2, 0.0]))
    assert np.allclose(tails, [1 / (1 + math.exp(c - 0.5 * w[0] - 0.2 * w[1])) for c in cuts])


def test_ordinal_vectors_equal_plain_counts():
    for text in ("", "a", "Ab cd Ab Ab. 12 x-- x--", "é É é"):
        at, x = ordinal.vector(text.encode())
        words = text.encode().split()
        want = Counter(p for w in words for p in ordinal.PLACES[w])
        want[0] += sum(a == b for a, b in zip(words, words[1:], strict=False))
        assert dict(zip(at.tolist(), (x * x * max(1, len(words))).round(4).tolist(), strict=True)) == {k: v for k, v in want.items() if v}
    assert ordinal.shape(b"Ab--12") == b"Aa-+0"
