import math
import random
import zlib
from collections import Counter

import numpy as np

from collatio.llm import common, hpyp


def test_codes():
    word, code, share = hpyp.codes([b"ab", b"", b"c7"])
    s = {c: int(hpyp.OF[ord(c)]) for c in "abc7"}
    want = [(0, 0, 0, s["a"]), (0, 0, s["a"], s["b"]), (0, s["a"], s["b"], 0), (0, 0, 0, 0), (0, 0, 0, s["c"]), (0, 0, s["c"], s["7"]), (0, s["c"], s["7"], 0)]
    assert word.tolist() == [0, 0, 0, 1, 2, 2, 2]
    assert code.tolist() == [sum(x * 64 ** (3 - i) for i, x in enumerate(w)) for w in want]
    assert np.allclose(share, [0, 0, 0, 0, 0, -1, 0])


def test_every_context_sums_to_one():
    r = random.Random(1)
    words = ["".join(r.choice("abce") for _ in range(r.randint(1, 7))).encode() for _ in range(500)]
    _, code, _ = hpyp.codes(words)
    cells, n = np.unique(code, return_counts=True)
    for chain in (hpyp.Chain(cells, n), hpyp.Chain(cells[:0], n[:0])):
        assert np.allclose((10.0 ** chain.log10.astype(float)).reshape(-1, 64).sum(1), 1, atol=1e-3)
    chain = hpyp.Chain(cells, n)
    seen, unseen = hpyp.spell(chain.log10, [b"abc", b"zqx"])
    assert seen > unseen + 3


def law(n, p, d, s, others):
    """The chance of each number of tables of a cell, by all ways to seat n customers."""
    ways = {1: 1.0}
    for i in range(1, n):
        after = {}
        for t, w in ways.items():
            after[t] = after.get(t, 0) + w * (i - d * t)
            after[t + 1] = after.get(t + 1, 0) + w * (s + d * (others + t)) * p
        total = sum(after.values())
        ways = {t: w / total for t, w in after.items()}
    return ways


def test_seating_follows_the_law():
    rng = np.random.default_rng(3)
    for n, p, d, s, others in ((2, 0.3, 0.5, 1.0, 0), (7, 0.01, 0.7, 1.0, 40), (60, 0.3, 0.5, 1.0, 0), (60, 0.002, 0.8, 1.0, 900), (800, 0.2, 0.4, 1.0, 30)):
        want = law(n, p, d, s, others)
        mean = sum(t * w for t, w in want.items())
        kept, now = hpyp.seat(np.full(5000, n), np.full(5000, p), d, s, np.full(5000, others), rng)
        assert abs(kept.mean() / hpyp.UNIT - mean) < 0.04 * mean and abs(now.mean() - mean) < 0.05 * mean
    assert [x.tolist() for x in hpyp.seat(np.array([0, 1]), np.array([0.5, 0.5]), 0.5, 1.0, np.zeros(2), rng)] == [[0, hpyp.UNIT], [0, 1]]


def test_base_scores_and_held_out_texts(spark):
    r = random.Random(2)
    syllables = ["th", "er", "on", "an", "re", "tion", "ed"]
    say = lambda n: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))).capitalize() for _ in range(n))
    rows = [(i, say(r.randint(0, 80)), 1.0) for i in range(150)] + [(150, None, 0.0), (151, " \n", 0.0), (0, "again", 0.0), (0, "again", 0.0), (None, "no id", 0.0), (152, "long " * 20_000, 0.0)]
    out = hpyp.score(spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)).collect()
    assert len(out) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    lower = [(i, (t or "").lower().split() + [None]) for i, t, _ in rows]
    c = Counter(w for i, ws in lower if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in lower)
    assert sorted((x.doc_id or -1, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in out) == want
    assert all(x.score < 0 and math.isfinite(x.score) for x in out)


def test_no_rows(spark):
    assert hpyp.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def corpus(seed, n, words=60):
    r = random.Random(seed)
    names = ["".join(r.choice("abcde") for _ in range(r.randint(1, 5))) for _ in range(words)]
    after = {w: r.choices(names, k=6) for w in names}
    rows = []
    for i in range(n):
        text, w = [], r.choice(names)
        for _ in range(r.randint(0, 60)):
            text.append(w)
            w = r.choice(after[w] if r.random() < 0.8 else names)
        rows.append((i, " ".join(text)))
    return rows


def seated(spark, rows, rounds=hpyp.ROUNDS, parts=3):
    docs = spark.createDataFrame([(i, False, bytearray(t.encode())) for i, t in rows], "doc_id long, held_out boolean, text binary").repartition(parts)
    model = hpyp.Model(docs, common.Scratch(spark, "test"))
    model.seat(rounds)
    return model


def probabilities(model, base=False):
    """From a model in one part: words, P(word) and P(word | context), the contexts' customers, the unseen words' share of the base."""
    own, parent, sums = (hpyp.load(model.folder, f"{n}") for n in ("words-0", f"parent-0-{model.sweep}", f"tables-0-{model.sweep}"))
    words, n = hpyp.zstandard.decompress(own["words"]).split(b" "), hpyp.unpack(own["n"])
    p = hpyp._given(hpyp.unpack(sums["came"]), hpyp.unpack(parent["kept"]), hpyp.unpack(parent["base"]), model.upper, model.kept / hpyp.UNIT, model.came)
    return words, n, p, hpyp.unpack(parent["base"]), hpyp.unpack(sums["kept"]) / hpyp.UNIT


def test_probabilities_of_a_context_sum_to_one(spark):
    rows = corpus(1, 200)
    model = seated(spark, rows)
    words, n, p, base, of = probabilities(model)
    assert n.sum() == model.train_tokens == sum(len(t.split()) + 1 for _, t in rows)
    assert abs(p.sum() + (hpyp.STRENGTH + model.upper * model.kept / hpyp.UNIT) * (1 - base.sum()) / (hpyp.STRENGTH + model.came) - 1) < 1e-5
    # a text of one word w after each context u that it may follow: the scores of all pairs, from the model itself
    place = {w: i for i, w in enumerate(words)}
    pairs = Counter(x for _, t in rows for x in zip([b"", *t.encode().split()], [*t.encode().split(), b""], strict=True))
    assert model.came >= len({x for x in pairs if n[place[x[0]]] >= hpyp.LEAST}) - 1
    got = {r.doc_id: r.score for r in model.score().collect()}
    seats = {}
    for number in {r.chunk for r in model.chunks.collect()}:
        c = hpyp.Chunk(model.folder, number, model.word_parts)
        codes = np.unique(c.codes())
        at, _, _ = c.pairs(c.load("counts"), codes, model.pair_parts)
        seen = c.load("seen") % 3
        x = np.where(seen == 1, 1 - model.lower, 0.0)
        x[seen == 2] = c.load("seats")
        for code, v in zip(codes[at].tolist(), x.tolist(), strict=True):
            seats[c.words[code // c.size], c.words[code % c.size]] = v
    for u, i in place.items():
        if n[i] >= hpyp.LEAST:
            mine = sum(v for (a, _), v in seats.items() if a == u)
            assert abs((mine + hpyp.STRENGTH + model.lower * of[i]) / (hpyp.STRENGTH + n[i]) - 1) < 1e-4
    for i, t in rows[:40]:
        want, before = 0.0, b""
        for w in [*t.encode().split(), b""]:
            N, T = (n[place[before]], of[place[before]]) if n[place[before]] >= hpyp.LEAST else (0, 0)
            want += math.log10((seats.get((before, w), 0.0) + (hpyp.STRENGTH + model.lower * T) * p[place[w]]) / (hpyp.STRENGTH + N))
            before = w
        assert abs(got[i] - want) < 1e-3


def test_scores_do_not_depend_on_partitions_or_chunks(spark, monkeypatch):
    rows = corpus(2, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({r.doc_id: round(r.score, 4) for r in hpyp.score(docs.repartition(k)).collect()} for k in (1, 5))
    monkeypatch.setattr(hpyp, "CHUNK", 500)
    three = {r.doc_id: round(r.score, 4) for r in hpyp.score(docs.repartition(2)).collect()}
    assert one == two == three


def test_contexts_of_one_token_have_restaurants(spark):
    """Each word is in training once: all its pairs are customers, and a held-out copy is likelier than the words in another order."""
    assert hpyp.dealt(np.zeros(0, np.int64)) == []  # no pair is there twice
    text = [f"w{i}" for i in range(300)]
    mixed = random.Random(1).sample(text, len(text))
    assert seated(spark, [(1, " ".join(text))], parts=1).came == len(text) + 1
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    assert zlib.crc32(b"0") % 7 != 2
    rows = [(0, " ".join(text)), (held[0], " ".join(text)), (held[1], " ".join(mixed))]
    got = {r.doc_id: r.score for r in hpyp.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 100


def test_better_than_single_words(spark):
    out = hpyp.score(spark.createDataFrame(corpus(3, 600), "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)


def test_tables_against_a_sampler_of_single_customers(spark):
    """The same corpus, discounts and spelling base: customers leave and come one at a time, in contexts and parent."""
    rows = corpus(4, 150, 25)
    model = seated(spark, rows, rounds=4)
    words, n, p, base, of = probabilities(model)
    place = {w: i for i, w in enumerate(words)}
    V, r = len(words), np.random.default_rng(5)
    d, e, s = model.lower, model.upper, hpyp.STRENGTH
    came = [(place[a], place[b]) for _, t in rows for a, b in zip([b"", *t.encode().split()], [*t.encode().split(), b""], strict=True)]
    tables = [[[] for _ in range(V)] for _ in range(V)]  # customers of each table, by context and word
    parent = [[] for _ in range(V)]  # of each table of the parent, by word
    N, T, M, U = np.zeros(V), np.zeros(V), 0, 0

    def prob(w):
        return (sum(parent[w]) - e * len(parent[w]) + (s + e * U) * base[w]) / (s + M)

    def sit(of, weights):
        k = r.choice(len(weights), p=np.array(weights) / sum(weights))
        if k == len(of):
            of.append(0)
        of[k] += 1
        return k == len(of) - 1 and of[k] == 1

    def leave(of):
        k = r.choice(len(of), p=np.array(of) / sum(of))
        of[k] -= 1
        if not of[k]:
            of.pop(k)
            return True
        return False

    sampled, sums, share = 0, np.zeros(V), np.zeros(V)
    for sweep in range(40):
        for u, w in came:
            here = tables[u][w]
            if sweep and leave(here):
                T[u] -= 1
                M -= 1
                U -= leave(parent[w])
            N[u] -= sweep > 0
            if sit(here, [c - d for c in here] + [(s + d * T[u]) * prob(w)]):
                T[u] += 1
                U += sit(parent[w], [c - e for c in parent[w]] + [(s + e * U) * base[w]])
                M += 1
            N[u] += 1
        if sweep >= 15:
            sampled += 1
            sums += T
            share += [prob(w) for w in range(V)]
    assert abs(sums.sum() / sampled - of.sum()) < 0.08 * of.sum()
    assert abs(share / sampled - p).sum() < 0.2  # ours is one draw of tables
