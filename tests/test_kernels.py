import random

from collatio.functions import kernels, text
from collatio.operators.fields import Terms, accepts
from collatio.operators.parse import Field, Template, Window, apart, heaviest
from collatio.plans import forms


def table(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d[-1][-1]


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = d[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(d[i - 1][j], d[i][j - 1])
    return d[-1][-1]


def strings(n=300):
    r = random.Random(1)
    for _ in range(n):
        yield "".join(r.choice("abcé") for _ in range(r.randint(0, 80))), "".join(r.choice("abcé") for _ in range(r.randint(0, 80)))


def test_distance_and_edits(monkeypatch):
    assert kernels.distance("kitten", "sitting") == 3
    for bits in (kernels.MATRIX_BITS, 200):
        monkeypatch.setattr(kernels, "MATRIX_BITS", bits)
        for a, b in strings():
            s, d, i = kernels.edits(a, b)
            assert s + d + i == kernels.distance(a, b) == table(a, b)
            assert d - i == len(a) - len(b) and min(s, d, i) >= 0
    assert kernels.edits(["a", "b"], ["a", "c", "b"]) == (0, 0, 1)


def test_ratio():
    assert round(kernels.ratio("facolta", "facolt"), 3) == 92.308 and kernels.ratio("", "") == 100
    for a, b in strings():
        assert kernels.common_subsequence(a, b) == lcs(a, b)


def test_normalize():
    cases = {"12-06": "12 06", "Straße ſ µ ς": "strasse s μ σ", "é\r\nx\ry": "é x y", "﻿a﻿b": "ab", "a <Unclear >b</ unclear> <gap/> c": "a b c", "</gap>": "gap", "5 € +": "5", "a\x1cb​c": "a b​c", "": "", "  ": ""}
    for raw, want in cases.items():
        assert text.normalize(raw) == want
        assert text.normalize(want) == want


def test_offsets():
    raw = text.compose("Aß <gap/> é-B")
    assert [(t, raw[a:b]) for t, a, b in text.tokenize(raw)] == [("ass", "Aß"), ("é", "é"), ("b", "B")]


def test_chain_equals_exhaustive_search():
    r = random.Random(2)
    for _ in range(200):
        layers = [[] for _ in range(5)]
        for _ in range(r.randint(0, 9)):
            start, score = r.randint(0, 12), r.choice([88.0, 90.5, 100.0])
            place = r.randrange(5)
            layers[place].append((place, Window(-score, start, start + r.randint(1, 3), score)))
        nodes, best = [x for layer in layers for x in layer], 0.0
        for bits in range(1 << len(nodes)):
            some = sorted((n for i, n in enumerate(nodes) if bits >> i & 1), key=lambda n: n[0])
            if all(a[0] < b[0] and a[1].end <= b[1].start for a, b in zip(some, some[1:], strict=False)):
                best = max(best, sum(n[1].score for n in some))
        got = sorted(heaviest(layers).items())
        assert sum(w.score for _, w in got) == best
        assert all(a[0] < b[0] and a[1].end <= b[1].start for a, b in zip(got, got[1:], strict=False))


def test_of_equal_chains_the_first_stays():
    w = lambda start, end: Window(-90.0, start, end, 90.0)
    assert heaviest([[(0, w(4, 5)), (0, w(1, 2))], [(1, w(6, 7)), (1, w(9, 10))]]) == {0: w(1, 2), 1: w(6, 7)}
    assert heaviest([]) == {}


def plain_windows(field, tokens, least):
    key = text.normalize(field.key_text)
    n = len(key.split())
    sizes = [n] if field.match == "exact" or n == 1 else [k for k in (n - 1, n, n + 1) if k > 0]
    out = []
    for k in sizes:
        for i in range(len(tokens) - k + 1):
            window = " ".join(tokens[i : i + k])
            score = (100.0 if window == key else 0.0) if field.match == "exact" else 200 * lcs(window, key) / (len(window) + len(key))
            if score >= least:
                out.append((-round(score, 2), i, i + k))
    return sorted(out)


def test_windows_equal_brute_force():
    r = random.Random(5)
    fields = [Field(1, "a", "Nato il", "global", "fuzzy", "x", "string"), Field(2, "b", "residente a Roma in", "global", "fuzzy", "x", "string"), Field(3, "c", "di", "local", "exact", "x", "string"), Field(4, "d", "anno", "local", "fuzzy", "x", "string"), Field(5, "e", "...", "global", "fuzzy", "x", "string")]
    bits = ["nato", "il", "nafo", "natoil", "residente", "a", "roma", "in", "di", "anno", "ano", "x", "résidente", "resident"]
    texts = ["", "...", *(" ".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(80))]
    t = Template(fields, (80.0, 60.0, 70.0))
    for words, (_, spans, windows) in zip(texts, t.each(texts), strict=True):
        tokens = text.normalize(words).split()
        assert [x for x, _, _ in spans] == tokens
        for f, got in zip(fields, windows, strict=True):
            assert [w[:3] for w in got] == plain_windows(f, tokens, 60.0 if f.scope == "global" else 70.0)
            kept = []
            for w in got:
                if all(w.start != k.start and w.end != k.end for k in kept):
                    kept.append(w)
            assert apart(got, 3) == kept[:3]


FORM = [
    Field(1, "k1", "Cognome e nome", "global", "fuzzy", "name", "string"),
    Field(2, "k2", "Nato il", "global", "fuzzy", "born", "numeric"),
    Field(3, "k3", "a", "local", "exact", "place", "string"),
    Field(4, "k4", "Facoltà", "global", "fuzzy", "faculty", "dictionary", "faculties"),
    Field(5, "k5", "Matricola N", "global", "fuzzy", "number", "numeric"),
]


def rows(t):
    return {f["field_id"]: f for f in Template(FORM).parse([t])[0]}


def test_parse():
    out = rows("Cognome e nome: Rossi, Anna. Nato il 12-06-1931 a FIRENZE Facoltà agraria Matricola N. 77;")
    assert [f["value"] for f in out.values()] == ["rossi anna", "12 06 1931", "firenze", "agraria", "77"]
    assert (out["name"]["raw_value"], out["name"]["key_raw"], out["number"]["raw_value"]) == (": Rossi, Anna.", "Cognome e nome", ". 77;") and {f["boundary_status"] for f in out.values()} == {"ok"}
    out = rows("Cognome e nome x Nafo il 3 a y, agraria Matricola N 77")
    assert out["born"]["key_status"] == "recovered" and out["born"]["key_score"] == 85.71
    assert (out["faculty"]["region"], out["faculty"]["raw_region"], out["faculty"]["region_has_right"]) == ("y agraria", "y, agraria", True) and out["place"]["boundary_status"] == "next_key_missing"
    out = rows("")
    assert {f["key_status"] for f in out.values()} == {"missing"} and {f["region"] for f in out.values()} == {""}
    out = rows("Cognome e nome Matricola N")
    assert out["name"]["value"] == out["number"]["value"] == "" and out["born"]["region"] == ""
    again = Field(1, "k", "Nato il", "global", "fuzzy", "v", "string")
    assert Template([again]).parse(["nato il x nato il y"])[0][0]["value"] == "x nato il y"
    # a key that is far below the strong threshold is not searched at the text's ends
    assert rows("Nafo il 3 Matricola N 7")["born"]["key_status"] == "missing"
    # a document's rows don't depend on its neighbours
    texts = ["Cognome e nome", "", "e nome Nato il", "Nato il 3 a y Facoltà z"]
    assert Template(FORM).parse(texts) == [Template(FORM).parse([t])[0] for t in texts]


def test_terms():
    terms = Terms(["agraria", "farmacia", "economia", "economia e commercio"])
    best = terms.within("torino agrarja xx")
    assert (best["candidate"], best["phrase"], round(best["score"], 2)) == ("agraria", "agrarja", 85.71) and accepts(best, 70, 15)
    assert not accepts(terms.within("economia e commercio"), 70, 15) and terms.within("") is None and terms.whole("") is None
    assert terms.whole("farmacja")["candidate"] == "farmacia" and Terms(["a b c d"]).within("x") is None
    assert Terms(["ab", "ba"]).whole("xx")["candidate"] == "ba" and Terms(["ab"]).whole("ab") == {"candidate": "ab", "score": 100.0, "second_score": 0.0, "phrase": "ab"}


def test_crafts_can_be_told_apart():
    terms = Terms(list(forms.CRAFTS))
    for t in forms.CRAFTS:
        assert "i" in t and accepts(terms.whole(t.replace("i", "j")), 70, 15)


def test_edits_side_by_side_equal_edits_one_by_one(monkeypatch):
    r = random.Random(9)
    some = lambda letters, most: "".join(r.choice(letters) for _ in range(r.randint(0, most)))
    pairs = [(some("ab", 40), some("abc", 40)) for _ in range(300)] + [(some("abcdé😀", 8 * k), some("abcde", 8 * k + 1)) for k in range(40)]
    pairs += [(x, x) for x, _ in pairs[:5]] + [("", ""), ("", "a"), ("a" * 8, "b" * 8), ("ab" * 300, "ba" * 450)]
    for most in (kernels.LANE_BITS, 500):  # beyond it one by one
        monkeypatch.setattr(kernels, "LANE_BITS", most)
        assert kernels.edits_of(pairs) == [kernels.edits(a, b) for a, b in pairs]
    of_words = [(list(a), list(b)) for a, b in pairs]
    assert kernels.edits_of(of_words) == [kernels.edits(a, b) for a, b in of_words]
    alone, calls = kernels._columns, []
    monkeypatch.setattr(kernels, "_columns", lambda a, b: calls.append(a) or alone(a, b))
    kernels.edits_of(pairs[:300])
    assert len(calls) < 150
