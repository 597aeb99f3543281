import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from collatio.llm import bpe, chunks, common, rans

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def strings():
    r = random.Random(1)
    yield from ("", " ", "\n", "a", "<|endoftext|>", " x  <|endoftext|>y<|endoftext|>", "tab\t  b \x85 c\xa0\xa0d  e", "\x1c\x1d a\x1cb", "don't we'll 'S it's", "é ﬁ 東京タワー 🙂🙂 123,45", "a" * 3000, "ab " * 500, "﻿x​y")
    yield from ("a \0b", "\0", " \0", "\0\0 \0a\n\0", "\n\0b a")
    for c in (*map(chr, range(32)), "\x7f", "\x85"):
        yield from (f"a {c}b", f"{c}b a", f"a{c}b c", f"a b{c}", f"a\n{c}b", f"{c}{c}a {c}", c)
    for _ in range(400):
        yield "".join(r.choice(["th", "er", " ", "  ", "\n", "é", "ß", "'s", "12", "##", "\t", "ion", "Z", " ", "東", "🙂", "."]) for _ in range(r.randint(1, 60)))


def test_same_ids_and_text_as_the_library():
    t, c = Tokenizer.from_file(PATH), bpe.codec(PATH)
    texts = list(strings())
    for text, ids in zip(texts, c.encode_batch(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert c.decode(ids) == t.decode(want, skip_special_tokens=False)


def test_pairs_agree_with_exact_merging():
    c, r = bpe.codec(PATH), random.Random(2)
    a = np.array([r.randrange(len(c.bytes)) for _ in range(3000)])
    b = np.array([r.randrange(len(c.bytes)) for _ in range(3000)])
    sound = [c.merge(c.bytes[x]) == [x] and c.merge(c.bytes[y]) == [y] for x, y in zip(a, b, strict=True)]
    for x, y, ok, s in zip(a, b, c.compatible(a, b), sound, strict=True):
        if s:
            assert ok == (c.merge(c.bytes[x] + c.bytes[y]) == [x, y])


def test_few_words_need_merging():
    c = bpe.Codec(PATH)
    words = [w.encode() for w in ["the", "there", "encoding", "thorreou", "ndernt"] * 50]
    assert c.words(words) == [c.merge(w) for w in words]


def test_chunks_join_to_the_text():
    for text in strings():
        assert "".join(chunks.CHUNK.findall(text)) == text
        names = chunks.keys(text) if chunks.odd(text) else chunks.split([text]).to_pylist()[0]
        assert "".join(map(chunks.chunk_of, names)) == text


def test_the_cache_is_emptied():
    r = random.Random(3)
    texts = [" ".join(r.choice(["ab", "cd", "é", "x\ny", "z  z"]) + str(r.randint(0, 90)) for _ in range(30)) for _ in range(40)]
    code = lambda names: (np.frombuffer("".join(map(chunks.chunk_of, names)).encode("utf-32-le"), "<u4"), np.array([len(chunks.chunk_of(k)) for k in names]))
    c = chunks.Chunked(code, keep=50)
    for i in range(0, 40, 8):
        assert [x.tobytes().decode("utf-32-le") for x in c(texts[i : i + 8])] == texts[i : i + 8]
    assert c([]) == []


def test_library_by_joined_chunks():
    t = Tokenizer.from_file(PATH)
    encode, texts = chunks.Chunked(rans.by_library(t)), list(strings())
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_codec_goes_when_a_worker_serves_another_operator():
    c = bpe.codec(PATH)
    assert bpe.codec(PATH) is c
    assert list(common.lean("toxicity", lambda x: x)([1])) == [1]
    assert bpe.codec(PATH) is not c


def test_frames(spark):
    rows = [(1, "a token", "x"), (1, "a token", "x"), (2, None, None), (3, "", "y"), (None, "z", "y")]
    out = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in out) == [(0, "z"), (1, "a token"), (1, "a token"), (2, ""), (3, "")]
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
