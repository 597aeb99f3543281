import gc
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from collatio.llm import chunks, common, rans

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n,kinds", [(1, 1), (1, 5), (17, 1), (1000, 3), (70_001, 5000), (300_000, 60_000)])
def test_block_round_trip_and_checkpoints(n, kinds):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), kinds).astype(np.uint32) * 7
    used, counts = np.unique(ids, return_counts=True)
    t = rans.Table.from_bytes(rans.Table.of_counts(used, counts).to_bytes())
    assert int(t.freq.sum()) == 1 << t.bits and t.freq.min() > 0
    data = rans.encode_block(t, ids, lanes=64, every=10)
    assert (rans.decode_block(t, data) == ids).all()
    lanes = min(64, -(-n // 16))
    for i in range(1, (-(-n // lanes) - 1) // 10 + 1):
        assert (rans.decode_block(t, data, i) == ids[i * 10 * lanes :]).all()


def test_slices_begin_at_checkpoints():
    r = np.random.default_rng(5)
    ids = np.minimum(r.zipf(1.3, 50_000), 3000).astype(np.uint32)
    t = rans.Table.of_counts(*np.unique(ids, return_counts=True))
    data = rans.encode_block(t, ids, lanes=32, every=20)
    for _ in range(40):
        a, b = sorted(r.integers(0, 50_001, 2).tolist())
        if a < b:
            assert (rans.slice_block(t, data, a, b) == ids[a:b]).all()
    assert len(rans.decode_block(t, data, 3, 3 * 20 * 32 + 5)) == 32  # one step


def test_ranges():
    x = rans.Ranges([5, 5, 5, 9, 20], 2)
    parts = x.parts_of([None, 1, 5, 6, 9, 10, 20, 21, -(2**63)], [b"a"] * 9)
    assert parts[0] in (0, 1) and parts[1] == 2 and parts[2] in (3, 4, 5) and parts[3:] == [6, 6, 7, 7, 8, 2] and x.parts == 9
    assert {x.parts_of([5], [str(i).encode()])[0] for i in range(50)} == {3, 4, 5}
    assert rans.Ranges([], 0).parts_of([3, -1], [b"", b""]) == [0, 0] and rans.Ranges([], 0).parts == 1


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.uint32) % 97
    t = rans.Table.of_counts(*np.unique(ids, return_counts=True))
    data = bytearray(rans.encode_block(t, ids))
    data[-9] ^= 4
    with pytest.raises(ValueError):
        rans.decode_block(t, bytes(data))


def test_documents_come_back(spark, monkeypatch):
    rows = [(i * 37 % 101, f"text {i} " * (i % 9), i) for i in range(300)] + [(7, None, 0), (None, "no id", 0), (-5, "", 0), (7, "z" * 40_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    folder = common.Scratch(spark, "test").folder("shards")
    out = rans.read(rans.write(docs, folder, PATH), folder).collect()
    t = Tokenizer.from_file(PATH)
    want = sorted(((r[0] is not None, r[0] or 0), t.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows)
    got = sorted(out, key=lambda r: r.start)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    assert [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])
    monkeypatch.setattr(rans, "SHARD_TEXT", 300)  # many shards, and ids of more text than one
    hot = spark.createDataFrame([*rows, *((7, f"again {i} " * 9, 1) for i in range(60)), *((None, f"none {i} " * 9, 1) for i in range(60))], "doc_id long, text string, ids int")
    folder = common.Scratch(spark, "test").folder("shards")
    blocks = rans.write(hot, folder, PATH)
    out = sorted(rans.read(blocks, folder).collect(), key=lambda r: r.start)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in out]
    assert order == sorted(order) and len(out) == hot.count() and blocks.select("part").distinct().count() > 20
    assert all(a.start + len(a.ids) // 4 == b.start for a, b in zip(out, out[1:], strict=False))
    some = rans.read(blocks, folder, [7, 100, -5, 10**6]).collect()
    assert sorted((r.start, bytes(r.ids)) for r in some) == [(r.start, bytes(r.ids)) for r in out if r.doc_id in (7, 100, -5)]
    folder = common.Scratch(spark, "test").folder("none")
    assert rans.read(rans.write(docs.limit(0), folder, PATH), folder).count() == 0


def test_chunks_have_the_librarys_ids():
    t = Tokenizer.from_file(PATH)
    encode, r = rans.by_library(t), random.Random(1)
    letters = "ab'sdtrve1²½éß.ªº_-ÿŸĿɏ\x01\x1f\x7f\xad·、中🎉ʰ<|>"
    single = [c for c in map(chr, range(0x250)) if not chunks.odd(c) and c not in " \n"]
    for names in (
        *([*{"".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(700)}, "<|endoftext|>", "a<|endoftext|>b", "", "\0x", "\ny"] for _ in range(20)),
        [c + "a" for c in single] + ["b" + c for c in single] + ["'s" + c for c in single],
        [],
    ):
        ids, n = encode(names)
        want = [e.ids for e in t.encode_batch([chunks.chunk_of(k) for k in names], add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_uncollected_gives_the_same_and_wakes_the_collector():
    assert gc.isenabled()
    assert list(common.uncollected(lambda x: ((i, gc.isenabled()) for i in x))(range(3))) == [(0, False), (1, False), (2, False)] and gc.isenabled()
    with pytest.raises(ZeroDivisionError):
        list(common.uncollected(lambda x: (1 // i for i in x))([1, 0]))
    assert gc.isenabled()


def test_chunks_are_found_in_parts_of_a_batch():
    told = []

    def code(names):
        told.append(sum(map(len, names)))
        return np.array([len(k) for k in names], np.uint32), np.ones(len(names), np.int64)

    texts = [" ".join(f"{i}-{k}" for k in range(20_000)) for i in range(30)]
    ids = chunks.Chunked(code, rans.KEEP)([*texts, "", "x" * (2 << 20)])
    assert [len(x) for x in ids] == [20_000] * 30 + [1, 1] and len(told) > 4 and max(told[:-1]) <= 1 << 20


def test_a_worker_keeps_the_things_of_one_operator():
    first = common.held("a", 1, list)
    assert common.held("a", 1, list) is first and common.held("a", 2, dict) == {}
    seen = list(common.lean("a", lambda x: (common.held("a", 1, list) is first for _ in x))([0, 0]))
    assert seen == [True, True]
    assert list(common.lean("b", lambda x: x)([3, 4])) == [3, 4] and common.held("a", 1, list) is not first
    common.leave()
    assert not common._HELD
