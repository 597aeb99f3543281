import hashlib

import numpy as np
import pytest

import corpus_pipeline
from collatio.llm import decontam, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left, stage(spark, left, SF)
        left = left.cache()
        assert left.columns == docs.columns
        assert left.count() <= before.count()
    assert left.where("text rlike 'AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}'").count() == 0
    assert left.where("n_chars <> length(text)").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == left.count()


def test_odd_rows(spark):
    long = "word other more " * 9000
    rows = [(1, None, "x", 2), (2, "", "x", 0), (2, "", "x", 0), (None, "no id at all", "x", 3), (None, "no id at all", "y", 3), (5, long, "x", 1), (6, long.upper(), "x", 1)]
    rows += [(9, "one text of an id that occurs twice", "x", 1), (9, "and quite another one of the same id", "x", 1), (9, "one text of an id that occurs twice", "x", 1)]
    docs = spark.createDataFrame([(*r, *("abcdef")) for r in rows], "doc_id long, text string, _x string, n_chars long, _gone string, _base string, _spans string, _fixed string, _twice string, score string")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
        if name != "bpe":
            assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2, 2, 5, 9, 9]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def brute(spark):
    """The whole pipeline over the smallest tables, stage by stage from plain rules; toxic texts and what random strings add are taken from their operators, which have tests of their own."""
    from tests.llm.test_minhash import brute as classes
    from tests.llm.test_secrets import brute as fixed

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    toxic = {r.doc_id for r in toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    docs = {i: t for i, t in docs.items() if i not in toxic}
    of = classes(list(docs.items()), 5, 80)
    docs = {i: t for i, t in docs.items() if of[i][1] == i}
    items = [r.text.encode() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {i for i, t in docs.items() if any(b" ".join(x.lower().split()) in b" ".join(t.encode().lower().split()) for x in items)}
    found = {r.doc_id for r in decontam.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert whole <= found
    out = {}
    for i, t in docs.items():
        if i not in found:
            at, text = 0, []
            for a, _, b in fixed(t):
                if a >= at:
                    text += [t[at:a], "[SECRET]"]
                at = max(at, b)
            out[i] = "".join(text) + t[at:]
    return out


def test_run_equals_plain_rules(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(corpus_pipeline.byte_bpe())
    want = {}
    for i, text in brute(spark).items():
        ids = t.encode(text, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == want
