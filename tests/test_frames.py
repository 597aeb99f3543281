import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.operators import evaluate, fields, parse, runs
from collatio.sources import files, sinks
from collatio.streaming.resume import normalize_new

TEMPLATE = """
template:
  id: t1
  documents: [d1, d2]
  fields:
    - order: 2
      key: {id: k2, text: "Nato il", detection: {scope: global, match: fuzzy}}
      value: {id: born, category: numeric}
    - order: 1
      key: {id: k1, text: "Nome", detection: {scope: global, match: exact}}
      value: {id: name, category: dictionary, dictionary: names}
"""


def test_files(spark, tmp_path):
    (tmp_path / "ref").mkdir()
    for name, content in (("a_1.txt", b"\xef\xbb\xbfx\r\ny\rz"), ("a_2.txt", b""), ("a_10.txt", "é".encode())):
        (tmp_path / "ref" / name).write_bytes(content)
    got = {r.file: r.ref for r in files.references(spark, str(tmp_path / "ref")).collect()}
    assert got["a_2.txt"] == "" and got["a_10.txt"] == "é" and got["a_1.txt"].endswith("x\ny\nz")
    with pytest.raises(files.NoInput):
        files.references(spark, str(tmp_path), "*.none")
    (tmp_path / "out/experiment_001/m1").mkdir(parents=True)
    (tmp_path / "out/experiment_001/m2").mkdir()
    (tmp_path / "out/experiment_001/m1/a_1.txt").write_text("x y z")
    (tmp_path / "out/experiment_001/m1/extra.txt").write_text("")
    refs, models, hyps = files.references(spark, str(tmp_path / "ref")), files.models(spark, str(tmp_path / "out")), files.hypotheses(spark, str(tmp_path / "out"))
    status = {(r.model, r.file): r.status for r in evaluate.pair(refs, models, hyps).collect()}
    assert len(status) == 6 and status["m1", "a_1.txt"] == "ok" and status["m2", "a_2.txt"] == "missing_hypothesis"
    assert [r.file for r in evaluate.extra(refs, hyps).collect()] == ["extra.txt"]
    (tmp_path / "ref" / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="not UTF-8"):
        files.references(spark, str(tmp_path / "ref")).collect()


def test_images_in_natural_order(spark, tmp_path):
    for name in ("b2.PNG", "b10.png", "a.jpg", "x.txt"):
        (tmp_path / name).write_bytes(b"1")
    assert [r.image for r in files.images(spark, str(tmp_path), 2).collect()] == ["a.jpg", "b2.PNG"]
    assert [r.payload for r in files.image_payload(spark, f"{tmp_path}/a.jpg").collect()] == ["MQ=="]
    with pytest.raises(ValueError):
        files.images(spark, str(tmp_path), 0)


def test_templates_and_dictionaries(spark, tmp_path):
    (tmp_path / "template1.yaml").write_text(TEMPLATE)
    (tmp_path / "dictionaries.yaml").write_text("dictionaries:\n  names: [Ànna, '', B-C]\n  other: x\n")
    name, documents, of = files.templates(spark, str(tmp_path))[0]
    assert (name, documents, [f.order for f in of]) == ("t1", ["d1", "d2"], [1, 2])
    assert sorted(r.term for r in files.dictionaries(spark, f"{tmp_path}/dictionaries.yaml").collect()) == ["b c", "ànna"]
    assert files.dictionaries(spark, f"{tmp_path}/none.yaml").count() == 0
    with pytest.raises(Exception, match="no template for d3"):
        files.assign(spark.createDataFrame([("d3",)], "document string"), files.templates(spark, str(tmp_path))).collect()


def test_rates(spark):
    pairs = spark.createDataFrame([("e", "m", "1", "", "", "ok"), ("e", "m", "2", "", "x", "ok"), ("e", "m", "3", "a", "b c d", "ok"), ("e", "m", "4", "a a b", "a b b", "ok")], "experiment string, model string, file string, ref string, hyp string, status string")
    got = {r.file: r for r in evaluate.measure(pairs).collect()}
    assert (got["1"].cer, got["1"].word_f1, got["1"].exact_match) == (0.0, 1.0, True)
    assert got["2"].cer is None and got["2"].word_precision == 0 and got["3"].cer > 1
    assert got["4"].word_matches == 2
    plan = evaluate.measure(pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2


FIELDS = [parse.Field(1, "k1", "Nome", "global", "fuzzy", "name", "string"), parse.Field(2, "k2", "Corso", "global", "fuzzy", "course", "dictionary", "courses"), parse.Field(3, "k3", "Anno", "global", "fuzzy", "year", "numeric")]


def test_recovery_counts_as_a_correction(spark):
    gt = "Nome anna Corso agraria Anno 3"
    pairs = spark.createDataFrame([("a", "t", gt, "Nome anna agrarja Anno 3"), ("b", "t", gt, "Nome anna agraria Anno 3"), ("c", "t", gt, "Nome anna Corso agrarja Anno 4"), ("d", "t", gt, None), ("e", "t", gt, "Nome anna xyz Anno 3")], "document string, template string, gt_text string, ocr_text string")
    x = fields.evaluate(pairs, {"t": FIELDS}, {"courses": ["agraria", "farmacia"]})
    got = {r.document: r for r in x.where("field_id = 'course'").collect()}
    of = lambda r: (r.local_recovery_applied, r.correction_applied, r.local_recovery_match, r.ocr_value_post, r.value_source_post, r.skip_reason_pre, r.skip_reason_post)
    assert of(got["a"]) == (True, True, "agrarja", "agraria", "dictionary_local_recovery", "key_missing", "")
    assert of(got["b"]) == (True, False, "agraria", "agraria", "dictionary_local_recovery", "key_missing", "")
    assert of(got["c"]) == (False, True, "", "agraria", "normal", "", "") and got["c"].local_recovery_region == ""
    assert of(got["d"])[:2] == (False, False) and of(got["d"])[4:] == ("unavailable", "key_missing", "key_missing")
    assert got["e"].local_recovery_region == "anna xyz" and not got["e"].local_recovery_applied and got["e"].value_correct_post is None
    assert (got["c"].value_correct_pre, got["c"].value_correct_post, got["a"].value_correct_pre) == (False, True, None)
    summary = {r.field_id: r for r in fields.field_summary(x).collect()}
    assert summary["course"].value_corrections_applied == 2 and summary["course"].value_wer_non_exact_pre is None
    rows = {(r.category, r.stage): r for r in fields.category_summary(x).collect()}
    assert len(rows) == 5 and rows["numeric", "pre"].items_non_exact == 1 and rows["key", "pre"].items_missing == 6
    nothing = fields.category_summary(x.limit(0)).collect()
    assert len(nothing) == 5 and all(r.items_total == 0 and r.exact_rate is None for r in nothing)


def test_a_truth_without_a_key_ends_the_run(spark):
    pairs = spark.createDataFrame([("a", "t", "Nome anna Anno 3", "Nome anna Anno 3")], "document string, template string, gt_text string, ocr_text string")
    with pytest.raises(Exception, match="the truth lacks a key: a k2"):
        fields.evaluate(pairs, {"t": FIELDS}, {}).collect()
    assert [tuple(r) for r in fields.guard(fields.evaluate(pairs, {"t": FIELDS}, {}, strict=False)).collect()] == [("a", "k2")]


def test_several_templates(spark):
    df = spark.createDataFrame([("Nome x Anno 3", "t"), ("Anno 5", "u"), (None, "u")], "text string, template string")
    out = [[(f.key_id, f.key_status) for f in r[0]] for r in df.select(parse.parsed(F.col("text"), {"t": FIELDS, "u": FIELDS[2:]}, template=F.col("template"))).collect()]
    assert out == [[("k1", "found"), ("k2", "missing"), ("k3", "found")], [("k3", "found")], [("k3", "missing")]]
    with pytest.raises(Exception, match="no template"):
        df.select(parse.parsed(F.col("text"), {"t": FIELDS}, template=F.col("template"))).collect()


def test_calls_are_logged(spark):
    def client():
        def ask(model, prompt, content):
            if content == b"bad":
                raise TimeoutError("slow")
            return {"message": {"content": "a\nb"}, "total_duration": 1_500_000_000, "load_duration": "?"} if content != b"odd" else {"message": {}}

        return ask

    work = spark.createDataFrame([("m", f"{n}.png", "p", bytearray(n.encode())) for n in ("ok", "bad", "odd")], "model string, image string, prompt string, content binary")
    got = {r.image: r for r in runs.transcribe(work, client, 3).collect()}
    assert (got["ok.png"].lines, got["ok.png"].total_duration_seconds, got["ok.png"].load_duration_seconds, got["ok.png"].output_file) == (2, 1.5, None, "ok.txt")
    assert got["bad.png"].error == "TimeoutError: slow" and got["odd.png"].status == "error"


class Server(BaseHTTPRequestHandler):
    seen: list = []

    def answer(self, status, data):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        self.answer(200, b'{"models": [{"name": "m"}, {"name": 3}, {"name": "a"}]}')

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((self.path, asked))
        if self.path == "/api/generate":
            self.answer(500, b"no")
        elif asked["messages"][0]["images"] == ["YmFk"]:
            self.answer(503, b"busy")
        elif asked["messages"][0]["images"] == ["b2Rk"]:
            self.answer(200, b"<html>")
        else:
            self.answer(200, b'{"message": {"content": " seen\\r\\n"}, "eval_count": 2}')

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    Server.seen.clear()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def test_client(server):
    c = runs.HttpClient(server)
    assert c.installed() == ["a", "m"]
    assert runs.text_of(c("m", "read", b"ok")) == " seen\r\n"
    asked = Server.seen[0][1]
    assert asked["options"] == {"temperature": 0, "seed": 42, "num_ctx": 8192, "num_predict": 4096} and asked["stream"] is False and asked["messages"][0]["content"] == "read"
    for image, told in ((b"bad", "HTTP 503: busy"), (b"odd", "isn't JSON: <html>")):
        with pytest.raises(runs.CallError, match=told):
            c("m", "read", image)
    c.close()
    assert Server.seen[-1] == ("/api/generate", {"model": "m", "prompt": "", "stream": False, "keep_alive": 0})
    with pytest.raises(runs.CallError, match="can't be reached"):
        runs.HttpClient("http://127.0.0.1:9").installed()
    with pytest.raises(runs.CallError, match="no text"):
        runs.text_of({"message": None})


def test_whole_run(spark, server, tmp_path):
    (tmp_path / "scans").mkdir()
    for n in ("a1", "a2", "a10"):
        (tmp_path / f"scans/{n}.png").write_bytes(b"bad" if n == "a2" else b"ok")
    go = lambda **k: runs.run(spark, **({"image_dir": str(tmp_path / "scans"), "output_dir": str(tmp_path / "out"), "models": ["m", "a"], "client": lambda: runs.HttpClient(server), "installed": ["m", "a"], "default_prompt": "read"} | k))
    assert go() == (2, {"completed": 4, "skipped": 0, "errors": 2})
    out = tmp_path / "out/experiment_001"
    assert (out / "m/a10.txt").read_bytes() == b" seen\r\n" and (out / "a/prompt.txt").read_text() == "read" and not (out / "m/a2.txt").exists()
    saved = json.loads((out / "experiment.json").read_text())
    assert (saved["status"], saved["images"], saved["summary"]["errors"]) == ("completed_with_errors", ["a1.png", "a2.png", "a10.png"], 2)
    (tmp_path / "scans/a2.png").write_bytes(b"ok")
    assert go(experiment=1) == (0, {"completed": 2, "skipped": 4, "errors": 0})
    assert go(experiment=1, overwrite=True) == (0, {"completed": 6, "skipped": 0, "errors": 0})
    assert go(experiment=1, default_prompt="other")[0] == 2 and go(experiment=1, limit=1)[0] == 1 and go(experiment=0)[0] == 1
    assert go(models=["z"])[0] == 1 and go(image_dir=str(tmp_path / "none"))[0] == 1
    assert go()[0] == 0 and (tmp_path / "out/experiment_002").exists()


def test_manifests(spark):
    saved = {"image_directory": "x", "images": ["a", "b"], "parameters": runs.DEFAULTS, "description": ""}
    assert runs.differences(saved, saved) == [] and runs.differences(saved, saved | {"images": ["b", "a"], "description": "x"}) == ["images"]
    assert runs.differences(saved | {"description": "y"}, saved | {"description": "x"}) == ["description"]
    folders = spark.createDataFrame([("experiment_007",), ("experiment_1000",), ("experiment_x",)], "folder string")
    assert runs.next_experiment(folders).first()[0] == 1001 and runs.next_experiment(folders.limit(0)).first()[0] == 1
    names = spark.createDataFrame([("gemma4:31b x",)], "m string").select(T.folder_name(F.col("m")), T.experiment_name(F.lit(1234)), T.seconds(F.lit("no")), runs.prompt(F.col("m"), {"gemma4:31b x": "p"}, "d")).first()
    assert tuple(names) == ("gemma4_31b_x", "experiment_1234", None, "p")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1 / 3, None, 1)], "d string, x double, y string, _z int")
    assert not sinks.write_csv(df.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert sinks.write_csv(df, str(tmp_path / "b"), bom=True)
    assert {f.read_bytes()[:5] for f in (tmp_path / "b").glob("*.csv")} == {b"\xef\xbb\xbfd,"}
    sinks.write_csv(df, str(tmp_path / "c"), by=["d"])
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert set(back.columns) == {"d", "x", "y"} and back.first()["x"] == "0.33333333"
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_json(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert json.loads(sinks.report(df).first()[0])["n"] == 1


def test_stream_takes_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    go = lambda: normalize_new(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"experiment": "e", "model": "m", "file": str(i), "text": "A-B"}))
        go()
        assert spark.read.parquet(str(tmp_path / "out")).count() == i + 1
    go()
    assert {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a b"}


def test_command_line(spark, tmp_path):
    from collatio.__main__ import main

    (tmp_path / "templates").mkdir()
    (tmp_path / "templates/template1.yaml").write_text(TEMPLATE)
    (tmp_path / "templates/dictionaries.yaml").write_text("names: [anna, marta]\n")
    for folder, name in (("gt", "Anna"), ("out/experiment_001/m", "Amna")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "d1.txt").write_text(f"Nome {name} Nato il 3-4")
    (tmp_path / "gt/d2.txt").write_text("Nome Marta Nato il 5")
    at = lambda p: str(tmp_path / p)
    assert main(["normalize", "--references", at("gt"), "--hypotheses", at("out"), "--output", at("normal")], spark) == 0
    told = json.loads((tmp_path / "normal/normalization_report.json").read_text())
    assert told["models"] == [{"experiment": "experiment_001", "model": "m", "normalized_files": 1, "missing_ground_truth_files": ["d2.txt"], "extra_output_files": []}]
    assert main(["evaluate", "--normalized", at("normal"), "--output", at("metrics")], spark) == 0
    assert json.loads((tmp_path / "metrics/metrics_report.json").read_text())["status_counts"] == {"ok": 1, "missing_hypothesis": 1}
    assert main(["parse", at("gt"), "--templates", at("templates"), "--output", at("parsed")], spark) == 0
    assert spark.read.json(at("parsed")).count() == 2
    assert main(["fields", at("out/experiment_001/m"), "--gt-dir", at("gt"), "--templates", at("templates"), "--output", at("results"), "--dictionary-margin", "10"], spark) == 0
    assert json.loads((tmp_path / "results/report.json").read_text())["field_summary"][1]["value_corrections_applied"] == 1
    assert spark.read.option("header", True).csv(at("results/documents")).count() == 2
    assert main(["parse", at("none"), "--templates", at("templates"), "--output", at("x")], spark) == 1


def test_tokens_of_large_batches_come_in_pieces(spark):
    """A worker holds the tokens of some texts, not of a whole batch; offsets are cut out exactly, odd characters and marks between tokens too."""
    odd = ["", "  ", "Aß é B", "x\x01y z\x01", " \x01 a", "a<unclear>b</unclear> <gap/>c", "😀 x😀y 𝒳 a", "ſß ŉ ǰ", "12-06 €5", " a  b "]
    assert [[tuple(t.values()) for t in x] for x in T.token_arrays([None, *odd]).to_pylist()] == [T.tokenize(T.compose(x)) for x in ["", *odd]]
    batch = pa.array(["a b " * 1000] * 3 + ["c"] * 5 + [None])
    assert [(s.start, s.stop) for s in T.pieces(batch, 8001)] == [(0, 2), (2, 9)] and [(s.start, s.stop) for s in T.pieces(batch, 10)] == [(0, 1), (1, 2), (2, 3), (3, 9)]
    assert [len(x) for x in T.tokenize_udf.func(iter([pa.array(["a b " * 100_000] * 4 + ["c"])]))] == [2, 3]
    df = spark.createDataFrame(list(enumerate([*odd, None, "\ufeffa b"])), "i int, text string").withColumn("t", T.tokenize_udf("text"))
    moved = F.transform("t", lambda t, i: F.struct(t["text"].alias("text"), (t["raw_start"] + i % 2).alias("raw_start"), (t["raw_end"] + i % 3).alias("raw_end")))
    for tokens in ("t", "moved"):
        plain = F.size(F.filter(tokens, lambda t: T.normalized(F.substring(F.col("text"), t["raw_start"] + 1, t["raw_end"] - t["raw_start"])) != t["text"]))
        got = df.withColumn("moved", moved).select(T.misplaced(F.col("text"), F.col(tokens)).alias("a"), plain.alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got] and (tokens == "t" or sum(r.a for r in got) > 5)


def test_forms_are_parsed_once_after_they_are_dealt(spark):
    """A filter on the parsed column, inferred from its explode, parsed all forms in the one task that reads them."""
    from collatio.plans.queries import QUERIES

    for name in ("local_keys", "parsed_fields", "recovered_keys", "search_region", "neighbor_windows", "raw_values"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("+- ArrowEvalPython [") == 1, name
        assert plan.index("ArrowEvalPython") < plan.index("REPARTITION_BY_NUM"), name


def test_parsed_forms_come_in_pieces(spark):
    """A worker holds the rows of some forms, not of a whole batch, and compares equal windows once."""
    texts = pa.array([f"Nome x{i} Corso agraria Anno {i}" for i in range(20_000)])
    named = pa.array(["t"] * len(texts))
    pieces = [len(x) for x in parse.parser({"t": FIELDS}).func(iter([(texts, named)]))]
    assert sum(pieces) == 20_000 and max(pieces) * 25 <= parse.AT_ONCE
    key, found = parse.Key(FIELDS[0]), []
    key.ratio = lambda text: found.append(text) or 100.0
    assert len(key.find(parse.Texts(["Nome a", "Nome b", "", "Nome"]), 70.0)) == 4 and found == ["nome"]
    assert not parse.Key(FIELDS[1]).known and parse.KNOWN <= 20_000


def test_report_has_its_documents_without_the_driver(spark, tmp_path, monkeypatch):
    """Rows of documents never come to the driver; the file is one JSON value, and is read by line."""
    gt = "Nome anna Corso agraria Anno 3"
    pairs = spark.createDataFrame([(f'd"{i}\u00e9,', "t", gt, gt if i % 2 else "Nome anna Anno 3") for i in range(40)], "document string, template string, gt_text string, ocr_text string")
    x, most = fields.evaluate(pairs, {"t": FIELDS}, {"courses": ["agraria", "farmacia"]}), []
    whole, collect = [r.asDict() for r in fields.document_summary(x).orderBy("document").collect()], type(x).collect
    monkeypatch.setattr(type(x), "collect", lambda df: most.append(rows := collect(df)) or rows)
    path = str(tmp_path / "report.json")
    fields.report(x, path, inputs={"gt_dir": "g"})
    assert max(map(len, most)) == 5
    told = json.loads((tmp_path / "report.json").read_text())
    assert told["document_summary"] == whole and (told["documents"], told["fields"], told["gt_dir"], len(told["category_summary"])) == (40, 120, "g", 5)
    got = collect(sinks.lines(spark, path))
    assert {r.name: json.loads(r.json) for r in got if r.name} == {k: v for k, v in told.items() if not k.endswith("_summary")}
    assert [json.loads(r.json) for r in got if r.name is None and '"document"' in r.json] == whole and sum(r.name is None for r in got) == 48
    fields.report(x.limit(0), path, inputs={})
    assert json.loads((tmp_path / "report.json").read_text())["document_summary"] == []


def test_executors_list_and_read_files(spark, tmp_path, monkeypatch):
    """The driver lists folders, not files; texts leave a worker in pieces."""
    for i in range(60):
        (tmp_path / f"o/experiment_1/m {i % 2}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"o/experiment_1/m {i % 2}/a{i} %41.txt").write_bytes(b"x\r\n" * (i % 3))
    (tmp_path / "o/experiment_1/m 0/b.txt").mkdir()
    (tmp_path / "o/experiment_1/m 0/c.TXT").write_text("")
    plain = lambda df: sorted(map(tuple, df.collect()))
    with monkeypatch.context() as m:
        m.setattr(files, "_listed", lambda *_: None)
        by_driver = plain(files.hypotheses(spark, str(tmp_path / "o")))
    monkeypatch.setattr(files, "listing", None)
    assert plain(files.hypotheses(spark, str(tmp_path / "o"))) == by_driver and len(by_driver) == 60
    monkeypatch.setattr(files, "READ", 10)
    batch = pa.RecordBatch.from_pydict({"path": [f"file:{tmp_path}/o/experiment_1/m {i % 2}/a{i} %41.txt" for i in range(9)]})
    assert [x.num_rows for x in files._contents(iter([batch]))] == [5, 4]
    with pytest.raises(files.NoInput):
        files.texts(spark, f"{tmp_path}/o/*/none/*.txt")


def test_ngrams_normalise_once_and_invariants_align_characters_only(spark):
    from collatio.plans.queries import QUERIES

    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan("token_ngrams").count("trim(regexp_replace(") == 1
    assert "character_edits(" in (x := plan("edit_invariants")) and "edit_counts(" not in x
    df = spark.createDataFrame([("kitten", "sitting", n) for n in (2, 3, 4)], "a string, b string, n int")
    assert [r[0] for r in df.select(F.call_function("levenshtein", F.col("a"), F.col("b"), F.col("n"))).collect()] == [-1, 3, 3]
