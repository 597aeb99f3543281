import gzip
import hashlib

from collatio.llm import common, warc

BIG = "<p>é" + "x" * 1200


def archives(spark, rows):
    folder = common.Scratch(spark, "test").folder("warc")
    files = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3), folder)
    return folder, files


ROWS = [(1, "http://a/ b\r\nX: y", BIG, "z"), (5, "http://c", BIG, None), (3, None, BIG, ""), (4, "u", "small", ""), (6, "u", "small", ""), (7, "u", None, ""), (8, "u", "\r\n\r\n" * 2000, ""), (5, "http://c", BIG, None)]


def test_round_trip(spark):
    folder, _ = archives(spark, ROWS)
    out = warc.read(spark, folder).collect()
    got = sorted((int(r.record_id[len(warc.ID) :]), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in out)
    size = len(BIG.encode())
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert got == [
        (1, "revisit", "urn:x-page:5", size, sha(BIG)),
        (3, "revisit", "urn:x-page:5", size, sha(BIG)),
        (4, "response", None, 5, sha("small")),
        (5, "response", None, size, sha(BIG)),
        (5, "response", None, size, sha(BIG)),
        (6, "response", None, 5, sha("small")),
        (7, "response", None, 0, sha("")),
        (8, "response", None, 8000, sha("\r\n\r\n" * 2000)),
    ]
    assert {r.payload.decode() for r in out if r.payload is not None} == {BIG, "small", "", "\r\n\r\n" * 2000}


def test_filters_are_pushed_and_payloads_skipped(spark, tmp_path):
    folder, _ = archives(spark, ROWS)
    only = warc.read(spark, folder).where("record_type = 'revisit'")
    assert only.count() == 2
    assert sorted(r.payload_bytes or 0 for r in warc.read(spark, folder, payload=False).collect()) == [0] * 8
    reader = warc.WarcReader({"path": folder})
    kept = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 3)]))
    assert kept == [warc.EqualTo(("payload_bytes",), 3)]
    decoded = []
    members = warc.Members.__iter__
    try:
        warc.Members.__iter__ = lambda self: ((f, lambda: decoded.append(f) or r()) for f, r in members(self))
        rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    finally:
        warc.Members.__iter__ = members
    assert len(rows) == 2 and {f["warc-type"] for f in decoded} == {"revisit"}


def test_plain_archives_and_other_gzip(spark, tmp_path):
    records = [warc.record(i, f"http://{i}", f"page {i}".encode() * 2000, hashlib.sha1(f"page {i}".encode() * 2000).hexdigest(), None) for i in range(5)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "other.txt").write_text("no archive")
    for where in ("record_type = 'response'", "target_uri in ('http://1', 'http://4')"):
        out = warc.read(spark, f"file://{tmp_path}").where(where)
        assert out.count() == (10 if "response" in where else 4)


def test_no_rows(spark):
    folder, _ = archives(spark, [])
    assert warc.read(spark, folder).count() == 0
