"""WARC archives (ISO 28500, version 1.1): a writer, and a Python data source that reads headers first.

Writer: a gzip member for each record, with the lengths of the member in its `sl` extra field, so that a reader can skip it without decoding. Of records with the same payload of LEAST bytes or more, that with the largest page_id is a response, the others are revisits that name it and hold its HTTP headers only.
Reader (format "warc"): a partition for each file; record-type, URI and record-id predicates are pushed down and decided on the WARC header, of which a member's first bytes are decoded; an unwanted record's payload is never decoded. Option payload=false decodes headers only. A response's payload is checked against its digest.

Nulls: a null payload is empty; a null url becomes the record's id; a null page_id is written as an empty id and is never what others refer to. Equal rows are all responses if they have the largest page_id. Payloads of any length are whole in one record. An empty table makes no archive; reading a folder without archives gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from . import common as C

LEAST = 1000
#: Compressed bytes after which a task begins its next file.
FILE = 64 << 20
ID = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
SCHEMA = "record_id string, record_type string, target_uri string, record_date string, refers_to string, payload_digest string, payload_bytes long, http_header string, payload binary"
#: Columns that the WARC header alone decides.
PUSHED = {"record_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id"}
FIRST = 4096


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field says how long it is, packed and unpacked."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 12 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    own = f"<{ID}{'' if page_id is None else page_id}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or own[1:-1])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    lines += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str):
    def run(batches):
        at, root = fs.FileSystem.from_uri(folder)
        task, own, out, size, done = TaskContext.get().partitionId(), uuid.uuid4().hex, None, 0, []
        at.create_dir(root, recursive=True)

        def close():
            out.close()
            done.append((f"{root}/.{own}-{len(done)}", f"{root}/part-{task:05d}-{len(done):03d}.warc.gz", size))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, size = at.open_output_stream(f"{root}/.{own}-{len(done)}", compression=None), 0
                data = member(record(*row))
                out.write(data)
                size += len(data)
                if size >= FILE:
                    close()
                    out = None
        if out:
            close()
        for old, new, _ in done:
            at.move(old, new)
        yield pa.record_batch([pa.array([x[1] for x in done], pa.string()), pa.array([x[2] for x in done], pa.int64())], ["file", "bytes"])

    return run


def write(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """Writes the archives into a folder that all executors share; gives file and bytes. The rows of a task are sorted, so a repeated task writes the same files again."""
    spark = pages.sparkSession
    C.prepare(spark)
    scratch = C.Scratch(spark, "warc")
    pages = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    latest = pages.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1").select("digest", "latest")
    latest = C.broadcast_below(scratch.write(latest, "latest"), 100_000)
    refers = F.expr("case when latest is not null and (page_id is null or page_id < latest) then latest end")
    rows = pages.join(latest, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    return scratch.write(rows.sortWithinPartitions("page_id", "digest", "url").mapInArrow(_writer(folder), "file string, bytes long"), "files")


def header_fields(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


class Members:
    """Records of an archive, packed or plain: each gives its header first; rest() decodes the block, and only then."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def __iter__(self):
        at = 0
        while at < self.size:
            self.file.seek(at)
            start = self.file.read(FIRST)
            at = (yield from self._packed(at, start)) if start[:2] == b"\x1f\x8b" else (yield from self._plain(at, start))

    def _packed(self, at: int, start: bytes):
        known = struct.unpack_from("<I", start, 16)[0] if start[3] & 4 and start[12:14] == b"sl" else 0
        z, decoded, left, end = zlib.decompressobj(31), b"", start, at + len(start)
        while b"\r\n\r\n" not in decoded and not z.eof:
            decoded += z.decompress(left, FIRST)
            left = z.unconsumed_tail
            if not left and not z.eof:
                left = self.file.read(FIRST)
                end += len(left)
                if not left:
                    raise ValueError("the archive ends inside a record")
        head, _, first = decoded.partition(b"\r\n\r\n")
        state = {"done": None}

        def rest() -> bytes:
            if state["done"] is None:
                parts, tail, to = [first], left, end
                self.file.seek(to)
                while not z.eof:
                    parts.append(z.decompress(tail, 1 << 20))
                    tail = z.unconsumed_tail
                    if not tail and not z.eof:
                        tail = self.file.read(1 << 16)
                        to += len(tail)
                        if not tail:
                            raise ValueError("the archive ends inside a record")
                state["done"] = b"".join(parts), to - len(z.unused_data)
            return state["done"][0]

        yield header_fields(head), rest
        if known and state["done"] is None:
            return at + known
        rest()
        return state["done"][1]

    def _plain(self, at: int, start: bytes):
        while b"\r\n\r\n" not in start:
            more = self.file.read(FIRST)
            if not more:
                if start.strip():
                    raise ValueError("the archive ends inside a header")
                return self.size
            start += more
        head = start.partition(b"\r\n\r\n")[0]
        fields, begin = header_fields(head.lstrip(b"\r\n")), at + len(head) + 4
        n = int(fields["content-length"])

        def rest() -> bytes:
            self.file.seek(begin)
            return self.file.read(n)

        yield fields, rest
        return begin + n + 4


@dataclass
class File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.payload, self.wanted = options["path"], options.get("payload", "true").lower() == "true", []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = PUSHED.get(f.attribute[0]) if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name is None or isinstance(f, IsNotNull):
                yield f
            else:
                self.wanted.append((name, frozenset([f.value] if isinstance(f, EqualTo) else f.value)))

    def partitions(self):
        at, root = fs.FileSystem.from_uri(self.folder)
        found = at.get_file_info(fs.FileSelector(root, allow_not_found=True)) if at.get_file_info(root).type != fs.FileType.File else [at.get_file_info(root)]
        return [File(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and re.search(r"\.warc(\.gz)?$", x.path)] or [File("")]

    def read(self, partition: File):
        if not partition.path:
            return
        at, _ = fs.FileSystem.from_uri(self.folder)
        with at.open_input_file(partition.path) as f:
            rows, size = [], 0
            for fields, rest in Members(f):
                plain = lambda name: fields.get(name, "").strip("<>") or None  # noqa: B023, E731
                if any(plain(name) not in values for name, values in self.wanted):
                    continue
                rows.append(self._row(fields, plain, rest))
                size += len(rows[-1][-1] or b"")
                if len(rows) >= C.BATCH_ROWS or size >= 16 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    def _row(self, fields: dict, plain, rest) -> tuple:
        kind, digest, header, payload, n = plain("warc-type"), plain("warc-payload-digest"), None, None, None
        if digest and digest.startswith("sha1:"):
            digest = base64.b32decode(digest[5:]).hex()
        if self.payload and fields.get("content-type", "").startswith("application/http"):
            head, _, body = rest()[: int(fields["content-length"])].partition(b"\r\n\r\n")
            header, n = head.decode("utf-8", "replace"), int(header_fields(head).get("content-length", len(body)))
            if kind != "revisit":
                payload = body
                if digest and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"{plain('warc-record-id')}: the payload isn't what its digest says")
        return plain("warc-record-id"), kind, plain("warc-target-uri"), plain("warc-date"), plain("warc-refers-to"), digest, n, header, payload


_TYPES = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], [x.split()[0] for x in SCHEMA.split(", ")])


class WarcSource(DataSource):
    """Options: path (a folder or an archive), payload (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read(spark: SparkSession, folder: str, *, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def page_of(column: str):
    """The page_id in a record's id."""
    return F.expr(f"try_cast(substring({column}, {len(ID) + 1}) as bigint)")
