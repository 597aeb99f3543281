"""Token ids in binary shards: static range asymmetric numeral system (Duda, 2013) with one frequency table for all shards.

A folder holds `frequencies` and `part-NNNNN.rans`. A block holds whole documents, about BLOCK ids, dealt to interleaved lanes whose 64-bit states renormalise by 32-bit words into one stream, so that arrays encode and decode all lanes at once. A block decodes alone; its checkpoints (states and place in the stream after every EVERY steps) let a decoder begin inside it: single documents are read from the checkpoint before them. The index at a shard's end has each block's place, documents, ids and CRC-32 of its bytes.

Shards follow ascending doc_id: documents are dealt by ranges of doc_id and sorted inside. Tasks write under a name of their own and rename at the end, so a repeated task (a lost executor) leaves the same shard.
Nulls: a null text is empty and has the end id alone; a null doc_id sorts first. Rows that repeat a doc_id each have a document in the shards; an id (or null) with more text than a shard is made for is dealt to several by hash of the text, in no order of its own. Texts of any length are whole in one block. An empty table makes no shard and an empty result.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .bpe import WORD, byte_letters
from .chunks import Chunked, chunk_of

MAGIC = b"CORANS1\n"
LOW = np.uint64(1 << 31)
LANES, BLOCK, EVERY = 4096, 1 << 20, 128
#: Bytes of text that a shard is made for, and ranges at most.
SHARD_TEXT, RANGES = 24 << 20, 10_000
#: Chunks that a worker remembers.
KEEP = 500_000
#: Words of characters that have each been a letter, a number or neither in all editions of Unicode since 5.0.
LATIN = re.compile("[\0-\u024f]*").fullmatch


class Table:
    """Quantised frequencies of the ids that occur: symbol s has freq[s] of 2**bits slots from start[s] on."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freq.astype(np.uint64)
        self.bits = int(self.freq.sum()).bit_length() - 1
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(ids), dtype=np.int32), freq.astype(np.int64))
        self.symbol = np.full(int(self.ids.max()) + 1, -1, np.int64)
        self.symbol[self.ids] = np.arange(len(ids))

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray) -> Table:
        bits = max(12, len(ids).bit_length() + 2)
        share = counts / counts.sum() * (1 << bits)
        freq = np.maximum(1, np.floor(share).astype(np.int64))
        rest = (1 << bits) - int(freq.sum())
        order = np.argsort(-freq, kind="stable")
        while rest:  # the largest give or take what is over
            step = np.minimum(np.abs(rest), np.maximum(1, freq[order] // 8))
            step = np.minimum(step, np.maximum(0, abs(rest) - (np.cumsum(step) - step)))
            step = np.minimum(step, freq[order] - 1) if rest < 0 else step
            freq[order] += np.sign(rest) * step
            rest = (1 << bits) - int(freq.sum())
        return cls(ids, freq)

    def to_bytes(self) -> bytes:
        body = self.ids.tobytes() + self.freq.astype(np.uint32).tobytes()
        return MAGIC + struct.pack("<II", len(self.ids), zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        n, crc = struct.unpack_from("<II", data, len(MAGIC))
        body = data[len(MAGIC) + 8 :]
        if data[: len(MAGIC)] != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("not a frequency table, or a damaged one")
        return cls(np.frombuffer(body, "<u4", n), np.frombuffer(body, "<u4", n, 4 * n))


def encode_block(t: Table, ids: np.ndarray, lanes: int = LANES, every: int = EVERY) -> bytes:
    symbols, bits = t.symbol[ids], np.uint64(t.bits)
    if (symbols < 0).any():
        raise ValueError("an id that the table doesn't have")
    lanes = max(1, min(lanes, -(-len(ids) // 16)))
    x, words, marks, n = np.full(lanes, LOW), [], [], 0
    steps = -(-len(ids) // lanes)
    for step in range(steps - 1, -1, -1):
        s = symbols[step * lanes : (step + 1) * lanes]
        f, state = t.freq[s], x[: len(s)]
        over = state >= f << (np.uint64(63) - bits)
        out = state[over]
        words.append(out.astype(np.uint32))
        n += len(out)
        state[over] = out >> np.uint64(32)
        q = state // f
        state[:] = (q << bits) + (state - q * f) + t.start[s]
        if step and step % every == 0:
            marks.append((step, n, x.copy()))
    marks.append((0, n, x))
    body = b"".join(struct.pack("<II", step, n - left) + states.tobytes() for step, left, states in reversed(marks))
    return struct.pack("<IIII", len(ids), lanes, len(marks), n) + body + b"".join(w.tobytes() for w in reversed(words))


def decode_block(t: Table, data: bytes, checkpoint: int = 0, until: int | None = None) -> np.ndarray:
    """The ids from the checkpoint's step on; checkpoint 0 begins the block. until: ids from the block's beginning that are enough."""
    n, lanes, marks, n_words = struct.unpack_from("<IIII", data)
    size = 8 + 8 * lanes
    step, at = struct.unpack_from("<II", data, 16 + checkpoint * size)
    x = np.frombuffer(data, "<u8", lanes, 24 + checkpoint * size).copy()
    words = np.frombuffer(data, "<u4", n_words, 16 + marks * size).astype(np.uint64)
    last = n if until is None else min(n, -(-until // lanes) * lanes)
    out, bits, low = np.empty(max(0, last - step * lanes), np.int32), np.uint64(t.bits), np.uint64((1 << t.bits) - 1)
    for first in range(step * lanes, last, lanes):
        state = x[: min(lanes, n - first)]
        slot = state & low
        s = t.slots[slot]
        out[first - step * lanes : first - step * lanes + len(state)] = s
        state[:] = t.freq[s] * (state >> bits) + slot - t.start[s]
        under = state < LOW
        taken = int(under.sum())
        state[under] = (state[under] << np.uint64(32)) | words[at : at + taken]
        at += taken
    if last == n and (at != n_words or (x != LOW).any()):
        raise ValueError("a damaged block: the states don't end where they began")
    return t.ids[out]


def slice_block(t: Table, data: bytes, first: int, end: int) -> np.ndarray:
    """The ids from first to end, decoded from the checkpoint before."""
    _, lanes, marks, _ = struct.unpack_from("<IIII", data)
    steps = [struct.unpack_from("<I", data, 16 + i * (8 + 8 * lanes))[0] for i in range(marks)]
    mark = max(i for i, s in enumerate(steps) if s * lanes <= first)
    return decode_block(t, data, mark, end)[first - steps[mark] * lanes : end - steps[mark] * lanes]


class Shard:
    """Writes one shard; close() renames it to its name."""

    def __init__(self, folder: str, part: int, t: Table):
        self.fs, self.path = fs.FileSystem.from_uri(f"{folder}/part-{part:05d}.rans")
        self.t, self.own, self.part = t, f"{self.path}.{uuid.uuid4().hex}", part
        self.out = self.fs.open_output_stream(self.own)
        self.out.write(MAGIC)
        self.at, self.index, self.docs, self.ids, self.size = len(MAGIC), [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.ids.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.docs:
            data = encode_block(self.t, np.concatenate(self.ids))
            self.out.write(data)
            self.index.append({"at": self.at, "bytes": len(data), "crc32": zlib.crc32(data), "n_ids": self.size, "docs": [x for x, _ in self.docs], "lengths": [n for _, n in self.docs]})
            self.at += len(data)
            self.docs, self.ids, self.size = [], [], 0

    def close(self):
        self.flush()
        foot = zlib.compress(json.dumps(self.index).encode())
        self.out.write(foot + struct.pack("<I", len(foot)) + MAGIC)
        self.out.close()
        self.fs.move(self.own, self.path)
        for i, b in enumerate(self.index):
            yield self.part, i, b["n_ids"]


def read_index(file) -> list[dict]:
    size = file.size()
    file.seek(size - 4 - len(MAGIC))
    tail = file.read()
    if tail[4:] != MAGIC:
        raise ValueError("not a whole shard")
    n = struct.unpack("<I", tail[:4])[0]
    file.seek(size - 4 - len(MAGIC) - n)
    return json.loads(zlib.decompress(file.read(n)))


def _table(folder: str) -> Table:
    at, path = fs.FileSystem.from_uri(f"{folder}/frequencies")
    with at.open_input_stream(path) as f:
        return Table.from_bytes(f.read())


def by_library(t):
    """Ids of chunks by the tokenizers library, given their keys. Words after a single space go in joined texts, where a token with that space begins each: one call for many chunks.

    Where the file has the plain byte-level pre-tokenizer, words of Latin letters, digits and signs (below U+0250, where editions of Unicode agree) are cut by its pattern here, and only their pieces go to the library's model: that spares the library's offsets.
    """
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    begins = np.zeros(t.get_vocab_size(), bool)
    for name, i in t.get_vocab().items():
        begins[i] = name[:1] == "\u0120"
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    alone = lambda texts: [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    cut, model = t.pre_tokenizer, t.model
    plain = t.normalizer is None and isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space and isinstance(model, BPE)
    letters = "".join(sorted(byte_letters(), key=byte_letters().get)[:255]) + " "  # UTF-8 has no byte 255; here U+DCFF becomes it and parts pieces

    def by_model(pieces: str) -> np.ndarray:
        names = codecs.charmap_decode(pieces.encode("utf-8", "surrogateescape"), "strict", letters)[0]
        return np.array([x.id for piece in names.split(" ") for x in model.tokenize(piece)], np.uint32)

    def encode(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rest, other, words, signs = [], [], [], []
        for i, k in enumerate(names):
            if not k or k[0] in "\0\n":
                rest.append(i)
            elif plain and (k.isascii() or LATIN(k)):
                (words if k.isalpha() else signs).append(i)
            else:
                other.append(i)
        order, ids, sizes = [], [], []
        for kind, ids_of in ((words, lambda x: by_model(x.replace(" ", "\udcff ")[1:])), (signs, lambda x: by_model("\udcff".join(WORD.findall(x)))), (other, lambda x: alone([x])[0])):
            for k in range(0, len(kind), 500):
                some = kind[k : k + 500]
                text = " " + " ".join([names[i] for i in some])
                found = ids_of(text)
                at = np.flatnonzero(begins[found])
                if len(at) == len(some) and not any(s in text for s in special):
                    order += some
                    ids.append(found)
                    sizes.append(np.diff(at, append=len(found)))
                else:  # a special token's text, or a token of letters that begins with a space for another reason
                    rest += some
        order += rest
        told = alone([chunk_of(names[i]) for i in rest])
        ids, sizes = [*ids, *told], np.concatenate([*sizes, np.array([len(x) for x in told], np.int64)]).astype(np.int64)
        flat, ends = np.concatenate([*ids, np.empty(0, np.uint32)]), np.cumsum(sizes)
        back = np.empty(len(names), np.int64)
        back[order] = np.arange(len(names))
        n = sizes[back]
        return flat[np.arange(len(flat)) + np.repeat((ends - sizes)[back] - np.cumsum(n) + n, n)], n

    return encode


class Ranges:
    """Parts by ascending doc_id: nulls first, then a part up to each bound. A bound that several quantiles share has as many parts of its own, dealt by hash of the text; so have nulls."""

    def __init__(self, bounds: list[int], nulls: int):
        self.bounds, times = np.unique(np.array(bounds, np.int64), return_counts=True)
        self.nulls, self.own = nulls, np.append(np.where(times > 1, times, 0), 0)
        self.begin = nulls + np.cumsum(1 + self.own) - self.own - 1
        self.parts = int(nulls + (1 + self.own).sum())

    def parts_of(self, ids: list[int | None], texts: list[bytes]) -> list[int]:
        known = np.array([0 if i is None else i for i in ids], np.int64)
        at = np.searchsorted(self.bounds, known)
        hot = self.own[at] * (np.append(self.bounds, 0)[at] == known)
        out = self.begin[at]
        for k in np.flatnonzero(hot).tolist():
            out[k] += 1 + zlib.crc32(texts[k]) % int(hot[k])
        return [zlib.crc32(x) % self.nulls if i is None else p for i, p, x in zip(ids, out.tolist(), texts, strict=True)]


def _encoder(path: str):
    """The library's tokenizer, and its encoder of texts by chunks."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t, Chunked(by_library(t), KEEP)


def _tokenise(path: str, end: int, ranges: Ranges):
    def run(batches):
        t, encode = C.held("rans", path, lambda: _encoder(path))
        pack, counts = zstandard.ZstdCompressor(1), np.zeros(max(t.get_vocab_size(), end + 1), np.int64)
        small = np.uint16 if len(counts) <= 1 << 16 else np.uint32
        mark = np.array([end], small).tobytes()

        def coded(batch):  # what it makes goes before the next batch comes
            out, texts = [], batch.column("text").to_pylist()
            parts = ranges.parts_of(batch.column("doc_id").to_pylist(), texts)
            told = encode([x.decode() for x in texts])
            np.add(counts, np.bincount(np.concatenate([*told, np.empty(0, np.uint32)]), minlength=len(counts)), out=counts)
            counts[end] += len(told)
            for x in told:
                out.append(pack.compress(x.astype(small).tobytes() + mark))
            return pa.record_batch([pa.array(parts, pa.int32()), batch.column("doc_id"), pa.array(out, pa.binary())], ["part", "doc_id", "ids"])

        for batch in batches:
            yield coded(batch)
        yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([small().itemsize], pa.int64()), pa.array([pack.compress(counts.tobytes())], pa.binary())], ["part", "doc_id", "ids"])

    return run


def _sum_counts(batches):
    """Adds up the counts of the tasks that this one reads: a row for each id that occurs."""
    total, small = None, 0
    for batch in batches:
        for n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            x = np.frombuffer(zstandard.decompress(data), np.int64)
            total, small = x if total is None else total + x, n
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at]), pa.array(np.full(len(at), small))], ["id", "n", "width"])


def _write(folder: str, width: int):
    def run(batches):
        t, shard = _table(folder), None
        unpack, kind = zstandard.ZstdDecompressor(), np.uint16 if width == 2 else np.uint32
        rows = lambda x: pa.record_batch([pa.array([r[i] for r in x], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["part", "block", "n_ids"])
        for batch in batches:
            for part, doc_id, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard is None or shard.part != part:
                    if shard:
                        yield rows(list(shard.close()))
                    shard = Shard(folder, part, t)
                shard.add(doc_id, np.frombuffer(unpack.decompress(data), kind))
        if shard:
            yield rows(list(shard.close()))

    return run


def _read(folder: str, wanted: frozenset | None):
    def run(batches):
        t, index, name = None, None, None
        for batch in batches:
            for part, block, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, path = fs.FileSystem.from_uri(f"{folder}/part-{part:05d}.rans")
                t = t or _table(folder)
                with at.open_input_file(path) as f:
                    if name != path:
                        index, name = read_index(f), path
                    b = index[block]
                    mine = [i for i, d in enumerate(b["docs"]) if wanted is None or d in wanted]
                    if not mine:
                        continue
                    f.seek(b["at"])
                    data = f.read(b["bytes"])
                if zlib.crc32(data) != b["crc32"]:
                    raise ValueError(f"{path}: block {block} is damaged")
                ends = np.cumsum(b["lengths"])
                starts = ends - b["lengths"]
                if wanted is None:
                    ids = decode_block(t, data).astype("<u4").tobytes()
                    found = [ids[4 * i : 4 * j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                else:
                    found = [slice_block(t, data, int(starts[i]), int(ends[i])).astype("<u4").tobytes() for i in mine]
                yield pa.record_batch([pa.array([b["docs"][i] for i in mine], pa.int64()), pa.array(start + starts[mine]), pa.array(found, pa.binary())], ["doc_id", "start", "ids"])

    return run


def write(docs: DataFrame, folder: str, path: str, *, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards into a folder that all executors share; gives a row for each block: part, block, start, n_ids (start: ids of all blocks before)."""
    spark = docs.sparkSession
    C.prepare(spark)
    scratch = C.Scratch(spark, "rans")
    docs = C.id_and_text(docs, key, text)
    size, empty = (x or 0 for x in docs.agg(F.sum(F.length("text")), F.sum(F.when(F.col("doc_id").isNull(), F.length("text") + 1))).first())
    parts = min(RANGES, max(1, -(-size // SHARD_TEXT)))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    ranges = Ranges(bounds or [], min(RANGES, -(-empty // SHARD_TEXT)))
    told = scratch.write(docs.mapInArrow(C.lean("rans", C.uncollected(_tokenise(path, end, ranges))), "part int, doc_id long, ids binary"), "ids")
    counts = told.where("part = -1").mapInArrow(_sum_counts, "id long, n long, width long").groupBy("id").agg(F.sum("n").alias("n"), F.max("width").alias("width")).orderBy("id").toPandas()  # as many rows as the vocabulary has at most
    if size + len(counts) == 0:
        return spark.createDataFrame([], "part int, block int, start long, n_ids long")
    at, name = fs.FileSystem.from_uri(f"{folder}/frequencies")
    at.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with at.open_output_stream(name) as f:
        f.write(Table.of_counts(counts["id"].to_numpy(), counts["n"].to_numpy()).to_bytes())
    width = int(counts["width"].max())
    blocks = told.where("part >= 0").repartition(ranges.parts, "part").sortWithinPartitions("part", "doc_id", "ids").mapInArrow(C.lean("rans shards", _write(folder, width)), "part int, block int, n_ids long")
    blocks = scratch.write(blocks, "blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # RANGES rows at most
    before, rows = 0, []
    for r in totals:
        rows.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(spark.createDataFrame(rows, "part int, before long"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    return blocks.withColumn("inside", inside).join(starts, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("start"), "n_ids")


def read(blocks: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """Decodes blocks (part, block, start) in parallel: doc_id, start, ids (little-endian unsigned 32-bit integers). wanted: only these documents, each from the checkpoint before it; blocks without one are not read."""
    spark = blocks.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return blocks.select("part", "block", "start").repartition(tasks).mapInArrow(C.lean("rans shards", _read(folder, None if wanted is None else frozenset(wanted))), "doc_id long, start long, ids binary")
