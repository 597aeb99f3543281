"""Byte-level BPE encoding and decoding of whole texts: speculate and verify.

Encoding of a word: greedy longest match proposes tokens. A sequence of tokens is the encoding of its bytes exactly if each token is the encoding of its own bytes and each adjacent pair that of the pair's bytes. All adjacent pairs of a batch's new words are tested at once with arrays; only words with a failing pair or token undergo exact merging.

The tokenizer is read from a file of the tokenizers library (byte-level BPE, no normaliser); its path is a parameter. Special tokens in a text become their ids, as the library has it by default.
Nulls and empty texts have no ids and decode to the empty text. Texts of any length are cut into chunks and words, so no step works on a whole text but concatenation. Every row of the input gives a row; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common as C
from .chunks import SPACE, Chunked, chunk_of

#: The pattern of the byte-level pre-tokenizer (fixed by the file format).
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_FAR = np.int64(1) << np.int64(40)
#: Bytes of words that are merged by list, and the rank of pairs that don't merge.
SHORT, NONE = 64, 1 << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Tokens are numbered inside by rank: the 256 bytes, then the results of merges in their order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, letters = file["model"]["vocab"], byte_letters()
        plain = lambda token: bytes(map(letters.__getitem__, token))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        names = sorted(letters, key=letters.get) + [a + b for a, b in merges]
        number = {name: i for i, name in enumerate(names)}
        self.bytes = [plain(name) for name in names]
        self.number = {b: i for i, b in enumerate(self.bytes)}
        self.ids = [vocab[name].to_bytes(4, "little") for name in names]
        self.left, self.right = np.arange(len(names)), np.arange(len(names))
        self.rank: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(merges, 256):
            self.left[i], self.right[i] = number[a], number[b]
            self.rank[number[a], number[b]] = i
        keys = self.left[256:] * len(names) + self.right[256:]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], _FAR), np.append(order + 256, _FAR)
        self.longest = max(map(len, self.bytes))
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.text_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, i in vocab.items():
            self.text_of[i] = plain(name)
        for name, i in self.special.items():
            self.text_of[i] = name.encode()
        self.sound = np.full(len(names), -1, np.int8)
        self.sound[:256] = 1
        self.merged = 0
        self.chunked = Chunked(self._encode_chunks)

    def greedy(self, word: bytes) -> list[int]:
        out, at, end, number = [], 0, len(word), self.number
        while at < end:
            stop = min(end, at + self.longest)
            while (t := number.get(word[at:stop])) is None:
                stop -= 1
            out.append(t)
            at = stop
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is the encoding of its bytes: no merge over the boundary comes before those that made the two tokens. Both are taken apart in the reverse order of their merges, and the pieces that touch are looked up."""
        good, live, n = np.ones(len(a), bool), np.arange(len(a)), len(self.left)
        a, b, before = a.copy(), b.copy(), np.full(len(a), _FAR)
        while len(live):
            key = a * n + b
            at = np.searchsorted(self.pair_keys, key)
            clash = (self.pair_keys[at] == key) & (self.pair_ranks[at] < before)
            good[live[clash]] = False
            left_later = a > b
            a_whole, b_whole = self.right[a] == a, self.left[b] == b
            cut_a = (left_later & ~a_whole) | (~left_later & b_whole)
            done = a_whole & b_whole
            before = np.where(cut_a, a, b + 1)
            a, b = np.where(cut_a, self.right[a], a), np.where(cut_a, b, self.left[b])
            keep = ~(clash | done)
            live, a, b, before = live[keep], a[keep], b[keep], before[keep]
        return good

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: again and again the pair of least rank, the leftmost first. Short words keep their pairs' ranks in a list."""
        self.merged += 1
        if len(word) > SHORT:
            return self._merge_long(word)
        tokens, rank = list(word), self.rank.get
        ranks = [rank(pair, NONE) for pair in zip(tokens, tokens[1:], strict=False)]
        while ranks and (r := min(ranks)) != NONE:
            i = ranks.index(r)
            tokens[i] = r
            del tokens[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((tokens[i - 1], r), NONE)
            if i < len(ranks):
                ranks[i] = rank((r, tokens[i + 1]), NONE)
        return tokens

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap, so that long words take little more than linear time."""
        tokens: list[int | None] = list(word)
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap = [(r, i, x) for i, x in enumerate(zip(tokens, tokens[1:], strict=False)) if (r := self.rank.get(x)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x = heapq.heappop(heap)
            j = after[i]
            if tokens[i] is None or j >= len(word) or (tokens[i], tokens[j]) != x:
                continue
            tokens[i], tokens[j] = r, None
            after[i] = k = after[j]
            if k < len(word):
                before[k] = i
                if (s := self.rank.get((r, tokens[k]))) is not None:
                    heapq.heappush(heap, (s, i, (r, tokens[k])))
            if (h := before[i]) >= 0 and (s := self.rank.get((tokens[h], r))) is not None:
                heapq.heappush(heap, (s, h, (tokens[h], r)))
        return [t for t in tokens if t is not None]

    def words(self, words: list[bytes]) -> list[list[int]]:
        out = [self.greedy(w) for w in words]
        flat = np.fromiter((t for x in out for t in x), np.int64)
        word = np.repeat(np.arange(len(out)), [len(x) for x in out])
        used = np.unique(flat)
        for t in used[self.sound[used] < 0].tolist():
            self.sound[t] = self.merge(self.bytes[t]) == [t]
        fails = word[self.sound[flat] == 0]
        inner = word[1:] == word[:-1]
        pairs, back = np.unique(flat[:-1][inner] * len(self.left) + flat[1:][inner], return_inverse=True)
        good = self.compatible(pairs // len(self.left), pairs % len(self.left))[back]
        for i in np.unique(np.append(fails, word[:-1][inner][~good])).tolist():
            out[i] = self.merge(words[i])
        return out

    def _encode_chunks(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [WORD.findall(chunk_of(k)) for k in names]
        words = list(set().union(*cut))
        known = {w: b"".join(map(self.ids.__getitem__, x)) for w, x in zip(words, self.words([w.encode() for w in words]), strict=True)}
        told = [b"".join(map(known.__getitem__, c)) for c in cut]
        return np.frombuffer(b"".join(told), "<u4"), np.fromiter(map(len, told), np.int64, len(told)) // 4

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        plain = [i for i, t in enumerate(texts) if not any(s in t for s in self.special)]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(plain, self.chunked([texts[i] for i in plain]), strict=True):
            out[i] = ids.tobytes()
        for i in set(range(len(texts))).difference(plain):
            parts = self.special_cut.split(texts[i])
            ids = [x.tobytes() for x in self.chunked(parts[::2])]
            for k, s in enumerate(parts[1::2]):
                ids[k] += self.special[s].to_bytes(4, "little")
            out[i] = b"".join(ids)
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    return C.held("bpe", path, lambda: Codec(path))


def _run(path: str):
    def run(batches):
        c = codec(path)

        def coded(batch):  # what it makes goes before the next batch comes
            ids = c.encode_batch([x.decode() for x in batch.column(1).to_pylist()])
            return pa.record_batch([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(c.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

        for batch in batches:
            yield coded(batch)

    return C.lean("bpe", run)


def encode_decode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, ids (binary: little-endian unsigned 32-bit integers), decoded (the text of the ids)."""
    C.prepare(docs.sparkSession)
    return C.id_and_text(docs, key, text).mapInArrow(_run(path), "doc_id long, ids binary, decoded string")
