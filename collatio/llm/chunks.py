"""Texts cut where a byte-level BPE can be cut, so that each distinct chunk is encoded once a worker."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as Unicode has it; \s of the pre-tokenizer's pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A chunk is a run of white space and the run of other characters after it. The pattern's pieces never reach over a boundary from other characters to white space.
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


#: White space other than the space and the line feed.
OTHER = [c for c in map(chr, (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) if c != "\n"]
PAIRS = ("  ", "\n ", "\n\n", " \n")


def odd(text: str) -> bool:
    """Whether a text has white space other than single spaces and line feeds (or U+0000, which marks chunks): most texts haven't."""
    return "\0" in text or any(p in text for p in PAIRS) or any(c in text for c in OTHER)


def keys(text: str) -> list[str]:
    """The chunks of an odd text, each marked by U+0000."""
    return ["\0" + c for c in CHUNK.findall(text)]


def split(texts: list[str]) -> pa.ListArray:
    """The chunks of texts that aren't odd, by key: a word stands for itself after a space; one that begins a line begins with the line feed, one that begins a text is marked."""
    return pc.split_pattern(pa.array(["\0" + t.replace("\n", " \n") for t in texts], pa.string()), " ")


def chunk_of(key: str) -> str:
    return key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key


#: Characters of texts whose chunks are found at once: what is made of them for the while takes some 60 bytes a character.
AT_ONCE = 1 << 20


class Chunked:
    """Encodes texts by a function of distinct chunks (by key), which gives all their ids in one array and how many each has. Known chunks have a number; their ids lie in one array. The cache is emptied beyond keep chunks (about 200 bytes each)."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep: int = 400_000):
        self.encode, self.keep = encode, keep
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.begin, self.size = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def of(self, distinct: list[str]) -> np.ndarray:
        """The numbers of chunks."""
        out = list(map(self.number.get, distinct))
        new = [i for i, x in enumerate(out) if x is None]
        if new:
            if self.number and len(self.number) + len(new) > self.keep:
                self.clear()
                return self.of(distinct)
            names, n = [distinct[i] for i in new], len(self.number)
            ids, sizes = self.encode(names)
            self.ids = self._room(self.ids, self.used + len(ids))
            self.begin, self.size = (self._room(x, n + len(new)) for x in (self.begin, self.size))
            self.ids[self.used : self.used + len(ids)] = ids
            self.size[n : n + len(new)] = sizes
            self.begin[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
            self.number.update(zip(names, range(n, n + len(new)), strict=True))
            for k, i in enumerate(new, n):
                out[i] = k
        return np.array(out, np.int64)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.append(a, np.empty(max(n, 2 * len(a)) - len(a), a.dtype))

    def join(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of chunks, and where each chunk's end."""
        n = self.size[chunks]
        ends = np.cumsum(n)
        places = np.arange(int(n.sum()))
        places += np.repeat(self.begin[chunks] - ends + n, n)
        return self.ids[places], ends

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out, at = [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= AT_ONCE:
                size += len(texts[end])
                end += 1
            out += self._some(texts[at:end])
            at = end
        return out

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        out, strange = [np.empty(0, np.uint32)] * len(texts), [odd(t) for t in texts]
        plain = [i for i, x in enumerate(strange) if not x]
        if plain:
            cut = split([texts[i] for i in plain])
            words = cut.flatten().dictionary_encode()
            ids, ends = self.join(self.of(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()])
            last = ends[cut.offsets.to_numpy()[1:] - 1].tolist()
            for i, a, b in zip(plain, [0, *last], last, strict=False):
                out[i] = ids[a:b]
        if len(plain) < len(texts):
            cut = {i: keys(texts[i]) for i, x in enumerate(strange) if x}
            distinct = list(set().union(*cut.values()))
            numbers = dict(zip(distinct, self.of(distinct).tolist(), strict=True))
            for i, c in cut.items():
                out[i] = self.join(np.array([numbers[k] for k in c], np.int64))[0]
        return out
