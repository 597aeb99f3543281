"""Language-model scores: a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Restaurants of words (Teh, A Hierarchical Bayesian Language Model based on Pitman-Yor Processes, 2006): one for each context, the word before (or the beginning of a text), that training has, if only once; a context that training lacks is its parent. All contexts share one parent restaurant. Each table of a context is a customer of the parent.

Restaurants of symbols (with a spelling model as base, as in Mochihashi, Yamada, Ueda, Bayesian Unsupervised Word Segmentation, 2009): the base of the parent is a chain of restaurants of symbols with contexts of 0 to ORDER symbols before; contexts share their parent, the context without its farthest symbol. Each table of the parent of words is a customer of the chain. So a word that training lacks is scored by how its letters follow each other. Symbols are classes of bytes (a class's bytes are equally likely), so the chain has a proven bound: 64 ** (ORDER + 1) cells.

Seating: it begins with a table for each cell (restaurant and dish). In a sweep all customers of a cell leave and sit down again, one after the other; customers beyond the first few in batches of an eighth of those seated. Each cell has PROPOSALS such draws, weighted by the law of seatings: their weighted mean is what probabilities are made of, one drawn by weight is the state that other steps see. A sweep of words seats the parent given the contexts' tables and the chain, then the contexts given the parent (ROUNDS sweeps), then the parent again; the chain is seated anew before the parent (SWEEPS sweeps of its own). Of the chain the last KEPT sweeps are averaged. Within a step other cells' tables are those of the step before. Probabilities use mean tables throughout, so those of a context sum to 1. Discounts of words are estimated from the cells of one and two customers.

Corpus work: a task cuts its texts into chunks of about CHUNK tokens and keeps each in a file of the shared folder. Words are dealt by hash to a part for each WORDS tokens, pairs of words to a part for each PAIRS tokens; a chunk tells a part its distinct words (pairs) as one packed array, and a part answers each chunk with an array of the same order, so rows of a shuffle are arrays, at most one for each chunk and part that have something in common. A pair is told once for each chunk, however often it occurs there: no part is hot. Pairs are told apart by 44 bits of hash within a part (a few in ten million share theirs). Cells of one customer need no seat but their own, so later sweeps move only pairs that occur twice or more. Nothing but the chain is sent to all, and numbers of parts follow the number of tokens, so scores don't depend on how the input is partitioned; arrays are in order of hash or of word and each part has its own seed, so a repeated task gives the same again.

Tokens: words of the text with A-Z in lower case, then one end (the empty word of the chain). Nulls: a null text is empty and has the end alone; a null doc_id is of the training part. Rows that repeat count each time and get equal scores. Long texts are whole in a chunk. An empty table gives an empty result; without training rows the model is the uniform base.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER, SYMBOLS = 3, 64
DISCOUNTS, STRENGTH = (0.2, 0.4, 0.6, 0.7), 1.0
SWEEPS, KEPT, ROUNDS = 6, 3, 1
#: Customers from which a context has a restaurant: without any it is its parent, so this leaves nothing out.
LEAST = 1
PROPOSALS, UNIT = 6, 64
CHUNK, WORDS, PAIRS = 6_000_000, 8_000_000, 4_000_000
FOLDS, HELD = 7, 2
KEY = np.uint64(44)
#: Tasks at most that read chunks or parts.
TASKS = 20_000


def classes() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each byte (0 is the end of a word), and the bytes in each symbol."""
    of = np.full(256, 40)
    for i in range(26):
        of[ord("a") + i] = 1 + i
    of[ord("0") : ord("9") + 1] = 27
    for i, c in enumerate(".,!?*$%&#|-'"):
        of[ord(c)] = 28 + i
    of[:32] = 41
    of[0x80:0xC0] = 44 + (np.arange(64) >> 2)
    of[0xC0:] = 43
    of[0xC3] = 42
    return of, np.bincount(of, minlength=SYMBOLS)


OF, SIZES = classes()
SIZES[0] = 1
USED = int((SIZES > 0).sum())


def codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol of each word, its end included: the word, context and symbol as one number, log10 of the share of the byte in its symbol."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    begins = np.cumsum(sizes + ORDER + 1) - sizes - ORDER - 1
    line = np.zeros(int(sizes.sum()) + (ORDER + 1) * len(words), np.int64)
    word = np.repeat(np.arange(len(words)), sizes + 1)
    ends = np.cumsum(sizes + 1)
    at = np.arange(len(word)) - np.repeat(ends - sizes - 1, sizes + 1) + np.repeat(begins, sizes + 1) + ORDER
    inner = np.ones(len(word), bool)
    inner[ends - 1] = False
    line[at[inner]] = OF[flat]
    code = np.zeros(len(word), np.int64)
    for k in range(ORDER, -1, -1):
        code = code * SYMBOLS + line[at - k]
    return word, code, -np.log10(SIZES[line[at]])


def propose(customers: np.ndarray, base: np.ndarray, discount: float, strength: float, others: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Tables of cells of two customers or more that sit down one after the other, and the log of how much likelier the law has them than this draw.

    Given the dish, a seating's weight is the product of its steps' weights (a new table: (strength + discount * all tables) * base, an old one: customers - discount * tables), not of its steps' chances: what a step leaves to those after it counts too. A new table makes each later step's weights less by about discount / customers, so the draw holds new tables back by that much, and what is left of the difference is the weight.
    """
    seated, tables, log = np.ones(len(customers), np.int64), np.ones(len(customers), np.int64), np.zeros(len(customers))
    live = np.arange(len(customers))
    while len(live):
        all_, n, t, b = customers[live], seated[live], tables[live], base[live]
        back = ((n + 1 - discount * t) / (all_ + 1 - discount * t)) ** (discount * (1 - b))
        new, old = (strength + discount * (others[live] + t)) * b * back, n - discount * t
        come = np.minimum(all_ - n, np.maximum(1, n // 8))
        opened = rng.binomial(come, np.clip(new / (new + old), 0, 1))
        log[live] += come * np.log(new + old) - opened * np.log(back)
        tables[live] = t + opened
        seated[live] = n + come
        live = live[n + come < all_]
    return tables, log


def seat(customers: np.ndarray, base: np.ndarray, discount: float, strength: float, others: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each cell after its customers have sat down again: the mean, in parts of UNIT, and one seating. base: the dish's probability in the parent; others: tables of the restaurant's other dishes. Each cell has PROPOSALS draws, weighted by the law."""
    now = np.minimum(customers, 1).astype(np.int64)
    kept, many = UNIT * now, np.flatnonzero(customers > 1)
    for i in range(0, len(many), 1 << 17):
        at = many[i : i + (1 << 17)]
        tables, log = (np.stack(x) for x in zip(*(propose(customers[at], base[at], discount, strength, others[at], rng) for _ in range(PROPOSALS)), strict=True))
        w = np.exp(log - log.max(axis=0))
        w /= w.sum(axis=0)
        kept[at] = np.rint(UNIT * (w * tables).sum(axis=0)).astype(np.int64)
        pick = np.minimum((np.cumsum(w, axis=0) < rng.random(len(at))).sum(axis=0), PROPOSALS - 1)
        now[at] = tables[pick, np.arange(len(at))]
    return kept, now


class Chain:
    """The spelling model. cells: numbers of context and symbol; n: customers."""

    def __init__(self, cells: np.ndarray, n: np.ndarray, seed: int = 1):
        rng, levels = np.random.default_rng(seed), []
        for k in range(ORDER, -1, -1):  # level k: contexts of k symbols; its cells are the last k + 1 symbols
            levels.append((C.distinct(cells % SYMBOLS ** (k + 1)), k))
        self.levels = levels[::-1]
        tables = [np.minimum(1, np.ones(len(c), np.int64)) for c, _ in self.levels]
        order = np.argsort(cells)
        top = n[order].astype(np.int64)
        total = np.zeros((SYMBOLS**ORDER, SYMBOLS), np.float32)  # the one array of all cells; it is filled in place, in blocks
        if not len(cells):
            total += self._uniform(0).astype(np.float32)
        for sweep in range(SWEEPS if len(cells) else 0):
            customers: list[np.ndarray] = [top] * (ORDER + 1)
            for k in range(ORDER - 1, -1, -1):
                c, above = self.levels[k][0], self.levels[k + 1][0]
                customers[k] = np.bincount(np.searchsorted(c, above % SYMBOLS ** (k + 1)), tables[k + 1], len(c)).astype(np.int64)
            p = self._uniform(0)
            for k, (c, _) in enumerate(self.levels):
                context = c // SYMBOLS
                size = SYMBOLS**k
                base = p
                parent = base[c % SYMBOLS ** max(1, k)]
                sums = np.bincount(context, tables[k], size)
                _, tables[k] = seat(customers[k], parent, DISCOUNTS[k], STRENGTH, sums[context] - tables[k], rng)
                sums, all_customers = np.bincount(context, tables[k], size), np.bincount(context, customers[k], size)
                share = (STRENGTH + DISCOUNTS[k] * sums) / (STRENGTH + all_customers)
                own = (customers[k] - DISCOUNTS[k] * tables[k]) / (STRENGTH + all_customers[context])
                above = base.reshape(-1, SYMBOLS)
                if k < ORDER:
                    p = (share[:, None] * np.tile(above, (size // len(above), 1))).reshape(-1)
                    p[c] += own
                elif sweep >= SWEEPS - KEPT:
                    for i in range(0, size, len(above)):
                        total[i : i + len(above)] += share[i : i + len(above), None] * above
                    total.reshape(-1)[c] += own
        total /= KEPT if len(cells) else 1
        self.log10 = np.log10(np.maximum(total, 1e-30, out=total), out=total).reshape(-1)

    @staticmethod
    def _uniform(k: int) -> np.ndarray:
        return np.tile((SIZES > 0) / USED, SYMBOLS**k)


def spell(log10: np.ndarray, words: list[bytes]) -> np.ndarray:
    """log10 of the chain's probability of each word."""
    word, code, share = codes(words)
    return np.bincount(word, log10[code] + share, len(words))


def pack(a: np.ndarray) -> bytes:
    """An array of numbers from 0 on (the least width that holds them) or of floats, compressed."""
    kind = "f4" if a.dtype.kind == "f" else next(k for k in ("u1", "u2", "u4", "u8") if not len(a) or int(a.max()) < 1 << 8 * np.dtype(k).itemsize)
    return kind.encode() + zstandard.compress(a.astype(f"<{kind}").tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    a = np.frombuffer(zstandard.decompress(data[2:]), f"<{data[:2].decode()}")
    return a.astype(np.float64 if a.dtype.kind == "f" else np.int64 if a.dtype.itemsize < 8 else np.uint64)


def coarse(x: np.ndarray) -> np.ndarray:
    """Logarithms in steps of 0.15 %, for what only steers sampling."""
    return np.clip(np.rint(np.log(np.maximum(x, 1e-26)) * 700 + 42_000), 0, 65_535).astype(np.int64)


def fine(q: np.ndarray) -> np.ndarray:
    return np.exp((q - 42_000) / 700)


def save(folder: str, name: str, **blobs: bytes) -> None:
    """A small file of named bytes. Tasks write under a name of their own and rename, so a repeated task leaves the same file."""
    at, root = fs.FileSystem.from_uri(folder)
    at.create_dir(root, recursive=True)
    table, own = pa.table({k: pa.array([v], pa.large_binary()) for k, v in blobs.items()}), f"{root}/.{uuid.uuid4().hex}"
    with at.open_output_stream(own, compression=None) as raw, pa.ipc.new_file(raw, table.schema) as f:
        f.write_table(table)
    at.move(own, f"{root}/{name}")


def load(folder: str, name: str) -> dict[str, bytes]:
    at, root = fs.FileSystem.from_uri(folder)
    with at.open_input_file(f"{root}/{name}") as raw:
        return {k: v[0] for k, v in pa.ipc.open_file(raw).read_all().to_pydict().items()}


def dealt(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, begin, end) of an ascending array of parts; of an empty one nothing."""
    numbers, begin = np.unique(part, return_index=True)
    return list(zip(numbers.tolist(), begin.tolist(), [*begin.tolist(), len(part)][1:], strict=True))


def table(columns: str, rows: list[tuple]) -> pa.Table:
    """Rows by names and types, such as "part long, data binary"."""
    types = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.table({name: pa.array([r[i] for r in rows], types[kind]) for i, (name, kind) in enumerate(x.split() for x in columns.split(", "))})


class Chunk:
    """A chunk's file: its texts as numbers of its words (0: the end, and as a context the beginning), and in side files what parts have answered."""

    def __init__(self, folder: str, number: int, word_parts: int):
        self.folder, self.number = folder, number
        own = load(folder, f"chunk-{number}")
        self.words = zstandard.decompress(own["words"]).split(b" ")
        self.size, self.lengths, self.held, self.now = len(self.words), unpack(own["lengths"]), unpack(own["held"]).astype(bool), unpack(own["tokens"])
        self.ids, self.before = np.frombuffer(own["ids"], np.int64), np.append(0, self.now[:-1])
        self.known = unpack(own["known"]).astype(bool)
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, self.size)
        part = (self.hash % np.uint64(word_parts)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")
        self.parts = dealt(part[self.order])

    def answer(self, rows: pa.Table, column: str) -> np.ndarray:
        """A value for each word from the parts' answers."""
        x = _joined(rows, column)
        out = np.empty_like(x)
        out[self.order] = x
        return out

    def tell(self, *values: np.ndarray) -> list[tuple]:
        return [(p, self.number, *(pack(v[self.order[a:b]]) for v in values)) for p, a, b in self.parts]

    def count(self) -> np.ndarray:
        """Training tokens of each word."""
        return np.bincount(self.now[~np.repeat(self.held, self.lengths)], minlength=self.size)

    def save(self, name: str, a: np.ndarray) -> None:
        save(self.folder, f"{name}-{self.number}", data=pack(a))

    def load(self, name: str) -> np.ndarray:
        return unpack(load(self.folder, f"{name}-{self.number}")["data"])

    def codes(self) -> np.ndarray:
        return self.before * self.size + self.now

    def pairs(self, counts: np.ndarray, codes: np.ndarray, pair_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct codes in ascending order: places of those whose context has a restaurant, by part and key; the parts; the keys."""
        at = np.flatnonzero(counts[codes // self.size] >= LEAST)
        h = C.mix(C.mix(self.hash[codes[at] // self.size]) * np.uint64(0x9E3779B97F4A7C15) + self.hash[codes[at] % self.size])
        key, part = h & ((np.uint64(1) << KEY) - np.uint64(1)), (h >> KEY) % np.uint64(pair_parts)
        order = np.argsort(part << KEY | key)
        return at[order], part[order].astype(np.int64), key[order]


def _cut(folder: str):
    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        number, ids, held, tokens, pending = {b"": 0}, [], [], [], 0

        def close():
            lengths = np.array([len(t) for t in tokens], np.int64)
            save(folder, f"chunk-{task * 10_000 + made}", words=zstandard.compress(b" ".join(number), 1), lengths=pack(lengths), held=pack(np.array(held, np.int64)), tokens=pack(np.concatenate(tokens)), ids=np.array([i or 0 for i in ids], np.int64).tobytes(), known=pack(np.array([i is not None for i in ids], np.int64)))
            return pa.RecordBatch.from_pydict({"chunk": pa.array([task * 10_000 + made]), "tokens": pa.array([int(lengths.sum())])})

        for batch in batches:
            for doc_id, out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = C.words_of(text)
                t = np.zeros(len(words) + 1, np.int32)
                t[:-1] = [number.setdefault(w, len(number)) for w in words]
                tokens.append(t)
                ids.append(doc_id)
                held.append(out)
                pending += len(t)
                if pending >= CHUNK:
                    yield close()
                    made += 1
                    number, ids, held, tokens, pending = {b"": 0}, [], [], [], 0
        if ids:
            yield close()

    return run


TOLD_WORDS, TOLD_PAIRS, ANSWER = "part long, chunk long, words binary, n binary", "part long, chunk long, keys binary, n binary, p binary, tables binary", "part long, chunk long, data binary, more binary, a long, b long"


def _tell_words(folder: str, word_parts: int):
    def run(batches):
        for batch in batches:
            for number in batch.column("chunk").to_pylist():
                c = Chunk(folder, number, word_parts)
                n = c.count()
                rows = [(p, number, zstandard.compress(b" ".join([c.words[i] for i in c.order[a:b]]), 1), pack(n[c.order[a:b]])) for p, a, b in c.parts]
                yield from table(TOLD_WORDS, rows).to_batches()

    return run


def _count_words(folder: str):
    """A part of the words: their training tokens, for each chunk in its own order. The part's words are kept in order."""

    def run(rows: pa.Table) -> pa.Table:
        rows, part = rows.sort_by("chunk"), rows.column("part")[0].as_py()
        told = [zstandard.decompress(x).split(b" ") for x in rows.column("words").to_pylist()]
        words = sorted(set().union(*told))
        number = {w: i for i, w in enumerate(words)}
        place = [np.fromiter(map(number.__getitem__, x), np.int64, len(x)) for x in told]
        n = np.zeros(len(words), np.int64)
        for at, x in zip(place, rows.column("n").to_pylist(), strict=True):
            n[at] += unpack(x)
        chunks = rows.column("chunk").to_pylist()
        save(folder, f"words-{part}", words=zstandard.compress(b" ".join(words), 1), n=pack(n), chunks=pack(np.array(chunks)), sizes=pack(np.array([len(x) for x in place])), places=pack(np.concatenate(place)))
        out = [(part, c, pack(n[at]), None, None, None) for c, at in zip(chunks, place, strict=True)]
        return table(ANSWER, [*out, (part, -1, None, None, int(n.sum()), int((n > 0).sum()))])

    return run


def _tell_pairs(folder: str, word_parts: int, pair_parts: int):
    """A chunk's distinct pairs with their training tokens."""

    def run(rows: pa.Table) -> pa.Table:
        c = Chunk(folder, rows.column("chunk")[0].as_py(), word_parts)
        counts = c.answer(rows, "data")
        c.save("counts", counts)
        codes, back = np.unique(c.codes(), return_inverse=True)
        n = np.bincount(back[~np.repeat(c.held, c.lengths)], minlength=len(codes))
        at, part, key = c.pairs(counts, codes, pair_parts)
        return table(TOLD_PAIRS, [(p, c.number, pack(np.diff(key[a:b], prepend=np.uint64(0))), pack(n[at[a:b]]), None, None) for p, a, b in dealt(part)])

    return run


class Part:
    """What chunks have told a part of the pairs, in order of chunks: the distinct pairs in order of keys, and each told one's place among them."""

    def __init__(self, rows: pa.Table):
        self.rows, self.number = rows.sort_by("chunk"), rows.column("part")[0].as_py()
        told = [np.cumsum(unpack(x).astype(np.uint64)) for x in self.rows.column("keys").to_pylist()]
        self.ends = np.cumsum([len(x) for x in told])
        self.keys, first, self.place = np.unique(np.concatenate(told), return_index=True, return_inverse=True)
        self.first = np.zeros(len(self.place), bool)  # one chunk speaks for a pair where all are added up
        self.first[first] = True
        self.n = np.bincount(self.place, self.told("n"), len(self.keys)).astype(np.int64)

    def told(self, column: str) -> np.ndarray:
        return np.concatenate([unpack(x) for x in self.rows.column(column).to_pylist()])

    def answer(self, *values: np.ndarray) -> list[tuple]:
        """For each chunk a value (or two) for each of its pairs."""
        out = []
        for chunk, a, b in zip(self.rows.column("chunk").to_pylist(), [0, *self.ends[:-1].tolist()], self.ends.tolist(), strict=True):
            data = [pack(v[a:b]) for v in values]
            out.append((self.number, chunk, data[0], data[1] if len(data) > 1 else None, None, None))
        return out


def _count_pairs(rows: pa.Table) -> pa.Table:
    """Of each pair whether it has none, one or more customers (and, for the chunk that speaks for it, 3 more)."""
    p = Part(rows)
    seen = np.minimum(p.n, 2)[p.place] + 3 * p.first
    return table(ANSWER, [*p.answer(seen), (p.number, -1, None, None, int((p.n == 1).sum()), int((p.n == 2).sum()))])


def _sums(c: Chunk, codes: np.ndarray, at: np.ndarray, kept: np.ndarray, tables: np.ndarray) -> list[tuple]:
    """To the words' parts: tables (means in parts of UNIT) of each context, and customers that each word brings to the parent."""
    of = np.bincount(codes[at] // c.size, kept, c.size).astype(np.int64)
    return c.tell(of, np.bincount(codes[at] % c.size, tables, c.size).astype(np.int64))


TOLD_SUMS = "part long, chunk long, kept binary, came binary"


def _first_sums(folder: str, word_parts: int, pair_parts: int):
    """After counting: a table for each pair that training has."""

    def run(rows: pa.Table) -> pa.Table:
        c = Chunk(folder, rows.column("chunk")[0].as_py(), word_parts)
        codes = C.distinct(c.codes())
        at, _, _ = c.pairs(c.load("counts"), codes, pair_parts)
        seen = _joined(rows, "data")
        c.save("seen", seen)
        one = (seen > 3).astype(np.int64)
        return table(TOLD_SUMS, _sums(c, codes, at, UNIT * one, one))

    return run


def _joined(rows: pa.Table, column: str) -> np.ndarray:
    """Parts' answers about pairs, by part: the order in which they were told."""
    x = [unpack(v) for v in rows.sort_by("part").column(column).to_pylist() if v is not None]
    return np.concatenate(x) if x else np.zeros(0, np.int64)


def _add_up(folder: str, sweep: int):
    """A part of the words adds up what the chunks have told; totals: customers of the parent, words of one and of two."""

    def run(rows: pa.Table) -> pa.Table:
        part, own = rows.column("part")[0].as_py(), load(folder, f"words-{rows.column('part')[0].as_py()}")
        places = np.split(unpack(own["places"]), np.cumsum(unpack(own["sizes"]))[:-1])
        number = {c: i for i, c in enumerate(unpack(own["chunks"]).tolist())}
        n = len(unpack(own["n"]))
        kept, came = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for chunk, x, y in zip(rows.column("chunk").to_pylist(), rows.column("kept").to_pylist(), rows.column("came").to_pylist(), strict=True):
            kept[places[number[chunk]]] += unpack(x)
            came[places[number[chunk]]] += unpack(y)
        save(folder, f"tables-{part}-{sweep}", kept=pack(kept), came=pack(came))
        return table("came long, once long, twice long", [(int(came.sum()), int((came == 1).sum()), int((came == 2).sum()))])

    return run


def _above(folder: str, part: int, own: dict[str, bytes], sweep: int) -> np.ndarray:
    """Tables of a part's words in the parent before a sweep."""
    return unpack(load(folder, f"parent-{part}-{sweep - 1}")["above"]) if sweep else np.minimum(unpack(own["n"]), 1)


def _cells(folder: str, sweep: int):
    """Customers of the spelling chain: each word as often as it has tables in the parent."""

    def run(batches):
        total = np.zeros(SYMBOLS ** (ORDER + 1), np.int64)
        for batch in batches:
            for part in batch.column("part").to_pylist():
                own = load(folder, f"words-{part}")
                words, tables = zstandard.decompress(own["words"]).split(b" "), _above(folder, part, own, sweep)
                for i in range(0, len(words), 50_000):
                    some = np.flatnonzero(tables[i : i + 50_000]) + i
                    word, code, _ = codes([words[j] for j in some.tolist()])
                    np.add.at(total, code, tables[some][word])
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            yield pa.record_batch([pa.array(at[i : i + (1 << 16)]), pa.array(total[at[i : i + (1 << 16)]])], ["cell", "n"])

    return run


def _seat_parent(folder: str, shared, discount: float, above: float, sweep: int):
    """The parent of words given the chain and the contexts' tables; totals: tables, of the last seating and of all that are kept."""

    def run(batches):
        for batch in batches:
            for part in batch.column("part").to_pylist():
                own = load(folder, f"words-{part}")
                words, came, up = zstandard.decompress(own["words"]).split(b" "), unpack(load(folder, f"tables-{part}-{sweep}")["came"]), _above(folder, part, own, sweep)
                base = np.concatenate([10.0 ** spell(shared.value, words[i : i + 50_000]).clip(-300, 0) for i in range(0, len(words), 50_000)])
                kept, up = seat(came, base, discount, STRENGTH, above - up, np.random.default_rng([1, sweep, part]))
                save(folder, f"parent-{part}-{sweep}", base=pack(base), kept=pack(kept), above=pack(up))
                yield pa.RecordBatch.from_pydict({"above": pa.array([int(up.sum())]), "kept": pa.array([int(kept.sum())])})

    return run


def _given(n, kept, base, discount: float, tables, customers):
    """Probabilities of dishes: n customers at kept / UNIT tables; base: in the parent; tables, customers: of the restaurant."""
    return (n - discount * kept / UNIT + (STRENGTH + discount * tables) * base) / (STRENGTH + customers)


def _answer_words(folder: str, discount: float, tables: float, customers: float, sweep: int):
    """For each chunk its words' probabilities in the parent, and their tables as contexts (parts of UNIT)."""

    def run(batches):
        for batch in batches:
            for part in batch.column("part").to_pylist():
                own, sums, parent = load(folder, f"words-{part}"), load(folder, f"tables-{part}-{sweep}"), load(folder, f"parent-{part}-{sweep}")
                p = _given(unpack(sums["came"]), unpack(parent["kept"]), unpack(parent["base"]), discount, tables, customers)
                of, places = unpack(sums["kept"]), unpack(own["places"])
                ends = np.cumsum(unpack(own["sizes"]))
                for chunk, a, b in zip(unpack(own["chunks"]).tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    yield from table(ANSWER, [(part, chunk, pack(np.log10(p[places[a:b]])), pack(of[places[a:b]]), None, None)]).to_batches()

    return run


def _tell_again(folder: str, word_parts: int, pair_parts: int):
    """The pairs of two customers or more, with the word's probability in the parent and the context's tables."""

    def run(rows: pa.Table) -> pa.Table:
        c = Chunk(folder, rows.column("chunk")[0].as_py(), word_parts)
        p, of = 10.0 ** c.answer(rows, "data"), c.answer(rows, "more")
        codes, back = np.unique(c.codes(), return_inverse=True)
        n = np.bincount(back[~np.repeat(c.held, c.lengths)], minlength=len(codes))
        at, part, key = c.pairs(c.load("counts"), codes, pair_parts)
        many = c.load("seen") % 3 == 2
        at, part, key = at[many], part[many], key[many]
        p, of = coarse(p)[codes[at] % c.size], coarse(of / UNIT)[codes[at] // c.size]
        return table(TOLD_PAIRS, [(q, c.number, pack(np.diff(key[a:b], prepend=np.uint64(0))), pack(n[at[a:b]]), pack(p[a:b]), pack(of[a:b])) for q, a, b in dealt(part)])

    return run


def _seat_pairs(folder: str, discount: float, sweep: int):
    """The contexts given the parent: means of seatings (as customers less the discount, for scoring) and, from the chunk that speaks for a pair, tables."""

    def run(rows: pa.Table) -> pa.Table:
        x = Part(rows)
        p, of, first = fine(x.told("p"))[x.first], fine(x.told("tables"))[x.first], x.place[x.first]
        base, others, now = np.empty(len(x.keys)), np.empty(len(x.keys)), np.ones(len(x.keys), np.int64)
        base[first], others[first] = p, of
        if sweep:
            now = unpack(load(folder, f"pairs-{x.number}-{sweep - 1}")["tables"])
        kept, now = seat(x.n, base, discount, STRENGTH, np.maximum(others - now, 0), np.random.default_rng([2, sweep, x.number]))
        save(folder, f"pairs-{x.number}-{sweep}", tables=pack(now))
        speaks = np.where(x.first, kept[x.place] << 24 | now[x.place], 0)  # a cell of 2 ** 24 tables would need more customers than a part has
        return table(ANSWER, x.answer((x.n - discount * kept / UNIT)[x.place], speaks))

    return run


def _sums_again(folder: str, word_parts: int, pair_parts: int):
    def run(rows: pa.Table) -> pa.Table:
        c = Chunk(folder, rows.column("chunk")[0].as_py(), word_parts)
        codes = C.distinct(c.codes())
        at, _, _ = c.pairs(c.load("counts"), codes, pair_parts)
        seen = c.load("seen")
        c.save("seats", _joined(rows, "data").astype(np.float64))
        speaks, one = _joined(rows, "more").astype(np.int64), (seen == 4).astype(np.int64)
        kept, now = UNIT * one, one
        kept[seen % 3 == 2], now[seen % 3 == 2] = speaks >> 24, speaks & (2**24 - 1)
        return table(TOLD_SUMS, _sums(c, codes, at, kept, now))

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(folder: str, word_parts: int, pair_parts: int, discount: float, train_tokens: int, kinds: int):
    def run(rows: pa.Table) -> pa.Table:
        c = Chunk(folder, rows.column("chunk")[0].as_py(), word_parts)
        counts = c.load("counts")
        p, of = 10.0 ** c.answer(rows, "data"), c.answer(rows, "more") / UNIT
        codes, back = np.unique(c.codes(), return_inverse=True)
        at, _, _ = c.pairs(counts, codes, pair_parts)
        seen, seats = c.load("seen") % 3, np.zeros(len(codes))
        own = np.where(seen == 1, 1 - discount, 0.0)
        own[seen == 2] = c.load("seats")
        seats[at] = own
        before, now = codes // c.size, codes % c.size
        customers = np.where(counts >= LEAST, counts, 0)[before]
        q = (seats + (STRENGTH + discount * of[before]) * p[now]) / (STRENGTH + customers)
        base = np.log10(counts + 1.0) - math.log10(train_tokens + 1 * (kinds + 1))
        text = np.repeat(np.arange(len(c.lengths)), c.lengths)
        add = lambda x: np.bincount(text, x, len(c.lengths))
        known = add(counts[c.now] > 0).astype(np.int64)
        ids = pa.array(c.ids, mask=~c.known)
        return pa.table([ids, pa.array(c.held), pa.array(c.lengths), pa.array(known), pa.array(np.full(len(known), train_tokens)), pa.array(add(base[c.now])), pa.array(add(np.log10(np.maximum(q, 1e-300))[back]))], names=[x.split()[0] for x in SCORED.split(", ")])

    return run


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / max(1, once + 2 * twice)))


class Model:
    """The steps over the chunks of a folder. After seat() the last tables are in the folder's files."""

    def __init__(self, docs: DataFrame, scratch: C.Scratch):
        """docs: doc_id, held_out, text as bytes."""
        self.spark, self.scratch, self.folder = docs.sparkSession, scratch, scratch.folder("chunks")
        chunks = scratch.write(docs.mapInArrow(_cut(self.folder), "chunk long, tokens long"), "chunked")
        self.n, tokens = chunks.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        self.word_parts, self.pair_parts = max(1, -(-tokens // WORDS)), max(1, -(-tokens // PAIRS))
        self.of_words, self.of_pairs = (self.folder, self.word_parts), (self.folder, self.word_parts, self.pair_parts)
        self.chunks = chunks.select("chunk").repartitionByRange(self.tasks(self.n), "chunk")
        self.parts = self.spark.range(0, self.word_parts if self.n else 0, 1, self.tasks(self.word_parts)).select(F.col("id").alias("part"))

    @staticmethod
    def tasks(n: int) -> int:
        return max(1, min(n, TASKS))

    def by_chunk(self, rows: DataFrame, step, schema: str) -> DataFrame:
        """A step for every chunk, those without an answer too."""
        kinds = dict(rows.dtypes)
        every = self.chunks.select(*(F.col(c) if c == "chunk" else F.lit(-1).cast("long").alias(c) if c == "part" else F.lit(None).cast(kinds[c]).alias(c) for c in rows.columns))
        return rows.where("chunk >= 0").unionAll(every).repartition(self.tasks(self.n), "chunk").groupBy("chunk").applyInArrow(step, schema)

    def by_part(self, rows: DataFrame, step, schema: str, parts: int) -> DataFrame:
        return rows.repartition(self.tasks(parts), "part").groupBy("part").applyInArrow(step, schema)

    def add_up(self, sums: DataFrame, sweep: int) -> None:
        told = self.scratch.write(self.by_part(sums, _add_up(self.folder, sweep), "came long, once long, twice long", self.word_parts), "sums")
        came, once, twice = (x or 0 for x in told.agg(F.sum("came"), F.sum("once"), F.sum("twice")).first())
        self.came, self.upper = came, _discount(once, twice)

    def seat_parent(self, sweep: int) -> None:
        found = self.parts.mapInArrow(_cells(self.folder, sweep), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # SYMBOLS ** (ORDER + 1) rows at most
        chain = self.spark.sparkContext.broadcast(Chain(found["cell"].to_numpy().astype(np.int64), found["n"].to_numpy(), seed=sweep + 1).log10)
        del found
        told = self.scratch.write(self.parts.mapInArrow(_seat_parent(self.folder, chain, self.upper, float(self.above), sweep), "above long, kept long"), "parent")
        self.above, self.kept = (x or 0 for x in told.agg(F.sum("above"), F.sum("kept")).first())
        chain.destroy()  # its words are written
        self.sweep = sweep

    def words(self) -> DataFrame:
        return self.parts.mapInArrow(_answer_words(self.folder, self.upper, self.kept / UNIT, float(self.came), self.sweep), ANSWER)

    def seat(self, rounds: int = ROUNDS) -> None:
        write, totals = self.scratch.write, lambda df: [x or 0 for x in df.where("chunk = -1").agg(F.sum("a"), F.sum("b")).first()]
        counted = write(self.by_part(self.chunks.mapInArrow(_tell_words(*self.of_words), TOLD_WORDS), _count_words(self.folder), ANSWER, self.word_parts), "words")
        self.train_tokens, self.kinds = totals(counted)
        self.above = self.kinds
        seen = write(self.by_part(self.by_chunk(counted, _tell_pairs(*self.of_pairs), TOLD_PAIRS), _count_pairs, ANSWER, self.pair_parts), "pairs")
        self.lower = _discount(*totals(seen))
        self.add_up(self.by_chunk(seen, _first_sums(*self.of_pairs), TOLD_SUMS), 0)
        self.seat_parent(0)
        for sweep in range(rounds):
            told = self.by_chunk(self.words(), _tell_again(*self.of_pairs), TOLD_PAIRS)
            found = self.by_part(told, _seat_pairs(self.folder, self.lower, sweep), ANSWER, self.pair_parts)
            self.add_up(self.by_chunk(found, _sums_again(*self.of_pairs), TOLD_SUMS), sweep + 1)
            self.seat_parent(sweep + 1)

    def score(self) -> DataFrame:
        return self.by_chunk(self.words(), _score(*self.of_pairs, self.lower, self.train_tokens, self.kinds), SCORED)


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the model's probability), perplexity (by token)."""
    spark = docs.sparkSession
    C.prepare(spark)
    docs = C.id_and_text(docs, key, text)
    is_held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    model = Model(docs.select("doc_id", is_held.alias("held_out"), "text"), C.Scratch(spark, "hpyp"))
    model.seat()
    return model.score().withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
