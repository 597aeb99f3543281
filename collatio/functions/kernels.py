"""Sequence kernels on bit vectors (Python's integers): edit operations and similarity of two sequences."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

#: Bits of matrix kept for an alignment at once; larger ones are split (Hirschberg, 1975).
MATRIX_BITS = 1 << 29


def _places(pattern: Sequence) -> dict:
    places: dict = {}
    for i, x in enumerate(pattern):
        places[x] = places.get(x, 0) | 1 << i
    return places


def _columns(a: Sequence, b: Sequence):
    """Vertical steps (up, down) of the matrix of a against b, a column for each of b (Myers, 1999; Hyyrö, 2003)."""
    places, mask = _places(a), (1 << len(a)) - 1
    up, down = mask, 0
    for x in b:
        eq = places.get(x, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & mask
        right_up = (down | ~(diagonal | up)) & mask
        right_down = up & diagonal
        shifted = (right_up << 1 | 1) & mask
        up = ((right_down << 1) | ~(diagonal | shifted)) & mask
        down = shifted & diagonal
        yield up, down


def distance(a: Sequence, b: Sequence) -> int:
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    up = down = 0
    for up, down in _columns(a, b):  # noqa: B007
        pass
    return len(b) + up.bit_count() - down.bit_count()


def _last_column(a: Sequence, b: Sequence) -> list[int]:
    """Distances of all beginnings of a to the whole of b."""
    up, down = (1 << len(a)) - 1, 0
    for up, down in _columns(a, b):  # noqa: B007
        pass
    out = [len(b)]
    for i in range(len(a)):
        out.append(out[-1] + (up >> i & 1) - (down >> i & 1))
    return out


def edits(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a least alignment of a (reference) to b.

    The total is exact; among least alignments the walk back from the end prefers a deletion, then an insertion.
    """
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return 0, len(a), len(b)
    if len(a) * len(b) > MATRIX_BITS and len(b) > 1:
        half = len(b) // 2
        head, tail = _last_column(a, b[:half]), _last_column(a[::-1], b[half:][::-1])[::-1]
        cut = min(range(len(a) + 1), key=lambda i: head[i] + tail[i])
        x, y = edits(a[:cut], b[:half]), edits(a[cut:], b[half:])
        return x[0] + y[0], x[1] + y[1], x[2] + y[2]
    columns = list(_columns(a, b))
    i, j, substituted, deleted, inserted = len(a), len(b), 0, 0, 0
    while i and j:
        if columns[j - 1][0] >> (i - 1) & 1:
            deleted += 1
            i -= 1
        elif j > 1 and columns[j - 2][1] >> (i - 1) & 1:
            inserted += 1
            j -= 1
        else:
            substituted += a[i - 1] != b[j - 1]
            i -= 1
            j -= 1
    return substituted, deleted + i, inserted + j


#: Alignments that share one integer, and the bits of matrix up to which an alignment may.
LANES, LANE_BITS = 64, 1 << 18


def _lanes(pairs: list[tuple[Sequence, Sequence]]) -> list[tuple[int, int, int]]:
    """edits() of pairs that begin and end differently: each has a lane of whole bytes of one integer, with a bit to spare that takes the carry."""
    width = max(len(a) for a, _ in pairs) // 8 + 1
    none, lane = bytes(width), [{x: v.to_bytes(width, "little") for x, v in _places(a).items()} for a, _ in pairs]
    joined = lambda parts: int.from_bytes(b"".join(parts), "little")
    mask = joined(((1 << len(a)) - 1).to_bytes(width, "little") for a, _ in pairs)
    first, size = joined([(1).to_bytes(width, "little")] * len(pairs)), width * len(pairs)
    up, down, ups, downs = mask, 0, [], []
    for j in range(max(len(b) for _, b in pairs)):
        eq = joined([at.get(b[j], none) if j < len(b) else none for at, (_, b) in zip(lane, pairs, strict=True)])
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & mask
        right_up = down | (mask ^ ((diagonal | up) & mask))
        right_down = up & diagonal
        shifted = (right_up << 1 | first) & mask
        up = ((right_down << 1) & mask) | (mask ^ ((diagonal | shifted) & mask))
        down = shifted & diagonal
        ups.append(up.to_bytes(size, "little"))
        downs.append(down.to_bytes(size, "little"))
    out = []
    for k, (a, b) in enumerate(pairs):
        at, i, j, substituted, deleted, inserted = k * width, len(a), len(b), 0, 0, 0
        while i and j:
            byte, bit = at + (i - 1 >> 3), 1 << (i - 1 & 7)
            if ups[j - 1][byte] & bit:
                deleted += 1
                i -= 1
            elif j > 1 and downs[j - 2][byte] & bit:
                inserted += 1
                j -= 1
            else:
                substituted += a[i - 1] != b[j - 1]
                i -= 1
                j -= 1
        out.append((substituted, deleted + i, inserted + j))
    return out


def edits_of(pairs: list[tuple[Sequence, Sequence]]) -> list[tuple[int, int, int]]:
    """edits() of each pair. Those of short sequences are aligned side by side, about as long ones together."""
    out, waiting = [(0, 0, 0)] * len(pairs), []
    for k, (a, b) in enumerate(pairs):
        if a == b:
            continue
        start, end = 0, 0
        while start < min(len(a), len(b)) and a[start] == b[start]:
            start += 1
        while end < min(len(a), len(b)) - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
            end += 1
        a, b = a[start : len(a) - end], b[start : len(b) - end]
        if not a or not b:
            out[k] = 0, len(a), len(b)
        elif len(a) * len(b) > LANE_BITS:
            out[k] = edits(a, b)
        else:
            waiting.append((len(b), len(a), k, a, b))
    waiting.sort(key=lambda x: x[:3])
    for i in range(0, len(waiting), LANES):
        some = waiting[i : i + LANES]
        for x, counts in zip(some, _lanes([x[3:] for x in some]), strict=True):
            out[x[2]] = counts
    return out


def common_subsequence(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence (Hyyrö, 2004)."""
    places, mask = _places(a), (1 << len(a)) - 1
    state = mask
    for x in b:
        hit = state & places.get(x, 0)
        state = ((state + hit) | (state - hit)) & mask
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * (1 - indel distance / lengths); two empty strings are alike."""
    size = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / size if size else 100.0


def overlap(a: Sequence, b: Sequence) -> int:
    """Size of the intersection of two bags."""
    return sum((Counter(a) & Counter(b)).values())
