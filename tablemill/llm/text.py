"""Array kernels over batches of UTF-8 texts: bytes, words, hashes, shingles.

Everything works on the Arrow buffers of a text column, in pieces of a few
megabytes, so the memory of a task depends on ``PIECE_BYTES`` and on the
longest single text, not on the number of rows. Words are what
``[^\\x20\\x09-\\x0D]+`` finds; those separators are single bytes in UTF-8, so
words can be cut without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_U = np.uint64
# Any odd number has an inverse modulo 2**64, which lets a hash slide.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Piece:
    """Some consecutive rows: ``data[bounds[i]:bounds[i + 1]]`` is the text of row ``first + i``."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1


def _buffers(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.string()), False
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, bounds.astype(np.int64)


def pieces(column, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a text column into runs of whole rows of about ``size`` bytes; null is the empty text."""
    if not len(column):
        return
    data, bounds = _buffers(column)
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1
        last = min(rows, max(first + 1, last))
        cut = bounds[first : last + 1]
        yield Piece(first, data[cut[0] : cut[-1]], cut - cut[0])
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of a public-domain hash)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base ("up") or of its inverse ("down"), modulo 2**64."""
    known = _powers[kind]
    if len(known) < n:
        size = max(n, min(2 * n, PIECE_BYTES + 1))
        known = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= 4 * PIECE_BYTES:
            _powers[kind] = known
    return known[:n]


@dataclass
class Words:
    """The words of a piece in order; ``first[i]:first[i + 1]`` are those of its row i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(piece: Piece) -> Words:
    gap = np.ones(len(piece.data) + 2, bool)
    gap[1:-1] = _space[piece.data]
    # Two rows meet without a separator: cut there.
    edge = np.flatnonzero(gap[:-1] != gap[1:])
    starts, ends = edge[0::2], edge[1::2]
    inner = piece.bounds[1:-1]
    inside = np.searchsorted(starts, inner, "left") - 1
    split = np.unique(inner[(inside >= 0) & (ends[inside] > inner) & (starts[inside] < inner)]) if len(
        starts
    ) else inner[:0]
    if len(split):
        starts = np.sort(np.concatenate([starts, split]))
        ends = np.sort(np.concatenate([ends, split]))
    return Words(starts, ends, np.searchsorted(starts, piece.bounds, "left"))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``: equal bytes, equal hash."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _power("up", n), out=total[1:])
    raw = (total[ends] - total[starts]) * _power("down", n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def ngram_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words within rows, and the rows they belong to.

    A row of fewer than n words (but at least one) has one n-gram: all of it.
    """
    count = np.diff(first)
    rows = np.repeat(np.arange(len(count)), count)
    if not len(hashes):
        return hashes[:0], rows
    # A word's place in its n-gram changes the sum, so order counts.
    turn = [pow(_BASE, 3 * k + 1, 1 << 64) for k in range(n)]
    whole = len(hashes) - n + 1
    out, owner = hashes[:0], rows[:0]
    if whole > 0:
        grams = np.zeros(whole, np.uint64)
        for k in range(n):
            grams += mix(hashes[k : k + whole] + _U(turn[k]))
        inside = rows[:whole] == rows[n - 1 :]
        out, owner = mix(grams[inside] + _U(n)), rows[:whole][inside]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            extra[has] += mix(hashes[first[:-1][short[has]] + k] + _U(turn[k]))
        out = np.concatenate([out, mix(extra + count[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def distinct_in_rows(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row; rows must be ascending."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values):
        keep = np.ones(len(values), bool)
        keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        values, rows = values[keep], rows[keep]
    return values, rows


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i + 1]]`` for each i, in the values' own type."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def add_counts(keys, counts, *others) -> tuple[np.ndarray, ...]:
    """Merge counts by key: sorted distinct keys, their sums, and other values of each key."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    if not len(key):
        return (key, count, *(np.concatenate(other) for other in others))
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    rest = [np.concatenate(other)[order][head] for other in others]
    return (key[head], np.add.reduceat(count, head), *rest)


def runs_of(*columns: np.ndarray) -> np.ndarray:
    """Bounds of the runs of rows equal in all columns, with the length at the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n - 1, bool)
    for column in columns:
        new |= column[1:] != column[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]])
