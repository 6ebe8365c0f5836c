"""Words, windows and fingerprints of whole Arrow text columns, vectorised over their bytes.

Everything here works on blocks of consecutive texts of about ``BLOCK`` bytes, so memory stays
bounded by a block or one longer text. Words are runs of bytes other than ASCII white space, which
for UTF-8 are the runs of characters other than those six.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Fixed values of the public 64-bit finaliser of MurmurHash3, and an odd multiplier near 2**64 / phi.
_M1, _M2, GOLDEN = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing."""
    x = x ^ (x >> U(33))
    x *= _M1
    x ^= x >> U(33)
    x *= _M2
    x ^= x >> U(33)
    return x


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.n = base, 0
        self.up = self.down = np.zeros(0, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n + n // 8, 1 << 16)
            self.up = np.cumprod(np.concatenate([np.ones(1, U), np.full(self.n - 1, self.base, U)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, U), np.full(self.n - 1, _inverse(self.base), U)]))
        return self.up[:n], self.down[:n]


_POWERS = {0: _Powers(0x9E3779B97F4A7C15), 1: _Powers(0xD1342543DE82EF95)}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of one of the odd multipliers, and of its inverse."""
    return _POWERS[which].to(n)


def window_hashes(symbols: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """64-bit hashes of all windows of that many consecutive symbols (already mixed 64-bit values)."""
    n = len(symbols) - size + 1
    if n < 1:
        return np.zeros(0, U)
    up, down = powers(which, len(symbols))
    total = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * up, out=total[1:])
    return mix((total[size:] - total[:-size]) * down[:n])


@dataclass
class Block:
    """Consecutive texts: their rows in the batch, their bytes, and where each begins (one more at the end)."""

    rows: np.ndarray
    data: np.ndarray
    bounds: np.ndarray

    def lower(self) -> Block:
        return Block(self.rows, _LOWER[self.data], self.bounds)


@dataclass
class Words:
    """Starts and ends of words in a block's bytes, their hashes, and the first word of each text (one more at the end)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def blocks(column: pa.Array) -> Iterator[Block]:
    """The texts of a string column, nulls as empty, in blocks."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        yield Block(np.arange(i, j), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def words(block: Block) -> Words:
    """Words of every text of a block with 64-bit hashes of their bytes."""
    n = len(block.data)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(len(block.bounds), np.int64))
    ink = ~_BLANK[block.data]
    begin, end = ink.copy(), ink.copy()
    begin[1:] &= ~ink[:-1]
    end[:-1] &= ~ink[1:]
    cuts = block.bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begin[cuts] = ink[cuts]
    end[cuts - 1] = ink[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    lengths = ends - starts
    padded = np.concatenate([block.data, np.zeros(8, np.uint8)])
    eights = np.ndarray((n + 1,), "<u8", padded, 0, (1,))
    mask = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U)
    h = mix((eights[starts] & mask[np.minimum(lengths, 8)]) + lengths.astype(U) * GOLDEN)
    at, rest = starts + 8, lengths - 8
    more = np.flatnonzero(rest > 0)
    while len(more):
        h[more] = mix(h[more] * GOLDEN + (eights[at[more]] & mask[np.minimum(rest[more], 8)]))
        at[more] += 8
        rest[more] -= 8
        more = more[rest[more] > 0]
    return Words(starts, ends, h, np.searchsorted(starts, block.bounds))


def window_owner(bounds: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n window starts lie inside one text, and the text of each of those."""
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)[:n]
    fits = np.arange(n) + size <= bounds[1:][owner]
    return np.flatnonzero(fits), owner[fits]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n places lie in a window of that size with one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:-1]) > 0
