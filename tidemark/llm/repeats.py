"""Which 64-bit keys occur twice or more: counted by owners of ranges, kept as a bounded bitmap.

Keys are dealt by their highest bits to the owners of ranges, as sorted 40-bit remainders, delta-coded at about
three bytes a key. An owner counts them whole and marks ``PROBES`` bits of its own part of the bitmap for every key
that occurs twice. So only repeated keys fill the bitmap, and unique ones, however many, don't; ``MOST_BITS`` bounds it, since
it goes to every task. A repeated key is never missed; a fuller bitmap only lets more unique keys pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm import exchange as x
from tidemark.llm.text import U, mix

MOST_BITS = 29
PROBES = 3
#: Keys of a range, and ranges at most.
RANGE_KEYS, MOST_RANGES = 1 << 21, 1 << 14
_SEEDS = (U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0))


def ranges_for(keys: int) -> int:
    """A power of two."""
    return min(MOST_RANGES, max(16, 1 << max(0, int(max(keys, 1) - 1).bit_length() - (RANGE_KEYS.bit_length() - 1))))


def _split(keys: np.ndarray, ranges: int) -> np.ndarray:
    """A range's number followed by 40 bits."""
    return mix(keys) >> U(24 - (ranges.bit_length() - 1))


def _probes(rest: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix(rest ^ seed) & U(bits - 1) for seed in _SEEDS[:PROBES]]


def key_rows(keys: np.ndarray, ranges: int, lot: int) -> list[tuple[int, int, int, bytes]]:
    """A lot's keys by range; one that it holds twice or more is named twice."""
    k = np.sort(_split(keys, ranges))
    k = k[np.concatenate([np.ones(min(2, len(k)), bool), k[2:] != k[:-2]])]
    edges = np.searchsorted(k, np.arange(ranges + 1, dtype=U) << U(40))
    rows = []
    for r in np.flatnonzero(np.diff(edges)).tolist():
        d = x.deltas(k[edges[r] : edges[r + 1]] & U((1 << 40) - 1))
        low, rest = (d & 0xFFFF).astype(np.uint16), d >> 16
        rows.append((r, lot, r, x.pack(low, (rest & 0xFF).astype(np.uint8), (rest >> 8).astype(np.uint16))))
    return rows


def _counted(bits: int):
    def run(batches):
        for rows in x.by_owner(batches):
            keys = []
            for _, owner, load in rows:
                low, middle, high = x.unpack(load)
                keys.append(np.cumsum(low.astype(np.int64) | (middle.astype(np.int64) << 16) | (high.astype(np.int64) << 24)))
            rows.clear()
            k = np.sort(np.concatenate(keys))
            twice = np.unique(k[1:][k[1:] == k[:-1]]).astype(U)
            marks = np.zeros(bits, bool)
            for p in _probes(twice, bits):
                marks[p] = True
            yield x.batch([(0, 0, owner, np.packbits(marks).tobytes())])

    return run


def repeated_keys(parts: DataFrame, keys: int, ranges: int) -> np.ndarray:
    """The bitmap, a row of bytes a range: four bits a key until ``MOST_BITS`` is reached."""
    bits = max(8, (1 << min(MOST_BITS, max(19, int(4 * max(keys, 1) - 1).bit_length()))) // ranges)
    bitmap = np.zeros((ranges, bits // 8), np.uint8)
    for row in x.deal(parts, ranges).mapInArrow(_counted(bits), x.SCHEMA).select("kind", "load").toLocalIterator():
        bitmap[row["kind"]] = np.frombuffer(row["load"], np.uint8)
    return bitmap


def maybe_repeated(keys: np.ndarray, bitmap: np.ndarray, ranges: int) -> np.ndarray:
    """Which keys may occur twice or more."""
    k = _split(keys, ranges)
    owner, rest = (k >> U(40)).astype(np.int64), k & U((1 << 40) - 1)
    found = np.ones(len(keys), bool)
    for p in _probes(rest, bitmap.shape[1] * 8):
        found &= (bitmap[owner, (p >> U(3)).astype(np.int64)] >> (U(7) - (p & U(7))).astype(np.uint8)) & np.uint8(1) > 0
    return found
