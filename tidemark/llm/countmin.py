"""Count-min sketch of 64-bit keys, merged over partitions, kept as the cells that were hit twice.

A cell needs no more than the answers 0, 1 and "2 or more". Each task sends the cells that its keys
hit, sorted and delta-coded at about a byte a key; owners of cell ranges add them up. The result is
``depth`` bitmaps of ``width`` bits, whose size is fixed by ``width`` (at most ``MOST_BITS``) whatever
the input, so it may be sent to every task. A key is estimated repeated when its bit is set in every
bitmap: never too low, so no repeated key is lost; a fuller sketch only lets more unique keys pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm import exchange as x
from tidemark.llm.text import U, mix

MOST_BITS = 28
DEPTH = 2
_SEEDS = (U(0x243F6A8885A308D3), U(0x13198A2E03707344))


def width_bits(keys: int) -> int:
    """log2 of the cells a row gets: at least two a key, between 2**18 and 2**MOST_BITS."""
    return min(MOST_BITS, max(18, int(2 * max(keys, 1) - 1).bit_length()))


def cells(keys: np.ndarray, depth: int, bits: int) -> np.ndarray:
    return mix(keys ^ _SEEDS[depth]) >> U(64 - bits)


def _encode(sorted_cells: np.ndarray) -> np.ndarray:
    """Sorted numbers as byte deltas; 255 moves on without naming a cell."""
    d = np.diff(sorted_cells.astype(np.int64), prepend=np.int64(0))
    far = d // 255
    at = np.cumsum(far + 1) - 1
    out = np.full(int(at[-1]) + 1 if len(at) else 0, 255, np.uint8)
    out[at] = (d % 255).astype(np.uint8)
    return out


def _decode(code: np.ndarray) -> np.ndarray:
    return np.cumsum(code, dtype=np.int64)[code != 255]


def partial_rows(keys: np.ndarray, bits: int, shards: int, lot: int) -> list[tuple[int, int, int, bytes]]:
    """A task's part of the sketch, by owner; a cell that it hits twice or more is named twice."""
    rows = []
    shift = U(bits - (shards.bit_length() - 1))
    for depth in range(DEPTH):
        c = np.sort(cells(keys, depth, bits))
        c = c[np.concatenate([np.ones(min(2, len(c)), bool), c[2:] != c[:-2]])]
        edges = np.searchsorted(c, np.arange(shards + 1, dtype=U) << shift)
        for s in range(shards):
            part = c[edges[s] : edges[s + 1]]
            if len(part):
                rows.append((depth * shards + s, lot, depth * shards + s, x.pack(_encode(part - (U(s) << shift)))))
    return rows


def _merge(bits: int, shards: int):
    size = (1 << bits) // shards

    def run(batches):
        current, counts = None, None
        out: list[tuple[int, int, int, bytes]] = []
        for b in batches:
            for shard, load in zip(b.column("kind").to_pylist(), b.column("load"), strict=True):
                if shard != current:
                    if current is not None:
                        out.append((0, 0, current, np.packbits(counts > 1).tobytes()))
                    current, counts = shard, np.zeros(size, np.uint8)
                hit = _decode(x.unpack(load.as_py())[0])
                twice = np.concatenate([[False], hit[1:] == hit[:-1]])
                counts[hit[~twice]] += 1
                counts[hit[twice]] += 1
                np.minimum(counts, 2, out=counts)
        if current is not None:
            out.append((0, 0, current, np.packbits(counts > 1).tobytes()))
        yield x.batch(out)

    return run


def repeated_cells(parts: DataFrame, bits: int, shards: int) -> list[np.ndarray]:
    """The bitmaps, one a depth, from all tasks' parts."""
    owned = parts.repartition(DEPTH * shards, "to").sortWithinPartitions("kind")
    maps = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(DEPTH)]
    step = len(maps[0]) // shards
    for row in owned.mapInArrow(_merge(bits, shards), x.SCHEMA).select("kind", "load").toLocalIterator():
        depth, s = divmod(row["kind"], shards)
        maps[depth][s * step : (s + 1) * step] = np.frombuffer(row["load"], np.uint8)
    return maps


def maybe_repeated(keys: np.ndarray, maps: list[np.ndarray], bits: int) -> np.ndarray:
    """Which keys are estimated to occur twice or more."""
    found = np.ones(len(keys), bool)
    for depth, bitmap in enumerate(maps):
        c = cells(keys, depth, bits)
        found &= (bitmap[c >> U(3)] >> (U(7) - (c & U(7))).astype(np.uint8)) & np.uint8(1) > 0
    return found
