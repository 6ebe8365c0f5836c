"""Packed exchange: numpy columns travel between tasks as a few binary rows, not one row an item.

A mapper works through its texts in *lots* (at most ``LOT_ITEMS`` items each, named by partition and
number, so a retried task names them alike). Items of a lot go to the owners of their keys; what the
owners find comes back by lot, meets the lot's table of documents, and leaves as one row a document.
Rows of the exchange are (to, lot, kind, load); ``load`` holds the arrays. Owners are as many as the
input's size asks for. A partition holds one owner or more, sorted, and works through them one after
another, so what a task holds at once is one owner's rows however large the input is, and
the number of partitions is bounded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "to int, lot long, kind int, load binary"
_ARROW = pa.schema([("to", pa.int32()), ("lot", pa.int64()), ("kind", pa.int32()), ("load", pa.binary())])
#: Kinds of rows: the documents of a lot, items for their owner, places already known to be hits.
DOCS, ITEMS, HITS = 0, 1, 2
LOT_ITEMS = 4_000_000
#: Partitions that owners are dealt to at most; more owners share them and take turns.
MOST_PARTITIONS = 20_000
_CODES = {"u1": 0, "u2": 1, "u4": 2, "u8": 3, "i8": 4}
_TYPES = {v: np.dtype(f"<{k}") for k, v in _CODES.items()}


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned or 64-bit signed integers as one byte string."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        out.append(struct.pack("<BQ", _CODES[a.dtype.str[1:]], len(a)))
        out.append(a.tobytes())
    return b"".join(out)


def unpack(load: bytes) -> list[np.ndarray]:
    at, arrays = 1, []
    for _ in range(load[0]):
        code, n = struct.unpack_from("<BQ", load, at)
        kind = _TYPES[code]
        arrays.append(np.frombuffer(load, kind, n, at + 9))
        at += 9 + n * kind.itemsize
    return arrays


def squeezed(load: bytes) -> bytes:
    """Shorter by zstd, behind its length; shuffles alone compress text by a third at most."""
    return struct.pack("<Q", len(load)) + pa.compress(load, codec="zstd", asbytes=True)


def unsqueezed(load: bytes) -> bytes:
    return pa.decompress(memoryview(load)[8:], decompressed_size=struct.unpack_from("<Q", load)[0], codec="zstd", asbytes=True)


def text_of(text: pa.Scalar) -> bytes:
    """A text's bytes, whether it is a string or has travelled squeezed."""
    return text.as_py().encode() if pa.types.is_string(text.type) else unsqueezed(text.as_py())


def _squeezed_texts(batches):
    for b in batches:
        small = pa.array([squeezed(t.as_py().encode()) for t in b.column("text")], pa.binary())
        yield pa.record_batch([b.column("doc_id"), b.column("print"), small], names=["doc_id", "print", "text"])


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high halves of numbers below 2**32; the high ones are mostly zero and compress away."""
    x = x.astype(np.uint32)
    return (x & np.uint32(0xFFFF)).astype(np.uint16), (x >> np.uint32(16)).astype(np.uint16)


def joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) | (high.astype(np.int64) << 16)


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x.astype(np.int64), prepend=np.int64(0))


def batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    to, lot, kind, load = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(to, pa.int32()), pa.array(lot, pa.int64()), pa.array(kind, pa.int32()), pa.array(load, pa.binary())], schema=_ARROW)


def lot_id(number: int) -> int:
    return (TaskContext.get().partitionId() << 24) | number


def documents_row(owners: int, lot: int, doc_ids: np.ndarray, prints: np.ndarray) -> tuple[int, int, int, bytes]:
    return (lot % owners, lot, DOCS, pack(deltas(doc_ids), prints.astype(np.int64)))


def hits_row(owners: int, lot: int, docs: np.ndarray, starts: np.ndarray, counts: np.ndarray | None = None) -> tuple[int, int, int, bytes]:
    """Windows found repeated (document of the lot, start, how many consecutive ones) as one row; any order."""
    order = np.lexsort((starts, docs))
    counts = np.ones(len(docs), np.uint16) if counts is None else counts.astype(np.uint16)
    return (lot % owners, lot, HITS, pack(*planes(deltas(docs[order])), *planes(starts[order]), counts[order]))


def owners_for(n_bytes: int, share: int) -> int:
    """How many owners split the items of that many bytes of text."""
    return max(16, -(-n_bytes // share))


def deal(df: DataFrame, owners: int) -> DataFrame:
    """Rows by owner: each partition holds whole owners, one after another."""
    return df.repartition(min(owners, MOST_PARTITIONS), "to").sortWithinPartitions("to")


def by_owner(batches) -> Iterator[list[tuple[int, int, bytes]]]:
    """The rows (lot, kind, load) of one owner at a time, of batches that are sorted by owner."""
    at, rows = None, []
    for b in batches:
        for to, lot, kind, load in zip(b.column("to").to_pylist(), b.column("lot").to_pylist(), b.column("kind").to_pylist(), b.column("load"), strict=True):
            if to != at:
                if rows:
                    yield rows
                at, rows = to, []
            rows.append((lot, kind, load.as_py()))
    if rows:
        yield rows


def edges_of(to: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(owner, begin, end) of every run of a sorted array of owners."""
    heads = np.flatnonzero(np.diff(to, prepend=-1))
    yield from zip(to[heads].tolist(), heads.tolist(), np.append(heads, len(to))[1:].tolist(), strict=True)


def texts(documents: DataFrame) -> DataFrame:
    """doc_id, a 64-bit print of the text, and the text; documents without an id can't be ordered and stay out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text")).where("doc_id is not null")


def text_bytes(documents: DataFrame) -> int:
    return documents.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


RUNS = "doc_id long, print long, runs array<long>"


def _runs_by_lot(size: int):
    """All hits of a lot -> a row for each document that has any: its covered runs as start, end, start, ..."""

    def run(table: pa.Table) -> pa.Table:
        doc_ids = prints = None
        docs, starts, counts = [], [], []
        for kind, load in zip(table["kind"].to_pylist(), table["load"], strict=True):
            arrays = unpack(load.as_py())
            if kind == DOCS:
                doc_ids, prints = np.cumsum(arrays[0]), arrays[1]
            else:
                docs.append(np.cumsum(joined(arrays[0], arrays[1])))
                starts.append(joined(arrays[2], arrays[3]))
                counts.append(arrays[4])
        out: list[list] = [[], [], []]
        if docs:
            d, s = np.concatenate(docs), np.concatenate(starts)
            e = s + np.concatenate(counts).astype(np.int64) - 1 + size
            order = np.lexsort((s, d))
            d, s, e = d[order], s[order], e[order]
            # a run begins where the document changes or a window starts beyond all that came before
            reach = np.maximum.accumulate((d << 40) + e)
            first = np.ones(len(d), bool)
            first[1:] = (d[1:] << 40) + s[1:] > reach[:-1]
            at = np.flatnonzero(first)
            last = np.append(at[1:], len(d)) - 1
            pairs = np.stack([s[at], reach[last] - (d[at] << 40)], axis=1)
            heads = np.flatnonzero(np.diff(d[at], prepend=-1))
            for a, b in zip(heads, np.append(heads[1:], len(at)), strict=True):
                out[0].append(int(doc_ids[d[at[a]]]))
                out[1].append(int(prints[d[at[a]]]))
                out[2].append(pairs[a:b].ravel())
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], names=["doc_id", "print", "runs"])

    return run


def covered_runs(answers: DataFrame, size: int) -> DataFrame:
    """One row a document (twice for a repeated row) with the runs that windows of that size cover."""
    return answers.groupBy("lot").applyInArrow(_runs_by_lot(size), RUNS).dropDuplicates(["doc_id", "print"])


def with_runs(documents: DataFrame, runs: DataFrame, most_broadcast: int, squeeze: bool = False) -> DataFrame:
    """Documents beside their runs. Runs go to every task only when they are proven to be few; else texts travel, as zstd bytes with squeeze."""
    n = runs.agg(F.sum(F.size("runs") + 4)).first()[0] or 0
    right = runs.select(F.col("doc_id").alias("_doc"), F.col("print").alias("_print"), "runs")
    few = 8 * n <= most_broadcast
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    left = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text"))
    if squeeze and not few:
        left = left.mapInArrow(_squeezed_texts, "doc_id long, print long, text binary")
    joined = left.join(F.broadcast(right) if few else right, (F.col("doc_id") == F.col("_doc")) & (F.col("print") == F.col("_print")), "left")
    return joined.select("doc_id", "text", "runs")
