"""Substring dedup over words: a count-min prefilter, then exact grouping of what may repeat.

A window is ``size`` consecutive words of one document. A word goes when a window that covers it has
the same words as a window of a document with a smaller id. The first pass merges every partition's
count-min sketch of window hashes (see ``countmin``); it overestimates counts, so it loses no repeat.
The second pass groups exactly, by 80 bits of two independent hashes, only the windows estimated
repeated: within a task first, where every occurrence after the smallest id is settled at once, then
one occurrence set a task at the owner of the hash, so a passage that a third of all documents share
costs an owner one entry a task. What is found goes back by lots (see ``exchange``) as covered runs.

Scale: texts are read in narrow scans and never shuffled while the runs fit ``most_broadcast`` bytes;
beyond it they meet the texts in a sort-merge join. The sketch's size is fixed.

Defined results: null and empty texts have no words; documents without an id keep everything and
take nothing from others; rows that share an id don't count against each other; windows are judged
on the input; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import countmin
from tidemark.llm import exchange as x
from tidemark.llm import store
from tidemark.llm.text import U, blocks, window_hashes, window_owner, words

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _windows(batch: pa.RecordBatch, size: int, checks: bool):
    """For every block: hashes of its windows, their check bits, the row of each and its start in words."""
    for block in blocks(batch.column(batch.schema.get_field_index("text"))):
        w = words(block)
        h = window_hashes(w.hashes, size)
        at, owner = window_owner(w.bounds, size, len(h))
        check = window_hashes(w.hashes, size, 1)[at] if checks else None
        yield h[at], check, block.rows[owner], at - w.bounds[owner]


def _sketch(size: int, bits: int, shards: int):
    def run(batches):
        held, n, lot = [], 0, 0
        for batch in batches:
            for h, *_ in _windows(batch, size, False):
                held.append(h)
                n += len(h)
                if n >= x.LOT_ITEMS:
                    yield x.batch(countmin.partial_rows(np.concatenate(held), bits, shards, lot))
                    held, n, lot = [], 0, lot + 1
        if n:
            yield x.batch(countmin.partial_rows(np.concatenate(held), bits, shards, lot))

    return run


def settle(order_keys: tuple[np.ndarray, ...], doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort items by key, then document. Gives the order, the number of each group, and which items follow a smaller id."""
    order = np.lexsort((doc_ids, *order_keys))
    new = np.ones(len(order), bool)
    if len(order):
        same = np.ones(len(order) - 1, bool)
        for k in order_keys:
            s = k[order]
            same &= s[1:] == s[:-1]
        new[1:] = ~same
    group = np.cumsum(new) - 1
    ids = doc_ids[order]
    return order, group, ids > ids[new][group] if len(order) else np.zeros(0, bool)


def _ask_rows(owners: int, number: int, doc_ids, prints, h, check, docs, starts) -> list[tuple[int, int, int, bytes]]:
    """A lot's rows: its documents, the windows settled within it, and one set of windows a key for the owners."""
    lot = x.lot_id(number)
    rows = [x.documents_row(owners, lot, doc_ids, prints)]
    order, _, later = settle((check, h), doc_ids[docs])
    known = order[later]
    if len(known):
        rows.append(x.hits_row(owners, lot, docs[known], starts[known]))
    ask = np.sort(order[~later])
    to = (h[ask] % U(owners)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    ask, to = ask[by], to[by]
    for o, a, b in x.edges_of(to):
        part = ask[a:b]
        there, which = np.unique(docs[part], return_inverse=True)
        counts = np.bincount(which).astype(np.uint16) if len(part) < 65536 else np.bincount(which).astype(np.uint32)
        rows.append((o, lot, x.ITEMS, x.pack(*x.planes(x.deltas(there)), x.deltas(doc_ids[there]), counts, h[part], check[part], *x.planes(starts[part]))))
    return rows


def _asks(size: int, owners: int, bits: int, maps):
    def run(batches):
        doc_ids, prints, held, n, first, number = [], [], [], 0, 0, 0

        def rows():
            parts = [np.concatenate(c) for c in zip(*held, strict=True)]
            return x.batch(_ask_rows(owners, number, np.concatenate(doc_ids), np.concatenate(prints), *parts))

        for batch in batches:
            doc_ids.append(batch.column("doc_id").to_numpy())
            prints.append(batch.column("print").to_numpy())
            for h, check, row, start in _windows(batch, size, True):
                may = np.flatnonzero(countmin.maybe_repeated(h, maps.value, bits))
                if len(may):
                    held.append((h[may], (check[may] >> U(48)).astype(np.uint16), row[may] + first, start[may]))
                    n += len(may)
            first += batch.num_rows
            if n >= x.LOT_ITEMS:
                yield rows()
                doc_ids, prints, held, n, first, number = [], [], [], 0, 0, number + 1
        if n:
            yield rows()

    return run


def _settled_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """One owner's windows of all lots by key; those after a smaller id go back to their lots, other rows pass."""
    out = [(0, lot, kind, load) for lot, kind, load in rows if kind != x.ITEMS]
    lots, docs, ids, h, check, starts = [], [], [], [], [], []
    for lot, kind, load in rows:
        if kind == x.ITEMS:
            low, high, did, counts, keys, c, s0, s1 = x.unpack(load)
            docs.append(np.repeat(np.cumsum(x.joined(low, high)), counts))
            ids.append(np.repeat(np.cumsum(did), counts))
            lots.append(np.full(len(keys), lot, np.int64))
            h.append(keys)
            check.append(c)
            starts.append(x.joined(s0, s1))
    if h:
        order, _, later = settle((np.concatenate(check), np.concatenate(h)), np.concatenate(ids))
        found = order[later]
        lot, doc, start = np.concatenate(lots)[found], np.concatenate(docs)[found], np.concatenate(starts)[found]
        by = np.argsort(lot, kind="stable")
        lot, doc, start = lot[by], doc[by], start[by]
        out += [x.hits_row(1, i, doc[a:b], start[a:b]) for i, a, b in x.edges_of(lot)]
    return x.batch(out)


def _answers(batches):
    for rows in x.by_owner(batches):
        yield _settled_rows(rows)


def _result(batches):
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("runs").to_pylist(), strict=True):
            w = text.as_py().encode().split()
            kept = w
            if spans:
                kept, at = [], 0
                for a, b in zip(spans[::2], spans[1::2], strict=True):
                    kept += w[at:a]
                    at = b
                kept += w[at:]
            body = b" ".join(kept)
            for column, value in zip(out, (doc_id, len(w), len(w) - len(kept), hashlib.sha256(body).hexdigest(), body.decode()), strict=True):
                column.append(value)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def repeated_word_runs(documents: DataFrame, size: int = 50, owner_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, print and the word runs (start, end, ...) that a smaller id has too, as a saved table."""
    spark = documents.sparkSession
    n_bytes = x.text_bytes(documents)
    texts = x.texts(documents)
    bits = countmin.width_bits(n_bytes // 6)
    shards = 1 << min(6, max(0, bits - 18))
    parts = texts.select("text").mapInArrow(_sketch(size, bits, shards), x.SCHEMA)
    maps = spark.sparkContext.broadcast(countmin.repeated_cells(parts, bits, shards))
    owners = x.owners_for(n_bytes, owner_bytes)
    asks = texts.mapInArrow(_asks(size, owners, bits, maps), x.SCHEMA)
    answers = x.deal(asks, owners).mapInArrow(_answers, x.SCHEMA)
    return store.save(x.covered_runs(answers, size), "word-runs")


def drop_repeated_words(documents: DataFrame, *, size: int = 50, most_broadcast: int = 16 << 20) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 and the kept words joined by spaces."""
    runs = repeated_word_runs(documents, size)
    return x.with_runs(documents, runs, most_broadcast).mapInArrow(_result, RESULT)
