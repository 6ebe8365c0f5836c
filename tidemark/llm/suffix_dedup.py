"""Substring dedup over bytes by suffix arrays of content-dealt shards.

A byte goes when a ``size``-byte string that covers it also starts in a document with a smaller id.
Every string of that size has a leftmost least hash among its ``GRAM``-byte parts, its anchor, which
depends on nothing but the string; consecutive strings with one anchor form a segment. Equal strings
have equal anchors, so

1. all anchors are counted by their owners (see ``repeats``), and a bitmap of those that occur twice goes to
   every task; segments with a unique anchor hold no repeat and go no further;
2. other segments go to the owner of their anchor's hash, equal ones of a lot only once, the later
   documents' being settled there;
3. an owner joins the strings of its unequal segments that may be another's too (see ``shared_strings``) to one text, sorts its suffixes by induction, computes the
   permuted common prefixes, and in every interval of at least ``size`` common bytes finds the
   smallest document (see ``suffix_array``). What it finds goes back by lots as covered runs.

Scale: texts are scanned and never shuffled while the runs fit ``most_broadcast`` bytes; beyond it
they meet the texts, which travel compressed, in a sort-merge join. The bitmap's size is bounded, an owner's text is bounded by
the number of owners, and copies of one passage cost an owner one short entry a lot.

Defined results: null and empty texts are empty; documents without an id keep everything and take
nothing from others; rows that share an id don't count against each other; strings are judged on the
input; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm import exchange as x
from tidemark.llm import repeats, store
from tidemark.llm.repeated_windows import settle
from tidemark.llm.suffix_array import permuted_prefixes, suffix_array
from tidemark.llm.text import BLOCK, GOLDEN, U, Block, blocks, mix, powers, window_hashes

GRAM = 16
LOT_BYTES = 32 << 20
#: Text that a worker gets or gives at a time.
BATCH_BYTES = 2 << 20
#: Beyond so many owners their texts grow, up to so many bytes: every lot sends a row to every owner.
FEW_OWNERS, MOST_OWNER_BYTES = 1 << 10, 2 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_SYMBOLS = mix(np.arange(1, 257, dtype=U) * GOLDEN)
_OTHER = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
#: Never part of UTF-8, so no string that a segment holds crosses into the next.
_FENCE = 255


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        a = np.minimum(a[:-reach], a[reach:])
        reach *= 2
    return np.minimum(a[: len(a) - (width - reach)], a[width - reach :]) if reach < width else a


def segments(block: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first string's place in the block, number of strings, text, and the anchor's distance from the first string of every segment."""
    grams = window_hashes(_SYMBOLS[block.data], GRAM)
    if len(block.data) < size:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, none, none
    ranked = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U)
    least = sliding_min(ranked, size - GRAM + 1)
    # a segment ends where the anchor changes and where a text has no more strings
    last = block.bounds[1:] - size + 1
    fits = last > block.bounds[:-1]
    edges = np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, block.bounds[:-1][fits], last[fits]])
    edges.sort()
    first = edges[np.diff(edges, append=len(block.data)) > 0]
    owner = np.searchsorted(block.bounds, first, "right") - 1
    inside = first < last[owner]
    ends = np.append(first[1:], len(block.data))[inside]
    first, owner = first[inside], owner[inside]
    anchor = (least[first] & U(0xFFFFFFFF)).astype(np.int64)
    return grams[anchor], first, ends - first, owner, anchor - first


def _named(size: int, ranges: int):
    def run(batches):
        held, n, lot = [], 0, 0
        for batch in batches:
            for block in blocks(batch.column("text")):
                held.append(segments(block, size)[0])
                n += len(held[-1])
                if n >= x.LOT_ITEMS:
                    yield x.batch(repeats.key_rows(np.concatenate(held), ranges, lot))
                    held, n, lot = [], 0, lot + 1
        if n:
            yield x.batch(repeats.key_rows(np.concatenate(held), ranges, lot))

    return run


def cut(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of data, one after another."""
    ends = np.cumsum(lengths)
    kind = np.int32 if max(len(data), int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
    jump = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    jump += np.arange(len(jump), dtype=kind)
    return data[jump]


def _content(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of consecutive pieces of data, about a block of bytes at a time."""
    ends = np.cumsum(lengths)
    out = np.zeros(len(lengths), U), np.zeros(len(lengths), U)
    i = 0
    while i < len(lengths):
        base = int(ends[i] - lengths[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        e = ends[i:j] - base
        b = e - lengths[i:j]
        part = data[base : base + int(e[-1])]
        for which, table in enumerate((_SYMBOLS, _OTHER)):
            up, down = powers(which, len(part) + 1)
            total = np.zeros(len(part) + 1, U)
            np.cumsum(table[part] * up[:-1], out=total[1:])
            out[which][i:j] = mix((total[e] - total[b]) * down[b] + lengths[i:j].astype(U))
        i = j
    return out


def _ask_rows(size: int, owners: int, number: int, doc_ids, prints, keys, docs, starts, counts, anchors, one, two, data) -> list[tuple[int, int, int, bytes]]:
    lot = x.lot_id(number)
    rows = [x.documents_row(owners, lot, doc_ids, prints)]
    lengths = counts + size - 1
    order, _, later = settle((one, two), doc_ids[docs])
    known = order[later]
    if len(known):
        rows.append(x.hits_row(owners, lot, docs[known], starts[known], counts[known]))
    ask = np.sort(order[~later])
    to = (keys[ask] % U(owners)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    ask, to = ask[by], to[by]
    begins = np.cumsum(lengths) - lengths
    for o, a, b in x.edges_of(to):
        part = ask[a:b]
        there, which = np.unique(docs[part], return_inverse=True)
        n = np.bincount(which).astype(np.uint32)
        body = cut(data, begins[part], lengths[part])
        rows.append((o, lot, x.ITEMS, x.squeezed(x.pack(*x.planes(x.deltas(there)), x.deltas(doc_ids[there]), *x.planes(n), *x.planes(starts[part]), counts[part].astype(np.uint16), anchors[part].astype(np.uint16), body))))
    return rows


def _asks(size: int, owners: int, ranges: int, bitmap):
    def run(batches):
        doc_ids, prints, held, n, first, number = [], [], [], 0, 0, 0

        def rows():
            parts = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            return x.batch(_ask_rows(size, owners, number, np.concatenate(doc_ids), np.concatenate(prints), *parts))

        for batch in batches:
            doc_ids.append(batch.column("doc_id").to_numpy())
            prints.append(batch.column("print").to_numpy())
            for block in blocks(batch.column("text")):
                keys, at, count, owner, anchor = segments(block, size)
                may = np.flatnonzero(repeats.maybe_repeated(keys, bitmap.value, ranges))
                if len(may):
                    keys, at, count, owner, anchor = keys[may], at[may], count[may], owner[may], anchor[may]
                    body = cut(block.data, at, count + size - 1)
                    held.append((keys, block.rows[owner] + first, at - block.bounds[owner], count, anchor.astype(np.uint16), *_content(body, count + size - 1), body))
                    n += len(held[-1][-1])
            first += batch.num_rows
            if n >= LOT_BYTES:
                yield rows()
                doc_ids, prints, held, n, first, number = [], [], [], 0, 0, number + 1
        if n:
            yield rows()

    return run


def repeated_places(text: np.ndarray, ids: np.ndarray, valid: np.ndarray, size: int) -> np.ndarray:
    """Which valid places start a string of that size that a place with a smaller id starts too."""
    order = suffix_array(text, size)
    shared = permuted_prefixes(text, order, size)
    interval = np.cumsum(shared[order] < size)
    interval[0:1] = 1
    heads = np.flatnonzero(np.diff(interval, prepend=0))
    seen = np.where(valid[order], ids[order], np.iinfo(np.int64).max)
    least = np.minimum.reduceat(seen, heads)
    late = np.zeros(len(text), bool)
    late[order] = seen > np.repeat(least, np.diff(np.append(heads, len(order))))
    return late & valid


def _around(words: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of that many bytes (8 or more) from each place."""
    out = np.zeros(len(places), U)
    for k in [*range(0, length - 8, 8), length - 8]:
        out = mix(out * GOLDEN + words[places + k].astype(U))
    return out


def shared_strings(data: np.ndarray, begins: np.ndarray, counts: np.ndarray, anchors: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of unequal segments, the strings (from, to) of each that another one may hold too.

    A string holds its anchor and, where that lies in its later half, the bytes before it, else those after it: equal strings
    agree in these, so strings whose bytes around the anchor no other segment has are left out.
    """
    half = (size - GRAM) // 2
    after = size - half + 1 if half else GRAM
    n_before = np.clip(anchors - half + 1, 0, counts)
    words = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    shared = []
    for which, places, length in ((np.flatnonzero(n_before > 0), begins + anchors - half, GRAM + half), (np.flatnonzero(n_before < counts), begins + anchors, after)):
        key = _around(words, places[which], length)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        found = np.zeros(len(counts), bool)
        found[which[order[1:][same]]] = True
        found[which[order[:-1][same]]] = True
        shared.append(found)
    return np.where(shared[0], 0, n_before), np.where(shared[1], counts, np.where(shared[0], n_before, 0))


def _answer(size: int, lots, docs, ids, starts, counts, anchors, data) -> list[tuple[np.ndarray, ...]]:
    """Hits (lot, document, start, count) among the segments of one owner."""
    lengths = counts + size - 1
    order, group, later = settle(_content(data, lengths), ids)
    hits = [(lots[order[later]], docs[order[later]], starts[order[later]], counts[order[later]])]
    ends = np.cumsum(lengths)
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    rep = order[heads]
    low, high = shared_strings(data, (ends - lengths)[rep], counts[rep], anchors[rep], size)
    open_ = np.flatnonzero(low < high)
    rep, low, high = rep[open_], low[open_], high[open_]
    if not len(rep):
        return hits
    n_strings = high - low
    fenced = n_strings + size
    text = np.full(int(fenced.sum()), _FENCE, np.uint8)
    begin = np.cumsum(fenced) - fenced
    inside = np.ones(len(text), bool)
    inside[begin + fenced - 1] = False
    text[inside] = cut(data, (ends - lengths)[rep] + low, fenced - 1)
    valid = np.zeros(len(text) + 1, np.int64)
    valid[begin] += 1
    np.add.at(valid, begin + n_strings, -1)
    valid = np.cumsum(valid[:-1]) > 0
    late = repeated_places(text, np.repeat(ids[rep], fenced), valid, size)
    edge = np.diff(np.concatenate([[0], late.view(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(a):
        # the representative's hits hold for every equal segment of its own document
        which = np.searchsorted(begin, a, "right") - 1
        same = order[~later]
        mine = group[~later]
        first = np.searchsorted(mine, open_[which])
        n = np.searchsorted(mine, open_[which], "right") - first
        run = np.repeat(np.arange(len(a)), n)
        member = same[np.repeat(first, n) + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)]
        hits.append((lots[member], docs[member], starts[member] + (a - begin[which] + low[which])[run], (b - a)[run]))
    return hits


def _shard(size: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """One owner's segments of all lots -> hits by lot; other rows pass."""
    out = [(0, lot, kind, load) for lot, kind, load in rows if kind != x.ITEMS]
    held = []
    for lot, kind, load in rows:
        if kind == x.ITEMS:
            d0, d1, did, n0, n1, s0, s1, counts, anchors, body = x.unpack(x.unsqueezed(load))
            n = x.joined(n0, n1)
            held.append((np.full(len(counts), lot, np.int64), np.repeat(np.cumsum(x.joined(d0, d1)), n), np.repeat(np.cumsum(did), n), x.joined(s0, s1), counts.astype(np.int64), anchors.astype(np.int64), body))
    rows.clear()
    if held:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        found = _answer(size, *columns)
        lot, doc, start, count = (np.concatenate(c) for c in zip(*found, strict=True))
        by = np.argsort(lot, kind="stable")
        lot, doc, start, count = lot[by], doc[by], start[by], count[by]
        out += [x.hits_row(1, i, doc[a:b], start[a:b], count[a:b]) for i, a, b in x.edges_of(lot)]
    return x.batch(out)


def _answers(size: int):
    def run(batches):
        for rows in x.by_owner(batches):
            yield _shard(size, rows)

    return run


def _pieces(batch: pa.RecordBatch):
    """The batch in runs of rows with about ``BATCH_BYTES`` of text, or one longer row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BATCH_BYTES, "right")))
        yield batch.slice(i, j - i)
        i = j


def _result(batches):
    for batch in (p for b in batches for p in _pieces(b)):
        out: list[list] = [[], [], [], [], [], []]
        for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("runs").to_pylist(), strict=True):
            body = kept = x.text_of(text)
            spans = spans or []
            if spans:
                edges = [0, *spans, len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            for column, value in zip(out, (doc_id, len(body), len(body) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_byte_runs(documents: DataFrame, size: int = 50, owner_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, print and the byte runs (start, end, ...) that a smaller id has too, as a saved table."""
    spark = documents.sparkSession
    n_bytes = x.text_bytes(documents)
    texts = x.texts(documents)
    ranges = repeats.ranges_for(n_bytes // 16)
    parts = texts.select("text").mapInArrow(_named(size, ranges), x.SCHEMA)
    with store.batches_of(spark, BATCH_BYTES):
        bitmap = spark.sparkContext.broadcast(repeats.repeated_keys(parts, n_bytes // 16, ranges))
    owners = x.owners_for(n_bytes, max(owner_bytes, min(MOST_OWNER_BYTES, n_bytes // FEW_OWNERS)))
    asks = texts.mapInArrow(_asks(size, owners, ranges, bitmap), x.SCHEMA)
    answers = x.deal(asks, owners).mapInArrow(_answers(size), x.SCHEMA)
    return store.save(x.covered_runs(answers, size), "byte-runs", BATCH_BYTES)


def drop_repeated_bytes(documents: DataFrame, *, size: int = 50, most_broadcast: int = 16 << 20) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes."""
    if size < GRAM:
        raise ValueError(f"strings of at least {GRAM} bytes are compared")
    runs = repeated_byte_runs(documents, size)
    return x.with_runs(documents, runs, most_broadcast, squeeze=True).mapInArrow(_result, RESULT)
