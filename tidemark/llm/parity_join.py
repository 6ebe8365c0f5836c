"""N-gram Jaccard join by parity sketches: groups of documents whose shingle sets link at a threshold.

Sets A and B with Jaccard similarity of at least t differ in at most d = (1 - t) / (1 + t) * (|A| + |B|)
tokens. Tokens are XOR-hashed into the segments of a sketch, as many segments as the size band has
tokens at least; a token changes one segment, so sketches differ in at most d segments: their
Hamming distance bounds the symmetric difference from below. Two sketches that agree in all but d of their non-empty
segments share one among the first d + 1 of each, taken in segment order (pigeonhole), so joining on those
loses no pair. Bands span an octave; a set near the top of its band joins the next one too, so every
pair within the threshold's size ratio meets in a band. Sets up to 127 tokens give each token its own segment. A
second sketch of single parity bits, at least as many as tokens, rejects pairs by Hamming distance before sets are compared.

Equal sets are one node, known by a 64-bit print. In every bucket of equal segments each node is
paired with the smallest; verified pairs already connect most of a group, so a group of thousands
costs thousands of pairs. Buckets in which such a pair failed and that still hold two components or more
are looked at again, in rounds: every node outside a bucket's largest component names its nearest
partners in other components that the bit sketches and sizes let through, a few at first and, where it has more,
eight times as many in every further round; named pairs are verified and components merge. No pair inside a component is
named, and rounds end when no node has more partners than it was allowed to name, so no link is lost. A bucket of many nodes
is compared in blocks of ``CHUNK`` rows and columns, each a task's group of its own. Verification compares
whole sets and is exact up to 48-bit token hashes.

Scale: texts are scanned twice, in batches and lots of a few megabytes, so a worker needs little beside its executor's heap. Segments travel packed (see ``exchange``); the second scan computes
sets only of documents in candidate pairs and sends a member's set to its hub, hot hubs salted; so does
the scan of each round. Texts are not shuffled while the list of those documents fits ``most_broadcast`` bytes (checked), else
they meet it in a sort-merge join. The segments kept leave room of nine standard deviations and
more for the pigeonhole condition.

Defined results: null texts and texts without words have no tokens and link with nothing; a document without an id
takes part in nothing and has no component; rows that share an id and a text are one document;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as x
from tidemark.llm import store
from tidemark.llm.components import components
from tidemark.llm.text import GOLDEN, U, Block, blocks, mix, window_hashes, window_owner, words

LEAST_BITS = 1024
OWN_SEGMENT = 128
#: Nodes on a side of a compared block; ids in one row of a hub's or bucket's members.
CHUNK = 4096
FOUND = "kind int, doc_id long, print long, node long, n long, sketch binary, others array<long>, load binary"
_FOUND = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "print", "node", "n")), ("sketch", pa.binary()), ("others", pa.list_(pa.int64())), ("load", pa.binary())])
DOC, HUB = 0, 1
#: Sides of a block that a member takes.
ROW, COLUMN, BOTH = 0, 1, 2
#: Rows of blocks taken together, pairs looked at together, and bytes of sketches compared at a time.
LOT, PAIRS, COMPARED = 20_000, 1 << 16, 4 << 20
#: Keys of a lot of the scan, and of an owner looked at together, about; bytes of a batch that a worker gets.
LOT_KEYS, BATCH_BYTES = 1 << 18, 2 << 20


def shingles(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of the block, token) of every text's set of word shingles, by text, then token."""
    w = words(block.lower())
    counts = np.diff(w.bounds)
    h = window_hashes(w.hashes, size)
    at, owner = window_owner(w.bounds, size, len(h))
    tokens, owners = [h[at]], [owner]
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        if len(short):
            whole = window_hashes(w.hashes, k)[w.bounds[short]]
            tokens.append(mix(whole ^ mix(np.full(1, k, U))))
            owners.append(short)
    token, owner = np.concatenate(tokens), np.concatenate(owners)
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], token[new]


def _differences(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Tokens in which sets of these sizes differ at most when they link: floor((1 - t) / (1 + t) * (a + b))."""
    return (100 - percent) * (a + b) // (100 + percent)


def segment_keys(owner: np.ndarray, token: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the segments that a set is joined on, in its own band and, near its top, the next."""
    out_owner, out_key = [], []
    octave = np.zeros(len(sizes), np.int64)
    some = sizes > 0
    octave[some] = np.floor(np.log2(sizes[some])).astype(np.int64)
    top = (np.int64(2) << octave) - 1
    for up in (0, 1):
        band = octave + up
        joins = some & (100 * sizes >= percent * (top + 1)) if up else some.copy()
        largest = np.minimum(100 * sizes // percent, (np.int64(2) << band) - 1)
        need = _differences(sizes, largest, percent) + 1
        # a lone possible partner is an equal set, which is the same node
        joins &= largest >= sizes
        keep = joins[owner]
        o, t = owner[keep], token[keep]
        bits = np.where((np.int64(1) << band) >= OWN_SEGMENT, band, 48)[o].astype(U)
        segment = t >> (U(64) - bits)
        head = np.ones(len(o), bool)
        head[1:] = (o[1:] != o[:-1]) | (segment[1:] != segment[:-1])
        heads = np.flatnonzero(head)
        if not len(heads):
            continue
        value = np.bitwise_xor.reduceat(mix(t), heads)
        o, segment = o[heads], segment[heads]
        first = np.ones(len(o), bool)
        first[1:] = o[1:] != o[:-1]
        starts = np.flatnonzero(first)
        rank = np.arange(len(o)) - np.repeat(starts, np.diff(np.append(starts, len(o))))
        pick = rank < need[o]
        out_owner.append(o[pick])
        out_key.append(mix(value[pick] + segment[pick] * GOLDEN + (band[o[pick]].astype(U) << U(56))))
    return np.concatenate([*out_owner, np.zeros(0, np.int64)]), np.concatenate([*out_key, np.zeros(0, U)])


def widths(sizes: np.ndarray) -> np.ndarray:
    """Bits of the parity sketch of sets of these sizes: a power of two of at least the size, so it never fills up."""
    octave = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    return np.maximum(np.int64(LEAST_BITS), np.int64(2) << octave)


def parity_bits(owner: np.ndarray, token: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text its parities, one after another: bit j tells whether an odd number of tokens hash to j.

    Cells are the low bits of one hash, so a sketch folds to half its width by XOR of its halves.
    """
    w = widths(sizes)
    begin = np.cumsum(w) - w
    cell = (mix(token ^ GOLDEN) & (w[owner] - 1).astype(U)).astype(np.int64)
    return np.packbits((np.bincount(begin[owner] + cell, minlength=int(w.sum())) & 1).astype(np.uint8), bitorder="little")


def _prints(owner: np.ndarray, token: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit print of every set; 0 for an empty one."""
    total = np.zeros(len(token) + 1, U)
    np.cumsum(mix(token + GOLDEN), out=total[1:])
    ends = np.cumsum(sizes)
    return np.where(sizes > 0, mix(total[ends] - total[ends - sizes]) | U(1), U(0)).view(np.int64)


def _scan(size: int, percent: int, owners: int):
    def run(batches):
        docs, prints, nodes, sizes, sketches, key_doc, keys = [], [], [], [], [], [], []
        n = first = number = 0

        def rows():
            lot = x.lot_id(number)
            node, doc, key = np.concatenate(nodes), np.concatenate(key_doc), np.concatenate(keys)
            out = [(lot % owners, lot, x.DOCS, x.pack(np.concatenate(docs), np.concatenate(prints), node, np.concatenate(sizes), np.concatenate(sketches)))]
            # equal sets of a lot send their segments once
            seen, chosen = np.unique(node, return_index=True)
            mine = np.zeros(len(node), bool)
            mine[chosen] = True
            doc, key = doc[mine[doc]], key[mine[doc]]
            to = (key % U(owners)).astype(np.int64)
            order = np.lexsort((doc, to))
            doc, key, to = doc[order], key[order], to[order]
            for o, a, b in x.edges_of(to):
                d, k = doc[a:b], key[a:b]
                there, counts = np.unique(d, return_counts=True)
                out.append((o, lot, x.ITEMS, x.pack(node[there], counts.astype(np.uint16) if counts.max() < 65536 else counts.astype(np.uint32), (k >> U(48)).astype(np.uint16), (k >> U(16)).astype(np.uint32))))
            return x.batch(out)

        for batch in batches:
            doc, print_ = batch.column("doc_id").to_numpy(), batch.column("print").to_numpy()
            for block in blocks(batch.column("text")):
                docs.append(doc[block.rows])
                prints.append(print_[block.rows])
                owner, token = shingles(block, size)
                count = np.bincount(owner, minlength=len(block.rows))
                nodes.append(_prints(owner, token, count))
                sizes.append(count)
                sketches.append(parity_bits(owner, token, count))
                o, k = segment_keys(owner, token, count, percent)
                key_doc.append(o + first)
                keys.append(k)
                n += len(k)
                first += len(block.rows)
                if n >= LOT_KEYS:
                    yield rows()
                    docs, prints, nodes, sizes, sketches, key_doc, keys = [], [], [], [], [], [], []
                    n, first, number = 0, 0, number + 1
        if docs:
            yield rows()

    return run


def _found(rows: dict[str, list]) -> pa.RecordBatch:
    n = max(len(v) for v in rows.values())
    return pa.record_batch([pa.array(rows.get(f.name, [None] * n), f.type) for f in _FOUND], schema=_FOUND)


def _document_rows(load: bytes) -> pa.RecordBatch:
    doc, print_, node, n, sketch = x.unpack(load)
    sketch = sketch.tobytes()
    ends = np.cumsum(widths(n) // 8)
    return _found({"kind": [DOC] * len(doc), "doc_id": doc, "print": print_, "node": node, "n": n, "sketch": [sketch[i:j] for i, j in zip(np.append(0, ends[:-1]), ends, strict=True)]})


def _shared_keys(loads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(node, key) of the keys that two nodes or more have, by key, then node.

    Keys are looked at in ranges of about ``LOT_KEYS`` items; most of them are one node's and go with their range.
    """
    parts = [x.unpack(load) for load in loads]
    ranges = min(1 << 16, -(-sum(len(low) for _, _, _, low in parts) // LOT_KEYS))
    out_node, out_key = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for r in range(ranges):
        nodes, keys = [], []
        for node, counts, high, low in parts:
            mine = np.flatnonzero(high.astype(np.int64) * ranges >> 16 == r)
            nodes.append(np.repeat(node, counts)[mine])
            keys.append((high[mine].astype(U) << U(32)) | low[mine].astype(U))
        node, key = np.concatenate(nodes), np.concatenate(keys)
        order = np.lexsort((node, key))
        node, key = node[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        node, key = node[new], key[new]
        shared = np.zeros(len(key), bool)
        shared[1:] = key[1:] == key[:-1]
        shared[:-1] |= shared[1:]
        out_node.append(node[shared])
        out_key.append(key[shared])
    return np.concatenate(out_node), np.concatenate(out_key)


def _bucket_rows(loads: list[bytes]):
    """Of every bucket of two nodes or more, its hub (the smallest) with the other members.

    Rows of a hub: all its members, in parts of at most about ``CHUNK``, and packed the buckets of three nodes
    or more, as (name, members) parts; a bucket is named by its nodes, so owners that found the same one agree.
    """
    node, key = _shared_keys(loads)
    if not len(key):
        return
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.append(starts, len(key)))
    # buckets of the same nodes are one
    total = np.zeros(len(node) + 1, U)
    np.cumsum(mix(node.view(U)), out=total[1:])
    names = mix(total[starts + counts] - total[starts])
    names, once = np.unique(names, return_index=True)
    hub = node[starts[once]]
    by = np.argsort(hub, kind="stable")
    names, once, hub = names[by], once[by], hub[by]
    empty: dict[str, list] = {"kind": [], "node": [], "others": [], "load": []}
    rows = {c: [] for c in empty}
    for _, a, b in x.edges_of(np.cumsum(np.concatenate([[True], hub[1:] != hub[:-1]]))):
        lists = [node[starts[i] + 1 : starts[i] + counts[i]] for i in once[a:b]]
        others = np.unique(np.concatenate(lists))
        for k in range(0, len(others), CHUNK):
            rows["others"].append(others[k : k + CHUNK])
        parts = [(name, m[k : k + CHUNK]) for name, m in zip(names[a:b], lists, strict=True) if len(m) > 1 for k in range(0, len(m), CHUNK)]
        held, size = [], 0
        for i, (name, m) in enumerate(parts):
            held.append((name, m))
            size += len(m)
            if size >= CHUNK or i == len(parts) - 1:
                rows["load"].append(x.pack(np.array([p[0] for p in held], U), np.array([len(p[1]) for p in held], np.uint32), np.concatenate([p[1] for p in held])))
                held, size = [], 0
        n = max(len(rows["others"]), len(rows["load"]))
        for c in ("others", "load"):
            rows[c] += [None] * (n - len(rows[c]))
        rows["kind"] += [HUB] * (n - len(rows["kind"]))
        rows["node"] += [int(hub[a])] * (n - len(rows["node"]))
        if n >= 5000:
            yield _found(rows)
            rows = {c: [] for c in empty}
    if rows["kind"]:
        yield _found(rows)


def _buckets(batches):
    """Owners' partitions: a row for every document, and those of ``_bucket_rows`` for every owner."""
    for rows in x.by_owner(batches):
        for _, kind, load in rows:
            if kind == x.DOCS:
                yield _document_rows(load)
        if loads := [load for _, kind, load in rows if kind == x.ITEMS]:
            yield from _bucket_rows(loads)


def _packed_set(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of a set's tokens; within a pair of sets, two tokens agree there by chance once in 10**9 pairs."""
    return (tokens >> U(32)).astype("<u4").tobytes() + (tokens >> U(16)).astype("<u2").tobytes()


def _unpacked_set(load: bytes) -> np.ndarray:
    n = len(load) // 6
    return (np.frombuffer(load, "<u4", n).astype(U) << U(16)) | np.frombuffer(load, "<u2", n, 4 * n).astype(U)


def _sets(size: int):
    """Sets of documents, sent along each of their routes."""
    schema = pa.schema([("hub", pa.int64()), ("salt", pa.int32()), ("member", pa.int32()), ("node", pa.int64()), ("load", pa.binary())])

    def run(batches):
        for batch in batches:
            nodes, routes = batch.column("node").to_pylist(), batch.column("routes").to_pylist()
            for block in blocks(batch.column("text")):
                owner, token = shingles(block, size)
                edges = np.searchsorted(owner, np.arange(len(block.rows) + 1))
                rows: list[list] = [[], [], [], [], []]
                for i, row in enumerate(block.rows):
                    load = _packed_set(token[edges[i] : edges[i + 1]])
                    for route in routes[row]:
                        for column, value in zip(rows, (route["hub"], route["salt"], route["member"], nodes[row], load), strict=True):
                            column.append(value)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


def _linked(percent: int):
    """Streams of (hub, salt): the hub's set first, then its members'; yields the pairs that link."""

    def run(batches):
        at, mine = None, None
        for b in batches:
            out: list[list] = [[], []]
            for hub, salt, member, node, load in zip(b.column("hub").to_pylist(), b.column("salt").to_pylist(), b.column("member").to_pylist(), b.column("node").to_pylist(), b.column("load"), strict=True):
                tokens = _unpacked_set(load.as_py())
                if not member:
                    at, mine = (hub, salt), tokens
                elif at == (hub, salt):
                    place = np.searchsorted(mine, tokens)
                    place[place == len(mine)] = 0
                    both = int((mine[place] == tokens).sum()) if len(mine) else 0
                    if 100 * both >= percent * (len(mine) + len(tokens) - both):
                        out[0].append(hub)
                        out[1].append(node)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return run


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two parity sketches, the wider one folded to the other's width."""
    x, y = (int.from_bytes(s, "little") for s in sorted((a, b), key=len))
    width = 8 * min(len(a), len(b))
    while y >> width:
        folded = 0
        while y:
            folded ^= y & ((1 << width) - 1)
            y >>= width
        y = folded
    return (x ^ y).bit_count()


def _near(percent: int):
    def run(batches):
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            apart = np.array([sketch_distance(x, y) for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True)], np.int64)
            fits = (apart <= _differences(na, nb, percent)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield b.select(["a", "b"]).filter(pa.array(fits))

    return run


def _plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and bit sketches don't rule a link out; the sketches' distance never exceeds the sets'."""
    side = lambda p: reps.select(F.col("node").alias(p), F.col("n").alias(f"n{p}"), F.col("sketch").alias(f"s{p}"))
    wide = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return store.save(wide.mapInArrow(_near(percent), "a long, b long"), "plausible", BATCH_BYTES)


def _verified(documents: DataFrame, reps: DataFrame, pairs: DataFrame, size: int, percent: int, most_broadcast: int, per_salt: int = 2000) -> DataFrame:
    """The pairs (a, b) of nodes that link, as a saved table."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / per_salt).cast("int").alias("salts"))
    member = pairs.join(salts, "a").select(F.col("b").alias("node"), F.struct(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member")).alias("route"))
    hub = salts.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("node", F.struct(F.col("node").alias("hub"), "salt", F.lit(0).alias("member")).alias("route"))
    routes = member.unionByName(hub).groupBy("node").agg(F.collect_list("route").alias("routes"))
    routes = store.save(routes.join(reps.select("node", "rep"), "node").select("node", "routes", F.col("rep.doc_id").alias("_doc"), F.col("rep.print").alias("_print")), "routes")
    n = routes.agg(F.sum(F.size("routes") * 4 + 8)).first()[0] or 0
    right = F.broadcast(routes) if 8 * n <= most_broadcast else routes
    chosen = x.texts(documents).join(right, (F.col("doc_id") == F.col("_doc")) & (F.col("print") == F.col("_print"))).select("node", "routes", "text")
    sets = chosen.mapInArrow(_sets(size), "hub long, salt int, member int, node long, load binary")
    dealt = sets.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")
    return store.save(dealt.mapInArrow(_linked(percent), "a long, b long").distinct(), "linked", BATCH_BYTES)


def _largest(group: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which items belong to the largest component of their group, the smallest one of several."""
    order = np.lexsort((root, group))
    g, r = group[order], root[order]
    heads = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])]))
    size = np.diff(np.append(heads, len(g)))
    best = np.lexsort((-size, g[heads]))
    first = best[np.concatenate([[True], g[heads][best][1:] != g[heads][best][:-1]])]
    top = np.zeros(len(heads), bool)
    top[first] = True
    out = np.zeros(len(group), bool)
    out[order] = np.repeat(top, size)
    return out


class _Sketches:
    """The sketches of many nodes, by width, with those of each width folded to the narrower ones as asked for."""

    def __init__(self, n: np.ndarray, raw: list[bytes]):
        self.width = widths(n)
        self.place = np.zeros(len(n), np.int64)
        self.bits: dict[tuple[int, int], np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.bits[w, w] = np.frombuffer(b"".join(raw[i] for i in at), U).reshape(len(at), -1)

    def at(self, items: np.ndarray, wide: int, narrow: int) -> np.ndarray:
        if (wide, narrow) not in self.bits:
            self.bits[wide, narrow] = np.bitwise_xor.reduce(self.bits[wide, wide].reshape(len(self.bits[wide, wide]), -1, narrow // 64), axis=1)
        return self.bits[wide, narrow][self.place[items]]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hamming distances of pairs, the wider sketch folded to the other's width."""
        out = np.zeros(len(a), np.int64)
        for w in np.unique(self.width[a]).tolist():
            for v in np.unique(self.width[b]).tolist():
                which = np.flatnonzero((self.width[a] == w) & (self.width[b] == v))
                low = min(v, w)
                lot = max(1, COMPARED * 8 // low)
                for k in range(0, len(which), lot):
                    part = which[k : k + lot]
                    out[part] = np.bitwise_count(self.at(a[part], w, low) ^ self.at(b[part], v, low)).sum(axis=1, dtype=np.int64)
        return out


def _pairs_of(group: np.ndarray, is_row: np.ndarray, is_column: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, column) items of one group, lots of them at a time."""
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(heads, len(group)))
    rows = np.flatnonzero(is_row)
    which = np.repeat(np.arange(len(heads)), size)[rows]
    edges = np.concatenate([[0], np.cumsum(size[which])])
    k = 0
    while k < len(rows):
        j = max(k + 1, int(np.searchsorted(edges, edges[k] + PAIRS, "right")) - 1)
        n = size[which[k:j]]
        a = np.repeat(rows[k:j], n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(heads[which[k:j]], n)
        keep = is_column[b]
        yield a[keep], b[keep]
        k = j


def _named(percent: int, most: int, group: np.ndarray, t: dict[str, np.ndarray], raw: list[bytes]) -> pa.RecordBatch:
    """For the row nodes of these groups their nearest plausible partners in other components, and whether they have more."""
    node, root, n, side = t["member"], t["root"], t["n"], t["side"]
    # all components' nodes but the largest's name partners: every pair of two components has such a node
    is_row = t["live"] & (side != COLUMN) & ~((side == BOTH) & _largest(group, root))
    sketches = _Sketches(n, raw)
    found: list[tuple] = []
    for a, b in _pairs_of(group, is_row, side != ROW):
        fits = (root[a] != root[b]) & (100 * n[a] >= percent * n[b]) & (100 * n[b] >= percent * n[a])
        a, b = a[fits], b[fits]
        apart = sketches.apart(a, b)
        near = apart <= _differences(n[a], n[b], percent)
        a, b, apart = node[a[near]], node[b[near]], apart[near]
        order = np.lexsort((b, apart, a))
        a, b, apart = a[order], b[order], apart[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, apart = a[new], b[new], apart[new]
        heads = np.flatnonzero(np.diff(a, prepend=-1) != 0) if len(a) else np.zeros(0, np.int64)
        size = np.diff(np.append(heads, len(a)))
        rank = np.arange(len(a)) - np.repeat(heads, size)
        keep = rank < most
        found.append((a[keep], b[keep], apart[keep], (np.repeat(size, size) > most)[keep]))
    a, b, apart, cut = (np.concatenate([*c, np.zeros(0, kind)]) for c, kind in zip(zip(*found, strict=True) if found else [()] * 4, (np.int64, np.int64, np.int64, bool), strict=True))
    return pa.record_batch([pa.array(a), pa.array(b), pa.array(apart.astype(np.int32)), pa.array(cut)], names=["a", "b", "apart", "cut"])


def _nearest(percent: int, most: int):
    """Blocks (bucket, i, j), each in consecutive rows, some ten thousand rows at a time."""
    names = ("bucket", "i", "j", "member", "root", "n", "side", "live")

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def ready(last: bool):
            nonlocal held, rows
            table = pa.Table.from_batches(held)
            t = {c: table[c].to_numpy() for c in names}
            new = np.ones(len(table), bool)
            new[1:] = (t["bucket"][1:] != t["bucket"][:-1]) | (t["i"][1:] != t["i"][:-1]) | (t["j"][1:] != t["j"][:-1])
            end = len(table) if last else int(np.flatnonzero(new)[-1])
            held = table.slice(end).to_batches()
            rows = len(table) - end
            if not end:
                return None
            return _named(percent, most, np.cumsum(new[:end]), {c: v[:end] for c, v in t.items()}, table["sketch"].slice(0, end).to_pylist())

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= LOT and (out := ready(False)) is not None:
                yield out
        if rows:
            yield ready(True)

    return run


def _unpacked(batches):
    """(bucket, member) of packed buckets; a hub is a member of each of its buckets, named in its first part."""
    for batch in batches:
        members, ids = [], []
        for hub, load in zip(batch.column("node").to_pylist(), batch.column("load"), strict=True):
            names, counts, flat = x.unpack(load.as_py())
            members += [flat, np.full(len(names), hub, np.int64)]
            ids += [np.repeat(names, counts).view(np.int64), names.view(np.int64)]
        cat = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)])
        yield pa.record_batch([pa.array(cat(ids)), pa.array(cat(members))], names=["bucket", "member"])


def _open_blocks(members: DataFrame, roots: DataFrame, reps: DataFrame, live: DataFrame | None) -> DataFrame:
    """Members of the buckets that hold several components, dealt to blocks (bucket, i, j) with their facts.

    live: the nodes that may name partners; all where it is None. Buckets without any are left out.
    """
    rooted = members.join(roots.withColumnRenamed("node", "member"), "member", "left").withColumn("root", F.coalesce("root", "member"))
    if live is None:
        rooted = rooted.withColumn("live", F.lit(True))
    else:
        rooted = rooted.join(live.withColumn("live", F.lit(True)), "member", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    each = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"), F.max("live").alias("live"))
    whole = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("roots"), F.sum("k").alias("m"), F.max(F.struct("k", "root")).alias("top"), F.max("live").alias("some")).where("roots > 1 and some")
    chunks = lambda c: F.ceil(c / CHUNK).cast("int")
    whole = whole.select("bucket", F.col("top.root").alias("_top"), chunks(F.col("m")).alias("across"), F.when(F.col("m") <= CHUNK, 1).otherwise(chunks(F.col("m") - F.col("top.k"))).alias("down"))
    dealt = rooted.join(whole, "bucket").join(reps.select(F.col("node").alias("member"), "n", "sketch"), "member")
    spot = lambda c: F.pmod(F.xxhash64("member"), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    columns = F.transform(every("down"), lambda i: place(i, spot("across"), COLUMN))
    rows = F.when(F.col("root") != F.col("_top"), F.transform(every("across"), lambda j: place(spot("down"), j, ROW))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    places = F.when(F.col("across") == 1, F.array(place(F.lit(0), F.lit(0), BOTH))).otherwise(F.concat(columns, rows))
    blocks_ = dealt.withColumn("_place", F.explode(places)).select("bucket", "_place.*", "member", "root", "n", "live", "sketch")
    return blocks_.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def near_duplicate_groups(documents: DataFrame, *, size: int = 5, percent: int = 75, owner_bytes: int = 32 << 20, most_broadcast: int = 16 << 20) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id it is linked with), node."""
    owners = x.owners_for(x.text_bytes(documents), owner_bytes)
    scanned = x.texts(documents).mapInArrow(_scan(size, percent, owners), x.SCHEMA)
    found = store.save(x.deal(scanned, owners).mapInArrow(_buckets, FOUND), "buckets", BATCH_BYTES)
    docs = found.where(F.col("kind") == DOC)
    reps = store.save(docs.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "print")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    hubs = found.where(F.col("kind") == HUB)
    first = store.save(hubs.where("others is not null").select(F.col("node").alias("a"), F.explode("others").alias("b")).distinct(), "pairs")
    linked = _verified(documents, reps, _plausible(first, reps, percent), size, percent, most_broadcast)
    roots = components(linked, "a", "b")
    failed = first.join(linked, ["a", "b"], "left_anti")
    # buckets whose hub has a failed pair may hold links between other nodes
    again = hubs.where("load is not null").join(failed.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    members = store.save(again.select("node", "load").mapInArrow(_unpacked, "bucket long, member long").distinct(), "members", BATCH_BYTES)
    tried, most, live = first, 8, None
    while True:
        named = store.save(_open_blocks(members, roots, reps, live).mapInArrow(_nearest(percent, most), "a long, b long, apart int, cut boolean"), "named", BATCH_BYTES)
        pairs = named.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = store.save(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if not more.isEmpty():
            found = _verified(documents, reps, more, size, percent, most_broadcast)
            tried = tried.unionByName(more)
            if not found.isEmpty():
                roots = components(found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "a", "b")
        live = named.where("cut").select(F.col("a").alias("member")).distinct()
        if live.isEmpty():
            break
        most *= 8
    rooted_reps = reps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted_reps.groupBy("root").agg(F.min("rep.doc_id").alias("component_id"))
    classes = rooted_reps.join(smallest, "root").select("node", "component_id")
    known = docs.select("doc_id", "n", "node").join(classes, "node", "left")
    result = known.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "node")
    lost = documents.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("node"))
    return result.unionByName(lost)
