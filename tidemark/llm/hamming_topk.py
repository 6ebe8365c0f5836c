"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code is the sign of each of its dimensions. Codes are cut into m bit segments
and indexed once a segment. A search takes the segments in turn, radius by radius: once it is through with segment j
(from 0) at radius r, every code within m * r + j bits has been met, so a query whose kth distance is
within that is answered, and the proof needs no whole round. A code counts where a search meets it first, which its other segments'
distances tell, and only if it is within the query's kth distance so far. Equal distances are gathered whole; ties go by the smaller id.

The codes are dealt into shards and the queries into parts; a task has a shard and a part, indexes the one and
answers the other in blocks, and the k best of all shards are the k best of all codes. A shard
keeps the k + 1 smallest ids of a code and searches a query code once, so a vector that a third of all
rows share costs no more than another. Nothing
is approximate, so recall is 1 by construction.

Scale: an index row is about 60 bytes a 64 dimensions; a shard holds about ``shard_rows`` codes and a part at most some
``MOST_QUERIES`` queries, so a task's memory is fixed. Codes travel as 16 bytes, to up to 16 tasks (see ``_parts``). Codes times queries are
compared but for those that no segment brings together; of random codes of 64 bits that is all but some hundredths.

Defined results: rows without an id or vector, or with another number of dimensions than the
first 64-bit multiple asked for, can't be compared and are neither queries nor answers; null elements count as
not positive; a query is never its own answer, but other rows of its code are; repeated ids are distinct rows; fewer than k
rows give fewer answers; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

U = np.uint64
#: Codes or probes looked at in one step of a search.
STEP = 1 << 18
#: A shard of so many codes has four segments a word, of 16 bits for 64; a smaller one has eight.
WIDE_FROM = 1 << 13
#: Pairs of a code and a query that make one more task, and queries that a task has at most.
TASK_PAIRS, MOST_QUERIES = 20_000_000, 1 << 17
ANSWER = "query_id long, vec_id long, distance int"


def _codes(df: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """id and an array of 64-bit words: bit j of word w is the sign of dimension 64 w + j."""
    kept = df.where(F.col(id_col).isNotNull() & (F.size(vector_col) == dims)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    words = []
    for w in range(0, dims, 64):
        bits = F.transform(F.slice("v", w + 1, min(64, dims - w)), lambda x, j: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    return kept.select("id", F.array(*words).alias("code"))


def _cuts(dims: int, per_word: int) -> list[tuple[int, int, int]]:
    """(word, shift, width) of every segment: each word's bits in ``per_word`` parts of about equal width."""
    out = []
    for w, bits in enumerate(min(64, dims - at) for at in range(0, dims, 64)):
        edges = [bits * i // min(per_word, bits) for i in range(min(per_word, bits) + 1)]
        out += [(w, lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return out


def _segment(words: np.ndarray, shift: int, width: int) -> np.ndarray:
    return ((words >> U(shift)) & U((1 << width) - 1)).astype(np.int64)


@cache
def _flips(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


def _smallest_ids(ids: np.ndarray, codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most that many rows of each code, those with the smallest ids: no answer needs more."""
    order = np.lexsort((ids, *codes.T))
    ids, codes = ids[order], codes[order]
    new = np.ones(len(ids), bool)
    new[1:] = (codes[1:] != codes[:-1]).any(axis=1)
    heads = np.flatnonzero(new)
    rank = np.arange(len(ids)) - np.repeat(heads, np.diff(np.append(heads, len(ids))))
    return ids[rank < most], codes[rank < most]


class MultiIndex:
    """Segment tables over a shard's codes, each with its own copy of the codes in the table's order."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, dims: int, segments: int | None = None):
        self.ids, self.cuts = ids, _cuts(dims, segments or (4 if len(ids) >= WIDE_FROM else 8))
        self.tables = []
        for w, shift, width in self.cuts:
            values = _segment(codes[:, w], shift, width)
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange((1 << width) + 1))
            self.tables.append((order.astype(np.int32), starts, [np.ascontiguousarray(c) for c in codes[order].T]))

    def _found(self, table: int, radius: int, queries: np.ndarray, active: np.ndarray, bound: np.ndarray):
        """(query, row, distance) of codes within a query's bound whose first segment met, by radius and table, is this one."""
        order, starts, columns = self.tables[table]
        w, shift, width = self.cuts[table]
        flips = _flips(width, radius)
        step = max(1, STEP // len(flips))
        for at in range(0, len(active), step):
            part = active[at : at + step]
            probe = _segment(queries[part, w], shift, width)[:, None] ^ flips
            a = starts[probe]
            n = starts[probe + 1] - a
            each = np.cumsum(n.sum(axis=1))
            i = 0
            while i < len(part):
                # as many queries as have STEP codes to compare, or one
                j = max(i + 1, int(np.searchsorted(each, (each[i - 1] if i else 0) + STEP, "right")))
                b, m = a[i:j].ravel(), n[i:j].ravel()
                total = np.diff(each[i:j], prepend=each[i - 1] if i else 0)
                place = np.repeat(b - (np.cumsum(m) - m), m)
                place += np.arange(len(place))
                mine = part[i:j]
                d = np.zeros(len(place), np.uint16)
                for k, c in enumerate(columns):
                    d += np.bitwise_count(c[place] ^ np.repeat(queries[mine, k], total))
                near = np.flatnonzero(d <= np.repeat(bound[mine], total))
                q = mine[np.searchsorted(np.cumsum(total), near, "right")]
                place, d = place[near], d[near]
                other = [columns[k][place] ^ queries[q, k] for k in range(len(columns))]
                new = np.ones(len(q), bool)
                for t, (v, lo, size) in enumerate(self.cuts):
                    if t != table:
                        new &= np.bitwise_count(_segment(other[v], lo, size)) >= radius + (t < table)
                yield q[new], order[place[new]], d[new]
                i = j

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the k nearest of every query, ties by id."""
        most = 64 * queries.shape[1]
        seen = np.zeros((len(queries), most + 1), np.int64)
        bound = np.full(len(queries), most, np.uint16)
        out = []
        for radius in range(max(width for _, _, width in self.cuts) + 1):
            for table, (_, _, width) in enumerate(self.cuts):
                # all codes within this many bits have been verified, each of them once
                covered = len(self.cuts) * radius + table - 1
                active = np.flatnonzero(bound.astype(np.int64) > covered)
                if radius > width or not len(active):
                    continue
                for q, r, d in self._found(table, radius, queries, active, bound):
                    out.append((q, r, d))
                    seen += np.bincount(q * (most + 1) + d, minlength=seen.size).reshape(seen.shape)
                full = np.cumsum(seen, axis=1) >= k
                bound = np.where(full.any(axis=1), full.argmax(axis=1), most).astype(np.uint16)
        q, r, d = (np.concatenate(c) for c in zip(*out, strict=True))
        close = d <= bound[q]
        q, r, d = q[close], r[close], d[close]
        order = np.lexsort((r, self.ids[r], d, q))
        q, r, d = q[order], r[order], d[order]
        heads = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q))))
        return q[rank < k], r[rank < k], d[rank < k].astype(np.int32)


def _near(index: MultiIndex, q_ids: np.ndarray, q_codes: np.ndarray, k: int, block: int):
    """The exact answers of queries among the codes of an index, in tables of a block of query codes."""
    codes, which = np.unique(q_codes, axis=0, return_inverse=True)
    by = np.argsort(which.ravel(), kind="stable")
    bounds = np.searchsorted(which.ravel()[by], np.arange(len(codes) + 1))
    for a in range(0, len(codes), block):
        q, r, d = index.search(codes[a : a + block], k + 1)
        order = np.lexsort((index.ids[r], d, q))
        q, r, d = q[order] + a, r[order], d[order]
        # the answers of a code go to all queries that have it, without themselves
        n = (bounds[1:] - bounds[:-1])[q]
        pick = np.repeat(np.arange(len(q)), n)
        query = q_ids[by[np.repeat(bounds[q] - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
        order = np.lexsort((pick, query))
        query, pick = query[order], pick[order]
        other = query != index.ids[r[pick]]
        query, pick = query[other], pick[other]
        heads = np.flatnonzero(np.diff(query, prepend=query[:1] - 1))
        rank = np.arange(len(query)) - np.repeat(heads, np.diff(np.append(heads, len(query))))
        query, pick = query[rank < k], pick[rank < k]
        yield pa.record_batch([pa.array(query), pa.array(index.ids[r[pick]]), pa.array(d[pick], pa.int32())], names=["query_id", "vec_id", "distance"])


def _search(k: int, segments: int | None, dims: int, block: int):
    """Exact answers of each task: a shard's codes and a part of the queries, taken in blocks."""

    def run(batches):
        held = []
        for b in batches:
            code = b.column("code").flatten().to_numpy().view(U).reshape(b.num_rows, -1)
            held.append((b.column("task").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False), b.column("id").to_numpy(), code))
        if not held:
            return
        tasks, asks, ids, codes = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        for task in np.unique(tasks):
            shard, queries = (tasks == task) & ~asks, (tasks == task) & asks
            if shard.any() and queries.any():
                yield from _near(MultiIndex(*_smallest_ids(ids[shard], codes[shard], k + 1), dims, segments), ids[queries], codes[queries], k, block)

    return run


def _parts(codes: int, queries: int) -> int:
    """Parts that queries are dealt to: for enough tasks 16 at most, which is how often an index row travels; more only for more than ``MOST_QUERIES`` a task."""
    return max(1, min(16, -(-codes * queries // TASK_PAIRS)), -(-queries // MOST_QUERIES))


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 20, dims: int = 64, segments: int | None = None, shard_rows: int = 1 << 20, block: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, vec_id, distance, rank: the k nearest codes of every row whose id is divisible by ``every``.

    segments: of each 64-bit word; without it their number follows from the codes of a shard.
    """
    codes = _codes(vectors, dims, id_col, vector_col)
    asks = F.col("id") % every == 0
    n, n_queries = codes.agg(F.count(F.lit(1)), F.count(F.when(asks, 1))).first()
    shards, parts = max(1, -(-n // shard_rows)), _parts(n, n_queries)
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(parts)).cast("int")
    # a row goes to all tasks of its shard and, as a query, to all of its part
    to_shard = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct((shard * parts + i).alias("task"), F.lit(False).alias("asks")))
    to_part = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct((i * parts + part).alias("task"), F.lit(True).alias("asks")))
    dealt = codes.select("id", "code", F.inline(F.when(asks, F.concat(to_shard, to_part)).otherwise(to_shard)))
    near = dealt.repartitionById(shards * parts, "task").mapInArrow(_search(k, segments, dims, block), ANSWER)
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
