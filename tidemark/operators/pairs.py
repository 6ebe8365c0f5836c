"""Pairs of the members of groups and nearest vectors: work that grows with a square, in tasks of bounded memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Members that a mapper packs at a time, pairs that a task forms at a time, rows of a batch that leaves.
LOT, STEP, BATCH = 1 << 20, 1 << 21, 1 << 18
_LISTS = "block int, own array<int>, skip array<int>, length array<int>, base long, wide boolean, peers binary"


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one run after another."""
    out = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out += np.arange(len(out))
    return out


def _packed(group: np.ndarray, peer: np.ndarray, bounds: np.ndarray, hot: int):
    """Whole groups, sorted -> rows of lists by block.

    Of a list the first ``own`` peers lie in the block; each meets those that follow it, from place ``skip`` on. A long
    group has its lists cut into lots of ``hot`` peers, each of which meets itself and every later one.
    """
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (peer[1:] != peer[:-1])
    group, peer = group[new], peer[new]
    block = np.searchsorted(bounds, peer, "right")
    ends = np.searchsorted(group, group, "right") if len(group) else group
    heads = np.flatnonzero(np.diff(group, prepend=group[:1] - 1).astype(bool) | np.diff(block, prepend=block[:1] - 1).astype(bool))
    stops = np.append(heads[1:], len(group))
    lists = np.stack([heads, stops - heads, ends[heads], heads * 0], axis=1)
    long = lists[:, 2] - lists[:, 0] > hot
    for lo, own, end, _ in lists[long].tolist() if long.any() else ():
        for a in range(lo, lo + own, hot):
            b = min(a + hot, lo + own)
            cross = [(a, b - a, min(c + hot, end), c) for c in range(b, end, hot)]
            lists = np.concatenate([lists, [(a, b - a, b, 0), *cross]])
    lists = lists[~np.append(long, np.zeros(len(lists) - len(long), bool))]
    # begin, own, end, and where the peers met begin if not right behind
    far = lists[:, 3] > 0
    length = np.where(far, lists[:, 1] + lists[:, 2] - lists[:, 3], lists[:, 2] - lists[:, 0])
    lists, far, length = lists[length > 1], far[length > 1], length[length > 1]
    of = block[lists[:, 0]]
    for b in np.unique(of):
        pick = of == b
        row, n, apart = lists[pick], length[pick], far[pick]
        starts = np.stack([row[:, 0], np.where(apart, row[:, 3], row[:, 0] + row[:, 1])], axis=1).ravel()
        items = peer[_places(starts, np.stack([row[:, 1], n - row[:, 1]], axis=1).ravel())]
        base = int(items.min())
        wide = int(items.max()) - base >= 1 << 32
        body = items.astype("<i8") if wide else (items - base).astype("<u4")
        yield int(b), row[:, 1], np.where(apart, row[:, 1], 0), n, base, wide, body.tobytes()


def _listed(bounds: np.ndarray, hot: int):
    def rows(group, peer):
        columns = list(zip(*_packed(group, peer, bounds, hot), strict=True))
        if columns:
            kinds = (pa.int32(), *[pa.list_(pa.int32())] * 3, pa.int64(), pa.bool_(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["block", "own", "skip", "length", "base", "wide", "peers"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= LOT:
                group, peer = (np.concatenate(c) for c in zip(*held, strict=True))
                last = int(np.searchsorted(group, group[-1]))
                yield from rows(group[:last], peer[:last])
                group, peer = group[last:], np.unique(peer[last:])
                held, n = [(group[: len(peer)], peer)], 0
        if held:
            yield from rows(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _met(own: np.ndarray, skip: np.ndarray, length: np.ndarray, peers: np.ndarray):
    """Distinct (a, b) of the lists of one block, a smaller than b, some whole a at a time."""
    values, dense = np.unique(peers, return_inverse=True)
    begin = np.cumsum(length) - length
    at = _places(begin, own)
    begin, skip, length = (np.repeat(x, own) for x in (begin, skip, length))
    start = np.maximum(at + 1, begin + skip)
    n = begin + length - start
    order = np.argsort(dense[at], kind="stable")
    a, start, n = dense[at][order], start[order], n[order]
    heads = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
    total = np.append(0, np.cumsum(n))
    i = 0
    while i < len(heads) - 1:
        j = max(i + 1, int(np.searchsorted(total[heads], total[heads[i]] + STEP, "right")) - 1)
        names = a[heads[i:j]]
        found = np.zeros(0, np.int64)
        x = int(heads[i])
        while x < heads[j]:
            # one a with more partners than a step holds is taken in several
            y = max(x + 1, min(int(heads[j]), int(np.searchsorted(total, total[x] + STEP, "right")) - 1))
            key = np.repeat(np.searchsorted(names, a[x:y]) * len(values), n[x:y])
            key += dense[_places(start[x:y], n[x:y])]
            if len(names) * len(values) <= 4 * STEP:
                seen = np.zeros(len(names) * len(values), bool)
                seen[key] = True
                seen[found] = True
                found = np.flatnonzero(seen)
            else:
                found = np.unique(np.concatenate([found, key]))
            x = y
        yield values[names[found // len(values)]], values[found % len(values)]
        i = j


def _pairs(batches):
    held: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            peers = np.frombuffer(r["peers"], "<i8") if r["wide"] else np.frombuffer(r["peers"], "<u4").astype(np.int64) + r["base"]
            held.setdefault(r["block"], []).append((np.array(r["own"]), np.array(r["skip"]), np.array(r["length"]), peers))
    while held:
        lists = held.popitem()[1]
        for a, b in _met(*(np.concatenate(c) for c in zip(*lists, strict=True))):
            for i in range(0, len(a), BATCH):
                x, y = pa.array(a[i : i + BATCH]), pa.array(b[i : i + BATCH])
                yield pa.record_batch([x, y], names=["a", "b"])
                yield pa.record_batch([y, x], names=["a", "b"])


def co_members(members: DataFrame, group: str, peer: str, hot: int = 1000, block_rows: int = 500_000) -> DataFrame:
    """a, b: every ordered pair of different peers that share a group; groups and peers are whole numbers.

    Pairs are never shuffled. A range of peers is a block; a group's sorted peers go once to each block that holds
    one of them, from that one on, as packed numbers. A block forms its pairs a bounded number at a time, whole
    peers together, so they are distinct as they leave. A task holds its block's lists, a mapper one group's peers.
    Rows without a group or peer meet nothing.
    """
    kind = members.schema[peer].dataType
    g = members.select(F.col(group).cast("long").alias("grp"), F.col(peer).cast("long").alias("peer")).where("grp is not null and peer is not null")
    blocks = min(20_000, max(16, g.count() // block_rows))
    cuts = g.select("peer").distinct().agg(F.percentile_approx("peer", [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))
    sorted_groups = g.repartition("grp").sortWithinPartitions("grp", "peer")
    lists = sorted_groups.mapInArrow(_listed(bounds, hot), _LISTS).repartitionById(len(bounds) + 1, "block")
    return lists.mapInArrow(_pairs, "a long, b long").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))


#: Vectors of a tile and queries of a block, whose products are formed at a time; pairs that make one more shard; a task's most queries.
TILE, ASKED, SHARD_PAIRS, MOST_QUERIES = 4096, 256, 100_000_000, 1 << 17


def _few_of_each(ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Places of at most so many rows of each vector, those with the smallest ids."""
    order = np.argsort(ids, kind="stable")
    _, which = np.unique(np.ascontiguousarray(rows[order]).view(f"V{rows.shape[1] * rows.itemsize}").ravel(), return_inverse=True)
    by = np.argsort(which, kind="stable")
    heads = np.flatnonzero(np.diff(which[by], prepend=-1))
    rank = np.arange(len(by)) - np.repeat(heads, np.diff(np.append(heads, len(by))))
    return np.sort(order[by[rank < most]])


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows over their norms, and which rows have a norm to go by."""
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))
    sound = np.isfinite(norm) & (norm > 0)
    return (rows / np.where(sound, norm, 1.0)[:, None]).astype(np.float32), sound


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows beside each other, summed up in their order."""
    xy, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for i in range(x.shape[1]):
        a, b = x[:, i].astype(np.float64), y[:, i].astype(np.float64)
        xy, xx, yy = xy + a * b, xx + a * a, yy + b * b
    return xy / (np.sqrt(xx) * np.sqrt(yy))


def _candidates(ids: np.ndarray, unit: np.ndarray, q_ids: np.ndarray, q_unit: np.ndarray, k: int):
    """(query, row) whose products are within twice their error and a rounding of the query's kth."""
    slack = 4 * (unit.shape[1] + 8) * 2.0**-24 + 3e-6
    best = np.full((len(q_ids), k), -4, np.float32)
    out = []
    for at in range(0, len(ids), TILE):
        part = ids[at : at + TILE]
        s = q_unit @ unit[at : at + TILE].T
        by = np.argsort(part, kind="stable")
        lo, hi = (np.searchsorted(part[by], q_ids, side) for side in ("left", "right"))
        for i in np.flatnonzero(hi > lo):
            s[i, by[lo[i] : hi[i]]] = -9
        if not at and len(part) >= k:
            best = np.partition(s, -k, axis=1)[:, -k:].clip(-4)
        floor = np.maximum(best.min(axis=1) - slack, -2).astype(np.float32)
        q, r = np.divmod(np.flatnonzero((s >= floor[:, None]).ravel()), len(part))
        value = s[q, r]
        out.append((q, r + at, value))
        if at or len(part) < k:
            # the k largest of those so far and of this tile
            rows, values = np.concatenate([np.repeat(np.arange(len(q_ids)), k), q]), np.concatenate([best.ravel(), value])
            order = np.lexsort((-values, rows))
            heads = np.searchsorted(rows[order], np.arange(len(q_ids)))
            best = values[order[heads[:, None] + np.arange(k)]]
    q, r, value = (np.concatenate(c) for c in zip(*out, strict=True))
    near = value >= best.min(axis=1)[q] - slack
    return q[near], r[near]


def _first_others(ids: np.ndarray, q_ids: np.ndarray, k: int):
    """(query, row) of the k smallest ids that are not the query's own."""
    if not len(ids) or not len(q_ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    lo, hi = (np.searchsorted(ids[order], q_ids, side) for side in ("left", "right"))
    place = np.arange(k)[None, :]
    place = place + np.where(place >= lo[:, None], (hi - lo)[:, None], 0)
    ok = place < len(ids)
    return np.nonzero(ok)[0], order[place[ok]]


def _nearest(ids: np.ndarray, dims: np.ndarray, rows: dict, q_ids: np.ndarray, q_dims: np.ndarray, q_rows: dict, k: int):
    """(query id, row id, cosine, whether it is null) among which each query's k nearest of these rows are.

    rows, q_rows: matrices by dimension, in the order of the ids that have it. A null cosine comes last, NaN first.
    """
    for d in np.unique(q_dims).tolist():
        mine, same = q_ids[q_dims == d], (dims == d) & (d > 0)
        others = ids[~same]
        q, r = _first_others(others, mine, k)
        yield mine[q], others[r], np.full(len(q), np.nan), np.ones(len(q), bool)
        if not same.any():
            continue
        here, x, asked = ids[same], rows[d], q_rows[d]
        unit, sound = _unit(x)
        even = np.flatnonzero(sound)
        even = even[_few_of_each(here[even], x[even], k + 1)] if len(even) else even
        odd, own, unit, x = here[~sound], here[even], unit[even], x[even]
        for a in range(0, len(mine), ASKED):
            name, vector = mine[a : a + ASKED], asked[a : a + ASKED]
            turned, normed = _unit(vector)
            for who, among in ((name[normed], odd), (name[~normed], here)):
                q, r = _first_others(among, who, k)
                yield who[q], among[r], np.full(len(q), np.nan), np.zeros(len(q), bool)
            if normed.any() and len(own):
                q, r = _candidates(own, unit, name[normed], turned[normed], k)
                yield name[normed][q], own[r], _cosines(vector[normed][q], x[r]), np.zeros(len(q), bool)


def _nearest_in(k: int):
    def vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray, dict]:
        dims = t["dims"].to_numpy()
        return t["id"].to_numpy(), dims, {d: pc.list_flatten(t["v"].filter(pa.array(dims == d))).to_numpy().reshape(-1, d) for d in np.unique(dims).tolist() if d > 0}

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        held = pa.Table.from_batches(batches)
        batches.clear()
        for task in np.unique(held["task"].to_numpy()).tolist():
            t = held.filter(pc.equal(held["task"], task))
            for q, r, cosine, null in _nearest(*vectors(t.filter(pc.invert(t["asks"]))), *vectors(t.filter(t["asks"])), k):
                yield pa.record_batch([pa.array(q, pa.int64()), pa.array(r, pa.int64()), pa.array(cosine, pa.float64(), mask=null)], names=["query_id", "vec_id", "cosine"])

    return run


def nearest_by_cosine(vectors: DataFrame, id_col: str, vector_col: str, *, k: int = 5, every: int = 20, shard_rows: int = 1 << 17) -> DataFrame:
    """query_id, vec_id, cosine (to six places), place: the k nearest of every row whose id is divisible by ``every``, ties by the smaller id.

    Rows are dealt into shards and queries sent to each. A task multiplies blocks of queries with tiles of its shard in single precision, keeps what
    is within the error of a query's kth product, and sums those up in double precision; of a repeated vector the k + 1 smallest ids
    stand for all. All pairs are compared, which is quadratic; a task holds one shard and at most about ``MOST_QUERIES`` queries.
    A cosine is null for a null vector or element and for unlike dimensions, and then comes last; it is NaN for a zero vector or one with NaN or infinity,
    and comes first, as in SQL. Rows without an id take no part; repeated ids are distinct rows that don't answer each other.
    """
    v = F.col(vector_col)
    kind = vectors.schema[id_col].dataType
    e = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.when(v.isNull() | F.exists(v, lambda x: x.isNull()), -1).otherwise(F.size(v)).alias("dims"), v.alias("v"))
    asks = F.col("id") % every == 0
    n, n_queries = e.agg(F.count(F.lit(1)), F.count(F.when(asks, 1))).first()
    shards = max(1, -(-n // shard_rows), min(16, -(-n * n_queries // SHARD_PAIRS)))
    parts = max(1, -(-n_queries // MOST_QUERIES))
    shard, part = (F.pmod(F.xxhash64(F.lit(what), "id"), F.lit(m)).cast("int") for what, m in (("shard", shards), ("part", parts)))
    to_shard = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct((shard * parts + i).alias("task"), F.lit(False).alias("asks")))
    to_part = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct((i * parts + part).alias("task"), F.lit(True).alias("asks")))
    dealt = e.select("id", "dims", "v", F.inline(F.when(asks, F.concat(to_shard, to_part)).otherwise(to_shard)))
    near = dealt.repartitionById(shards * parts, "task").mapInArrow(_nearest_in(k), "query_id long, vec_id long, cosine double")
    near = near.withColumn("cosine", F.round("cosine", 6))
    best = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    placed = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return placed.select(F.col("query_id").cast(kind).alias("query_id"), F.col("vec_id").cast(kind).alias("vec_id"), "cosine", "place")
