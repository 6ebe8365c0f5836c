"""Queries that once ran over a subset of ids, groups or quarters have a form over all of them."""

import math

import numpy as np
from oracle import DATA, duck

from tidemark.operators import pairs
from tidemark.plans import models, registry

SF = f"{DATA}/sf0.001"


def test_every_customer_has_a_grid(spark):
    n = duck("sf0.001").sql("select count(*) from customer").fetchall()[0][0]
    out = registry.queries()["sensitivity_grid"](spark, SF)
    assert n > 50 and out.select("entity").distinct().count() == n and out.count() == 25 * n


def test_pairs_of_all_parts_also_in_lots(spark):
    want = set(duck("sf0.001").sql("select distinct x.l_suppkey, y.l_suppkey from lineitem x join lineitem y using (l_partkey) where x.l_suppkey <> y.l_suppkey").fetchall())
    for hot in (1000, 3):
        got = [tuple(r) for r in models.co_pairs(spark, SF, hot).collect()]
        assert set(got) == want and len(got) == len(want)


def test_every_quarter_has_deciles(spark):
    n = duck("sf0.001").sql("select count(distinct last_day(date_trunc('quarter', o_orderdate) + interval 2 month)) from orders").fetchall()[0][0]
    assert registry.queries()["reversion_deciles"](spark, SF).select("qtr").distinct().count() == n > 1


def test_pairs_travel_as_lists(spark):
    """A part of 300 suppliers makes 89,700 pairs; no exchange holds them, only its lists, once a block."""
    rows = [(g, s) for g in range(20) for s in range(300)] + [(None, 1), (99, None), (50, 7), (51, -(1 << 40)), (51, 1 << 40)]
    df = spark.createDataFrame(rows, "l_partkey long, l_suppkey long")
    for hot in (1000, 7):
        out = pairs.co_members(df, "l_partkey", "l_suppkey", hot)
        got = [tuple(r) for r in out.collect()]
        want = {(a, b) for a in range(300) for b in range(300) if a != b} | {(-(1 << 40), 1 << 40), (1 << 40, -(1 << 40))}
        assert set(got) == want and len(got) == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Join" not in plan


def test_pairs_of_a_peer_with_more_partners_than_a_step(spark, monkeypatch):
    monkeypatch.setattr(pairs, "STEP", 50)
    own, skip, length = np.array([3, 2]), np.array([0, 0]), np.array([90, 40])
    peers = np.concatenate([np.arange(90), np.arange(0, 80, 2)])
    got = [x for a, b in pairs._met(own, skip, length, peers) for x in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in range(3) for b in range(a + 1, 90)} | {(a, b) for a in (0, 2) for b in range(a + 2, 80, 2)}


def test_nearest_of_odd_repeated_and_many_vectors(spark, monkeypatch):
    """Against plain cosines, with copies, zeros, nulls, unlike dimensions and shards smaller than a tile; no join of queries with vectors."""
    monkeypatch.setattr(pairs, "SHARD_PAIRS", 1000)
    monkeypatch.setattr(pairs, "TILE", 50)
    e = np.random.default_rng(3).normal(size=(400, 8))
    e[100:160], e[180:190], e[200] = e[100], e[181] * (1 + 1e-9), 0
    vectors = {i: e[i].tolist() for i in range(400)} | {401: None, 402: [1.0], 420: [None] * 8, 440: [2.0], 460: [float("nan")] * 8}
    df = spark.createDataFrame([*vectors.items(), (None, [1.0] * 8)], "vec_id long, embedding array<double>")

    def cosine(x, y):
        if x is None or y is None or None in x or None in y or len(x) != len(y):
            return None
        norm = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y))
        return round(sum(a * b for a, b in zip(x, y, strict=True)) / norm, 6) if norm and not math.isnan(norm) else math.nan

    def order(c, j):
        return (2, 0, j) if c is None else (0, 0, j) if math.isnan(c) else (1, -c, j)

    want = {}
    for q in (i for i in vectors if i % 20 == 0):
        every = sorted(order(cosine(vectors[q], y), j) for j, y in vectors.items() if j != q)
        want |= {(q, k + 1): (j, level, round(-c, 6)) for k, (level, c, j) in enumerate(every[:5])}
    out = pairs.nearest_by_cosine(df, "vec_id", "embedding")
    got = {(r.query_id, r.place): (r.vec_id, *order(r.cosine, 0)[:2]) for r in out.collect()}
    assert {k: (j, level, round(-c, 6)) for k, (j, level, c) in got.items()} == want
    assert "NestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert pairs.nearest_by_cosine(df.limit(0), "vec_id", "embedding").count() == 0
