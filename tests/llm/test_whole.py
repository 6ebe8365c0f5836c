"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import exchange, hamming_topk, mixing, packing, parity_join, repeats, store, suffix_dedup
from tidemark.llm.license_scan import license_detections, rules


def test_mix_keeps_its_target_weights(spark):
    """One source at half the weight beside 299 others: at every slot each is within less than a block of its target."""
    docs = spark.createDataFrame([(i, "big" if i < 598 else f"s{i % 299}") for i in range(4 * 299)], "doc_id long, source string")
    weights = {"big": 299} | {f"s{k}": 1 for k in range(299)}
    out = mixing.mix_sources(docs, weights=weights, block=1).orderBy("slot").collect()
    assert [r["slot"] for r in out] == list(range(len(out)))
    total, done = sum(weights.values()), Counter()
    for t, r in enumerate(out):
        done[r["source"]] += 1
        assert all(abs(done[s] - Fraction((t + 1) * w, total)) < 1 for s, w in weights.items())


def test_sources_that_run_out_leave_their_share_to_the_others():
    blocks, weights = {"a": 40, "b": 10, "c": 400}, {"a": 0.4, "b": 0.4, "c": 0.2}
    order = list(mixing.schedule(blocks, weights))
    assert Counter(order) == blocks
    # b ends at slot 25 with 10 of a and 5 of c done; then a has two thirds until its end at slot 70
    for t, want in ((25, {"a": 10, "b": 10, "c": 5}), (70, {"a": 40, "b": 10, "c": 20})):
        assert all(abs(order[:t].count(s) - n) < 1 for s, n in want.items())


def test_a_plan_in_parts_is_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "abcde"[i % 7 % 5]) for i in range(500)], "doc_id long, source string")
    whole = mixing.mix_sources(docs, block=2, frame=10)
    monkeypatch.setattr(mixing, "MOST_PLANNED", 50)
    assert whole.exceptAll(mixing.mix_sources(docs, block=2, frame=10)).count() == 0


def test_packed_sequences_follow_the_mix(spark):
    """Weights 2 : 1 until b runs out after 2,400 of 4,000 documents: every shard before that holds a third of b."""
    docs = spark.createDataFrame([(i, f"word {i} " * (1 + i % 90), "en", "b" if i % 5 == 0 else "a", 1) for i in range(4000)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.store.save(corpus_pipeline.mixing(spark, docs.repartition(3), ""), "mix")
    place = {r["doc_id"]: r["position"] for r in mixing.mix_sources(docs).collect()}
    placed = corpus_pipeline.in_file_order(spark, mixed).orderBy("position").collect()
    assert [r["position"] for r in placed] == list(range(4000)) and [r["doc_id"] for r in placed] == sorted(place, key=place.get)
    packed = packing.best_fit_pack(corpus_pipeline.in_file_order(spark, mixed), position="position", shard_items=400).collect()
    shards: dict = {}
    for r in packed:
        shards.setdefault(r["sequence_id"] >> 32, []).append(r)
    assert sorted(shards) == list(range(10)) and len({r["doc_id"] for r in packed}) == 4000
    for k, rows in shards.items():
        b = sum(r["doc_id"] % 5 == 0 for r in rows)
        assert abs(b - (len(rows) / 3 if k < 6 else 0)) <= 32, (k, b, len(rows))
        opened = [place[r["doc_id"]] for r in sorted(rows, key=lambda r: r["sequence_id"]) if r["offset"] == 0]
        assert opened == sorted(opened)
    order = [r["doc_id"] % 5 == 0 for r in sorted(corpus_pipeline.best_fit_packing(spark, mixed, "").collect(), key=lambda r: r["sequence_id"]) if r["offset"] == 0]
    assert abs(sum(order[: len(order) // 2]) / (len(order) // 2) - 1 / 3) < 0.1 and sum(order[-len(order) // 4 :]) == 0


def forms(parsed) -> list[str]:
    """Texts that a rule's pattern matches: every alternative, and optional parts both with and without."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [chr(v) if str(k) == "LITERAL" else chr(v[0]) for k, v in arg]
        elif name == "SUBPATTERN":
            more = forms(arg[-1])
        elif name == "BRANCH":
            more = [f for branch in arg[1] for f in forms(branch)]
        elif name == "MAX_REPEAT":
            more = [*([""] if arg[0] == 0 else []), *(f * max(1, arg[0]) for f in forms(arg[2]))]
        else:
            assert name == "ASSERT_NOT", name
            more = [""]
        out = [a + b for a in out for b in more]
    return out


def test_every_rule_is_tried_on_all_it_matches(spark):
    texts = {}
    for number, _, keyword, _, _, pattern in rules():
        assert len(found := forms(re._parser.parse(pattern))) > 0
        for f in found:
            assert re.fullmatch(pattern, f) and keyword in f, (keyword, f)
        texts[number] = found[len(found) // 2]
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").repartition(8)
    names = ("doc_id", "labels", "score", "detections")
    gated, whole = ({r["doc_id"]: r for r in license_detections(docs, gated=g).select(*names).collect()} for g in (True, False))
    assert gated == whole and all(r["detections"] for r in gated.values())


@pytest.mark.parametrize(("text", "label"), [("released under the GNU GPL", "gpl"), ("It may not be reproduced.", "no-redistribution"), ("GNU Library General Public License", "lgpl"), ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit")])
def test_license_wordings_without_the_family_keyword(spark, text, label):
    assert label in license_detections(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"].split(",")


def test_multi_index_verifies_each_code_once_and_few_of_them():
    r = np.random.default_rng(12)
    codes = r.integers(0, 1 << 63, (20_000, 1)).astype(np.uint64)
    index = hamming_topk.MultiIndex(np.arange(20_000), codes, 64)
    found = index._found
    index.met = 0

    def counted(table, radius, queries, active, bound):
        for q, row, d in found(table, radius, queries, active, bound):
            assert len(set(zip(q.tolist(), row.tolist(), strict=True))) == len(q)
            index.met += len(q)
            yield q, row, d

    index._found = counted
    q, row, d = index.search(codes[:40], 11)
    far = np.bitwise_count(codes[:40] ^ codes.T)
    for i in range(40):
        want = np.lexsort((np.arange(20_000), far[i]))[:11]
        assert row[q == i].tolist() == want.tolist() and d[q == i].tolist() == far[i][want].tolist()
    assert index.met < 40 * 20_000 / 10


def test_top_k_deals_queries_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(hamming_topk, "TASK_PAIRS", 1000)
    e = np.random.default_rng(13).normal(size=(600, 70))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "vec_id long, embedding array<double>")
    got = {tuple(x) for x in hamming_topk.top_k(df, dims=70, shard_rows=250).collect()}
    want = set()
    for q in range(0, 600, 20):
        d = ((e > 0) != (e[q] > 0)).sum(axis=1)
        want |= {(q, int(j), int(d[j]), k + 1) for k, j in enumerate([j for j in np.lexsort((np.arange(600), d)) if j != q][:10])}
    assert got == want and hamming_topk._parts(600, 30) > 1


def test_unique_keys_do_not_fill_the_bitmap(spark, monkeypatch):
    """Far more unique keys than bits: those that occur twice all pass, and few others do."""
    monkeypatch.setattr(repeats, "MOST_BITS", 14)
    r = np.random.default_rng(21)
    keys = r.integers(0, 1 << 63, 200_000).astype(np.uint64)
    again = keys[:1000]
    ranges = repeats.ranges_for(201_000)
    rows = [x for lot, part in enumerate((keys, again)) for x in repeats.key_rows(part, ranges, lot)]
    bitmap = repeats.repeated_keys(spark.createDataFrame(rows, exchange.SCHEMA), 201_000, ranges)
    assert bitmap.size * 8 <= 1 << 14
    passed = repeats.maybe_repeated(keys, bitmap, ranges)
    assert passed[:1000].all() and passed[1000:].mean() < 0.1


def test_byte_runs_of_squeezed_texts(spark):
    """The join in which texts travel compressed gives what the broadcast one does."""
    r = np.random.default_rng(22)
    texts = ["".join(r.choice(list("abcdefgh é"), 300)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, "x" * i + t[40:200] + "ü") for i, t in enumerate(texts)] + [(500, None), (None, texts[0]), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    near, far = (sorted(map(str, suffix_dedup.drop_repeated_bytes(df, most_broadcast=m).collect())) for m in (16 << 20, 0))
    assert near == far and not all("n_removed=0" in x for x in near)


def test_a_scan_of_large_batches_holds_lots_of_bounded_size(monkeypatch):
    """One batch of some 900,000 keys leaves in lots of about LOT_KEYS, whatever the batch's size."""
    monkeypatch.setattr(exchange, "lot_id", lambda number: number)
    texts = [" ".join(f"{i}.{k}" for k in range(3000)) for i in range(900)]
    batch = pa.record_batch([pa.array(range(900), pa.int64()), pa.array(range(900), pa.int64()), pa.array(texts)], names=["doc_id", "print", "text"])
    lots, docs = Counter(), []
    for out in parity_join._scan(5, 75, 4)([batch]):
        for lot, kind, load in zip(out["lot"].to_pylist(), out["kind"].to_pylist(), out["load"].to_pylist(), strict=True):
            if kind == exchange.ITEMS:
                lots[lot] += len(exchange.unpack(load)[3])
            else:
                docs += exchange.unpack(load)[0].tolist()
    assert docs == list(range(900)) and sum(lots.values()) > 2 * parity_join.LOT_KEYS
    assert max(lots.values()) < parity_join.LOT_KEYS + exchange.LOT_ITEMS // 20


def test_keys_looked_at_in_ranges_are_all_the_shared_ones(monkeypatch):
    rng = np.random.default_rng(7)
    loads, pairs = [], set()
    for _ in range(5):
        node, counts = rng.permutation(60)[:40], rng.integers(1, 30, 40)
        key = rng.choice(np.array([k << 36 | k for k in range(1, 1200)], np.uint64), counts.sum())
        pairs |= set(zip(key.tolist(), np.repeat(node, counts).tolist(), strict=True))
        loads.append(exchange.pack(node.astype(np.int64), counts.astype(np.uint16), (key >> np.uint64(32)).astype(np.uint16), key.astype(np.uint32)))
    n = Counter(k for k, _ in pairs)
    for most in (1 << 18, 100, 7):
        monkeypatch.setattr(parity_join, "LOT_KEYS", most)
        node, key = parity_join._shared_keys(loads)
        assert list(zip(key.tolist(), node.tolist(), strict=True)) == sorted((k, d) for k, d in pairs if n[k] > 1)
    assert len(parity_join._shared_keys(loads[:0])[0]) == 0


def test_saved_functions_get_small_batches_and_the_setting_returns(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 1000).alias("t"))
    before = spark.conf.get(store.BATCH_SETTING, None)
    saved = store.save(rows.mapInArrow(sizes, "n long"), "sizes", 1 << 18)
    assert max(r["n"] for r in saved.collect()) < 300_000 and spark.conf.get(store.BATCH_SETTING, None) == before


def test_plain_chunks_pass_by_the_whole_tokenizer(monkeypatch):
    """Runs of letters, digits and punctuation are encoded by the model alone, with the public tokenizer's ids."""
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    public, calls = tokenizers.Tokenizer.from_file(path), []

    class Counted:
        from_file = classmethod(lambda cls, path: cls())

        def __getattr__(self, name):
            return getattr(public, name)

        def encode(self, text, **how):
            calls.append(text)
            return public.encode(text, **how)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    encoder = packing.TokenEncoder(path)
    rng = np.random.default_rng(8)
    ids = lambda text: np.frombuffer(encoder([text])[0], "<u4").tolist()
    for i in range(300):
        text = " ".join(f"Wört{k}er{i},\nÜber-all_{k}... (no.{i * k})***" for k in rng.integers(0, 10**6, 5))
        assert ids(text) == public.encode(text, add_special_tokens=False).ids
    assert not calls
    every = [chr(c) for c in range(1, 400)] + [" ", "  ", "\n", "\n\n", "'ll", "|", "<|endoftext|>", "\u0301", "\u2003", "ab", "12"] * 20
    for _ in range(3000):
        text = "".join(rng.choice(every, rng.integers(0, 30)))
        assert ids(text) == public.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_that_come_again_outlive_many_that_come_once():
    asked = []
    memo = packing._Memo(lambda text: asked.append(text) or text.encode(), 100)
    for i in range(5000):
        assert memo["often"] == b"often" and memo[f"once{i}"] == f"once{i}".encode()
        assert len(memo) + len(memo.older) <= 200
    assert asked.count("often") == 1
