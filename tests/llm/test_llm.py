"""Operators on text against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hamming_topk, mixing, packing, parity_join, suffix_array
from tidemark.llm.license_scan import license_detections, rules
from tidemark.llm.line_dedup import drop_repeated_lines
from tidemark.llm.ordinal import classify, fit, graded, train
from tidemark.llm.quality_rules import quality_verdicts
from tidemark.llm.repeated_windows import drop_repeated_words
from tidemark.llm.suffix_dedup import drop_repeated_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def corpus(seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    lines = "\n".join(" ".join(word() for _ in range(9)) for _ in range(4))
    texts: list = [None, "", " \n\t ", "one", "one two", "One TWO", "a b c d e", "x " * 300, "All rights reserved. CC-BY 4.0", "é" * 200, "a <|endoftext|> b"]
    for _ in range(25):
        body = " ".join(word() for _ in range(r.randint(5, 160)))
        texts.append(body)
        if r.random() < 0.5:
            texts.append(body + " " + passage)
        if r.random() < 0.4:
            texts.append(body)
        if r.random() < 0.4:
            w = body.split(" ")
            w[len(w) // 2] = "changed"
            texts.append(" ".join(w))
        if r.random() < 0.3:
            texts.append(lines + "\n\n" + body + "\n" + lines)
    texts.append(" ".join(word() for _ in range(30000)))
    rows = [(i, t, r.choice(["en", "fr", None, "xx"]), r.choice(["a", "a", "a", None, "b"]), None, "clash") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, passage, "en", "a", 1, "x")]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def counted(df, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


def test_quality_counts(docs, rows, empty):
    want = collections.Counter()
    for d, t, *_ in rows:
        w = split(t)
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want[(d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), failed)] += 1
    out = quality_verdicts(docs)
    assert counted(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert out.where("base_failed and kept").count() == 0
    assert quality_verdicts(empty).count() == 0


def test_license_places(docs, rows, empty):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    want = collections.Counter()
    for d, t, *_ in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if " ".join(w[i : i + p.count(" ") + 1]) == p]
        want[(d, len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({x for _, x in at})))] += 1
    assert counted(license_detections(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    assert license_detections(empty).count() == 0


def test_license_rules(spark):
    assert len(rules()) >= 150
    texts = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "GNU General Public License, version 3. cc by nc 4.0", "copyright is a word"]
    got = [r["labels"] for r in license_detections(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["apache-2.0", "mit", "cc-by,cc-by-nc-4.0,gpl,gpl-3", ""]


def test_line_dedup(docs, rows, empty):
    keyed = {(d, t): t.split("\n") for d, t, *_ in rows if d is not None and t is not None}
    ink = {k: [i for i, x in enumerate(v) if split(x)] for k, v in keyed.items()}
    first: dict = {}
    alone: dict = {}
    for k in sorted(keyed):
        for p, i in enumerate(ink[k]):
            alone.setdefault(keyed[k][i], (k[0], p))
        for p in range(len(ink[k]) - 1):
            first.setdefault((keyed[k][ink[k][p]], keyed[k][ink[k][p + 1]]), (k[0], p))
    want = collections.Counter()
    for d, t, *_ in rows:
        if d is None or t is None:
            want[(d, t)] += 1
            continue
        v, at, gone = keyed[(d, t)], ink[(d, t)], set()
        for p in range(len(at) - 1):
            f = first[(v[at[p]], v[at[p + 1]])]
            if d > f[0] or p >= f[1] + 2:
                for q in (p, p + 1):
                    gone |= set(range(at[q], at[q + 1] if q + 1 < len(at) else len(v)))
        for q, i in enumerate(at):
            if len(split(v[i])) >= 50 and (d, q) > alone[v[i]]:
                gone |= set(range(at[q], at[q + 1] if q + 1 < len(at) else len(v)))
        want[(d, "\n".join(x for i, x in enumerate(v) if i not in gone))] += 1
    out = drop_repeated_lines(docs)
    assert counted(out, "doc_id", "text") == want and out.where("n_removed_lines > 0").count() > 0
    runs: dict = {}
    for k, v in keyed.items():
        s = [v[i] for i in ink[k]]
        for a in range(len(s)):
            for n in range(1, len(s) - a + 1):
                runs.setdefault(tuple(s[a : a + n]), set()).add((k, a))
    longest = collections.Counter((k[0], max([len(r) for r, at in runs.items() if len(at) > 1 and any(x[0] == k for x in at)], default=0)) for k in keyed)
    assert set(counted(out.where("doc_id is not null and text is not null"), "doc_id", "longest_run")) >= set(longest) - {x for x in longest if x[0] in {d for d, t, *_ in rows if t is None}}
    assert drop_repeated_lines(docs, most_broadcast=0).exceptAll(out).count() == 0
    assert drop_repeated_lines(empty).count() == 0


def _removed(sequences, size):
    """(id, sequence) -> which items are covered by a window that a smaller id starts too."""
    least: dict = {}
    for d, s in sequences:
        if d is not None:
            for i in range(len(s) - size + 1):
                k = tuple(s[i : i + size])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - size + 1) if d is not None else ():
            if least[tuple(s[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


def test_repeated_words(docs, rows, empty):
    seqs = [(r[0], split(r[1])) for r in rows]
    want = collections.Counter()
    for (d, s), gone in zip(seqs, _removed(seqs, 50), strict=True):
        kept = " ".join(w for w, g in zip(s, gone, strict=True) if not g)
        want[(d, len(s), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert counted(drop_repeated_words(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert counted(drop_repeated_words(docs, most_broadcast=0), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert drop_repeated_words(empty).count() == 0


def test_repeated_bytes(docs, rows, empty):
    seqs = [(r[0], (r[1] or "").encode()) for r in rows]
    want = collections.Counter()
    for (d, s), gone in zip(seqs, _removed(seqs, 50), strict=True):
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want[(d, len(s), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(s, gone, strict=True) if not g)).hexdigest())] += 1
    assert counted(drop_repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert drop_repeated_bytes(empty).count() == 0


def test_suffix_array():
    r = np.random.default_rng(1)
    for _ in range(120):
        text = r.integers(0, r.integers(1, 5), r.integers(1, 120)).astype(np.uint8)
        order = suffix_array.suffix_array(text, 200)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text.tobytes()[i:])
        shared = suffix_array.permuted_prefixes(text, order, 56)
        for a, b in zip(order[:-1], order[1:], strict=True):
            x, y = text.tobytes()[a:], text.tobytes()[b:]
            same = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert shared[b] == min(same, 56)


def test_jaccard_groups(docs, rows, empty):
    sets, parent = {}, {}
    for d, t, *_ in rows:
        if d is not None:
            w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
            parent[d] = d

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = collections.Counter((r[0], len(sets[r[0]]), root(r[0])) if r[0] is not None else (None, None, None) for r in set(rows) | set())
    got = counted(parity_join.near_duplicate_groups(docs), "doc_id", "n_shingles", "component_id")
    assert set(got) == set(want)
    assert parity_join.near_duplicate_groups(empty).count() == 0


def test_parity_sketch_never_exceeds_the_sets():
    r = np.random.default_rng(2)
    for n in (3, 900, 1100, 5000):
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 4], r.integers(0, 1 << 63, n // 5).astype(np.uint64)])
        one, two = (parity_join.parity_bits(np.zeros(len(x), np.int64), x, np.array([len(x)])).tobytes() for x in (a, b))
        assert parity_join.sketch_distance(one, two) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_top_k(spark):
    r = np.random.default_rng(4)
    e = r.normal(size=(400, 64)).astype(float)
    e[100:160] = e[100]
    rows = [(i, e[i].tolist()) for i in range(400)] + [(None, e[0].tolist()), (401, None), (402, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = set()
    for q in range(0, 400, 20):
        d = ((e > 0) != (e[q] > 0)).sum(axis=1)
        near = [j for j in np.lexsort((np.arange(400), d)) if j != q][:10]
        want |= {(q, int(j), int(d[j]), k + 1) for k, j in enumerate(near)}
    for rows_a_shard in (100, 100_000):
        assert {tuple(x) for x in hamming_topk.top_k(df, shard_rows=rows_a_shard).collect()} == want
    assert hamming_topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"a": 1}, {s: i + 1 for i, s in enumerate("abcdefg")}])
def test_frame_deviates_by_less_than_a_block(weights):
    slots = mixing.frame_shares(weights, 1000)
    place = mixing.edf_frame(slots)
    total = sum(slots.values())
    assert sorted(t for ts in place.values() for t in ts) == list(range(total))
    for s, ts in place.items():
        done = 0
        taken = set(ts)
        for t in range(total):
            done += t in taken
            assert abs(done - (t + 1) * slots[s] / total) < 1


def test_mixing_places_every_row_once(docs, rows, empty):
    out = mixing.mix_sources(docs, block=2, frame=10, bucket=7)
    assert out.count() == len(rows) and out.select("position").distinct().count() == len(rows)
    assert out.groupBy("source", "block").count().where("count > 2").count() == 0
    assert out.select("slot").distinct().count() == out.select("source", "block").distinct().count()
    assert mixing.mix_sources(empty).count() == 0


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows}
    out = packing.best_fit_pack(docs, shard_items=40).collect()
    by_bin = collections.defaultdict(list)
    pieces = collections.defaultdict(set)
    for r in out:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"] and len(own) == r["length"]
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].add((r["piece"], r["start"], r["length"]))
    for spans in by_bin.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans[:-1], spans[1:], strict=True)) and sum(spans[-1]) <= 2048
    for d, p in pieces.items():
        assert [x[0] for x in sorted(p)] == list(range(len(p))) and sum(x[2] for x in p) == len(ids[d])
        assert all(x[2] == 2048 for x in p if x[0] > 0)
    assert packing.best_fit_pack(empty).count() == 0


def test_encoder_equals_the_public_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.token_encoder("byte_bpe_50k")
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice(["a", "Zé", " ", "  ", "\n", "\t", "'s", "12", "!", "<|endoftext|>", " ", "中"]) for _ in range(r.randint(0, 40)))
        assert np.frombuffer(own([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, json.dumps(text)


def test_packing_keeps_every_capacity():
    lengths = np.sort(np.random.default_rng(6).integers(1, 100, 300))[::-1]
    for rule in ("norm", "dot"):
        bins, _ = packing.best_fit(lengths, 100, 4, 6000.0 + 100 * 100, (1.0, 0.1, 0.1), rule)
        for b in np.unique(bins):
            own = lengths[bins == b]
            assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 16000


def test_ordinal_orders_grades(spark, empty):
    r = random.Random(7)
    marks = {0: "bad awful", 1: "fair plain", 2: "good fine"}
    rows = [(i, " ".join([marks[i % 3]] * 3 + [r.choice(["x", "y", "z"]) for _ in range(20)]), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = train(df, df.select("doc_id", "grade"), bits=16, max_labelled=150)
    out = classify(df, model).join(df, "doc_id")
    means = {x["grade"]: x["m"] for x in out.groupBy("grade").agg(F.avg("expected_grade").alias("m")).collect()}
    assert means[0] < means[1] < means[2]
    assert out.where("selected = (grade = 2)").count() >= 290
    assert classify(empty, model).count() == 0
    assert np.all(np.diff(fit([np.zeros(0, np.int32)], np.array([1]), 3, 16).thresholds) > 0)


def test_grades(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1), (4, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in graded(df).collect()} == {(1, 2), (2, 1), (3, 0), (4, 0)}


def test_windows_that_only_their_own_document_repeats_stay(spark):
    df = spark.createDataFrame([(1, "x " * 300)], "doc_id long, text string")
    assert [(r.n_words, r.n_removed) for r in drop_repeated_words(df).collect()] == [(300, 0)]
