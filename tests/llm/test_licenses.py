"""License detections, suppression, labels and score against a plain reading of the rules."""

from __future__ import annotations

import random
import re
import time

import pytest

from pyspark.sql import functions as F

from tidemark.llm import license_scan
from tidemark.llm.license_scan import NOT_WORD, PHRASES, license_detections, rules
from test_whole import forms

TABLE = rules()


def plain(text: str | None):
    """Detections (start, stop, rule) of the word string, the labels and the score, by Python's own search."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.sub(NOT_WORD, " ", lower).strip(" ")
    found = []
    for number, _, keyword, priority, _, pattern in TABLE:
        if keyword in words:
            found += [(m.start(), m.end(), priority, number) for m in re.finditer(pattern, words)]
    found.sort(key=lambda f: (f[0], -f[1], -f[2], f[3]))
    stay = [f for i, f in enumerate(found) if not any(g[1] >= f[1] and g[2] >= f[2] for g in found[:i])]
    base = [label for phrase, label in PHRASES if f" {phrase} " in f" {words} "]
    labels = sorted({*base, *(TABLE[f[3]][1] for f in stay)})
    return [(f[0], f[1]) for f in stay], ",".join(labels), max([0.5 if base else 0.0, *(TABLE[f[3]][4] for f in stay)])


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    notices = [f for t in TABLE for f in forms(re._parser.parse(t[5]))[:4]]
    out: list = [None, "", "  ", "KKLicense MIT LICENSE", "İMIT license", "no notice at all"]
    for _ in range(120):
        parts = [r.choice(notices).title() if r.random() < 0.5 else r.choice(["some", "words", "the", "MIT", "license", "2 0", "été"]) for _ in range(r.randint(1, 14))]
        out.append(r.choice([" ", ", ", " - ", "\n"]).join(parts))
    return out


def test_detections_labels_and_score(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {x["doc_id"]: ([(d["start"], d["stop"]) for d in x["detections"]], x["labels"], x["score"]) for x in license_detections(docs).collect()}
    for k, t in enumerate(texts):
        assert got[k] == plain(t), t


def test_a_long_text_of_notices_costs_in_proportion(spark):
    """About a million bytes of one notice; every detection is told, in seconds."""
    n = 32_000
    docs = spark.createDataFrame([(1, "Licensed under MIT license. " * n)], "doc_id long, text string")
    begun = time.time()
    row = license_detections(docs).selectExpr("size(detections) as n", "labels").first()
    assert row["n"] == n and row["labels"] == "mit" and time.time() - begun < 120


def test_a_rule_is_searched_once_a_text(spark):
    """A lambda's body computes an expression wherever it stands, so each search stands in it once."""
    said = str(license_scan._found_by(F.col("words"), F.col("rule")))
    assert (said.count("regexp_extract_all("), said.count("split(")) == (1, 1), said


def test_anchors_and_fixed_parts_are_in_all_that_a_rule_matches():
    for _, _, keyword, _, _, pattern in rules():
        held, whole = license_scan.anchor(keyword, pattern)
        for f in forms(re._parser.parse(pattern)):
            assert held in (f.split(" ") if whole else f), (pattern, f)
            assert license_scan.fixed_words(pattern) <= set(f.split(" ")) and all(p in f for p in license_scan.fixed_parts(pattern)), (pattern, f)


@pytest.mark.parametrize(
    ("pattern", "words", "parts"),
    [
        ("(?<![^ ])(?:gnu )?general public licen[cs]e (?:version |v)?2(?![^ ])", {"general", "public"}, ["general public licen"]),
        ("(?<![^ ])cc0(?: 1 0)?(?: universal)?(?![^ ])", {"cc0"}, ["cc0"]),
        ("(?<![^ ])gpl(?: version| v)? ?2(?![^ ])", set(), ["gpl"]),
        ("(?<![^ ])non ?commercial (?:use|purposes)(?: only)?(?![^ ])", set(), ["commercial ", "non"]),
        ("(?<![^ ])copyright (?:c )?[a-z0-9]+(?: [a-z0-9]+){0,3} all rights reserved(?![^ ])", {"copyright", "all", "rights", "reserved"}, [" all rights reserved", "copyright "]),
        ("(?<![^ ])without (?:the )?(?:express |prior )*written permission(?![^ ])", {"without", "written", "permission"}, ["written permission", "without "]),
    ],
)
def test_fixed_words_and_parts_of_a_pattern(pattern, words, parts):
    assert (license_scan.fixed_words(pattern), license_scan.fixed_parts(pattern)) == (words, parts)


def test_long_texts_are_not_split_and_give_the_same(spark, texts, monkeypatch):
    monkeypatch.setattr(license_scan, "SPLIT_BYTES", 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {x["doc_id"]: ([(d["start"], d["stop"]) for d in x["detections"]], x["labels"], x["score"]) for x in license_detections(docs).collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts)}
