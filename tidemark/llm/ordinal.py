"""Quality classifier: cumulative-link (ordinal logistic) regression on hashed text features.

A text's features are the hashed distinct words and word beginnings it holds (A-Z lower-cased, ASCII
punctuation as white space), each worth less the more there are, and bins of what it looks like (shares of
capitals, symbols, digits, lines, distinct words). Features of fewer than ``min_texts`` rated texts get no
weight. One weight vector w is shared by all grades; ordered thresholds t1 < t2 < ... cut its scale: P(grade >= k) = sigmoid(w.x - tk). The
expected grade is the sum of these tail probabilities, and a document is selected when the tail
probability of ``min_grade`` reaches ``min_tail``.

The model is fitted on the driver on at most ``max_labelled`` rated documents, those whose ids have the
smallest hashes: a documented bound on a uniform sample. Everything is scored: one narrow scan with
the weights (``dims`` floats, a fixed size) sent to every task.

Defined results: null and empty texts have only the features of empty looks; ratings that are null or belong
to no document are ignored; a document rated twice counts twice; a null doc_id is scored and kept;
without two different grades every tail probability is the observed share of that grade;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import GOLDEN, U, Block, blocks, mix, words

#: Bytes of the word beginnings that are features, and features kept apart for a text's looks.
PREFIXES = (4, 6)
BINS, SURFACE = 32, 256
RATED = "grade int, features binary"
_TOKENS = np.full(256, 32, np.uint8)
_TOKENS[128:] = np.arange(128, 256)
for _a, _b, _to in ((48, 58, 48), (65, 91, 97), (97, 123, 97)):
    _TOKENS[_a:_b] = np.arange(_to, _to + _b - _a)
_KINDS = [np.isin(np.arange(256), list(c.encode())) for c in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#*$%&", "|", "!", "0123456789", "\n")]


def _surface(block: Block, distinct: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of what a text looks like: shares in bins of half an octave, one feature a share."""
    size = np.maximum(np.diff(block.bounds), 1)
    shares = []
    for kind in _KINDS:
        upto = np.concatenate([[0], np.cumsum(kind[block.data])])
        shares.append((upto[block.bounds[1:]] - upto[block.bounds[:-1]]) / size)
    shares.append(distinct / np.maximum(total, 1))
    bins = [np.floor(2 * np.log2(1 + 1000 * share)).astype(np.int64) for share in shares]
    texts = np.arange(len(size))
    return np.tile(texts, len(bins)), np.concatenate([k * BINS + np.minimum(b, BINS - 1) for k, b in enumerate(bins)])


def features(block: Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text of the block, feature) of all distinct features, by text; those below SURFACE describe its looks."""
    plain = Block(block.rows, _TOKENS[block.data], block.bounds)
    w = words(plain)
    n = len(w.bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(w.bounds))
    total = np.diff(w.bounds)
    padded = np.concatenate([plain.data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(plain.data) + 1,), "<u8", padded, 0, (1,))
    whole = np.unique((owner.astype(U) << U(bits)) | (w.hashes >> U(64 - bits)))
    distinct = np.bincount((whole >> U(bits)).astype(np.int64), minlength=n)
    keys = [whole]
    for prefix in PREFIXES:
        mask = np.array([(1 << (8 * k)) - 1 for k in range(prefix + 1)], U)
        start = mix((eights[w.starts] & mask[np.minimum(w.ends - w.starts, prefix)]) * GOLDEN + U(prefix))
        keys.append((owner.astype(U) << U(bits)) | (start >> U(64 - bits)))
    key = np.unique(np.concatenate(keys))
    text, feature = (key >> U(bits)).astype(np.int64), (key & U((1 << bits) - 1)).astype(np.int64)
    at, looks = _surface(block, distinct, total)
    text, feature = np.concatenate([text, at]), np.concatenate([np.maximum(feature, SURFACE), looks])
    order = np.argsort(text, kind="stable")
    return text[order], feature[order]


def worth(sizes: np.ndarray, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """What a feature counts in a text of so many features: words less in longer texts, looks one each."""
    return np.where(feature < SURFACE, 1.0, (1.5 / np.maximum(sizes, 1) ** 0.25)[owner])


def _rated(bits: int):
    def run(batches):
        for batch in batches:
            rows: list = [None] * batch.num_rows
            for block in blocks(batch.column("text")):
                owner, f = features(block, bits)
                edges = np.searchsorted(owner, np.arange(len(block.rows) + 1))
                for i, row in enumerate(block.rows):
                    rows[row] = f[edges[i] : edges[i + 1]].astype(np.int32).tobytes()
            yield pa.record_batch([batch.column("grade"), pa.array(rows, pa.binary())], names=["grade", "features"])

    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by hashed feature and ordered thresholds; P(grade >= k) = sigmoid(score - thresholds[k - 1])."""

    bits: int
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, bits: int, *, l2: float = 3e-4, steps: int = 120, rate: float = 0.1, min_texts: int = 10) -> OrdinalModel:
    """Full-batch Adam on the mean negative log likelihood; gaps between thresholds are kept as logarithms."""
    size = np.array([max(len(r), 1) for r in rows])
    index = np.concatenate([*rows, np.zeros(0, np.int32)])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    known = np.flatnonzero(np.bincount(index, minlength=1 << bits) >= min_texts)
    place = np.full(1 << bits, -1, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    index = place[index]
    owner, index = owner[index >= 0], index[index >= 0]
    value = worth(size, owner, known[index]).astype(np.float32)
    w = np.zeros(len(known))
    share = np.array([np.clip((grades >= k).mean(), 1e-3, 1 - 1e-3) for k in range(1, levels)])
    t = -np.log(share / (1 - share))
    cuts = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 0.05))])
    if len(np.unique(grades)) < 2:
        return OrdinalModel(bits, np.zeros(1 << bits, np.float32), np.concatenate([t[:1], t[:1] + np.cumsum(np.exp(cuts[1:]))]))
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(cuts), np.zeros_like(cuts)]]
    for step in range(1, steps + 1):
        gaps = np.exp(cuts[1:])
        t = np.concatenate([cuts[:1], cuts[0] + np.cumsum(gaps)])
        s = np.bincount(owner, value * w[index], len(rows))
        tail = np.concatenate([np.ones((len(s), 1)), _sigmoid(s[:, None] - t[None, :]), np.zeros((len(s), 1))], axis=1)
        i = np.arange(len(s))
        p = np.maximum(tail[i, grades] - tail[i, grades + 1], 1e-12)
        slope = tail * (1 - tail)
        up, down = slope[i, grades] / p, slope[i, grades + 1] / p
        gs = -(up - down) / len(s)
        gw = np.bincount(index, value * gs[owner], len(w)) + l2 * w
        gt = np.zeros((len(s), levels + 1))
        gt[i, grades] += up
        gt[i, grades + 1] -= down
        gt = gt[:, 1:levels].sum(axis=0) / len(s)
        later = np.cumsum(gt[::-1])[::-1]
        gc = np.concatenate([later[:1], later[1:] * gaps])
        for k, (g, (m, v)) in enumerate(zip((gw, gc), moments, strict=True)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            move = rate * (0.1 if k else 1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if k:
                cuts = cuts - move
            else:
                w -= move
    t = np.concatenate([cuts[:1], cuts[0] + np.cumsum(np.exp(cuts[1:]))])
    weights = np.zeros(1 << bits, np.float32)
    weights[known] = w
    return OrdinalModel(bits, weights, t)


def rated_documents(documents: DataFrame, ratings: DataFrame, max_labelled: int, bits: int) -> list:
    """Rows (grade, features) of the rated documents with the smallest id hashes, at most so many."""
    sample = ratings.where("doc_id is not null and grade is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(max_labelled)
    sample = sample.select(F.col("doc_id").cast("long").alias("_id"), F.col("grade").cast("int").alias("grade"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rated = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("grade", "text")
    return rated.mapInArrow(_rated(bits), RATED).collect()


def train(documents: DataFrame, ratings: DataFrame, *, levels: int = 3, bits: int = 22, max_labelled: int = 6000, **how) -> OrdinalModel:
    rows = rated_documents(documents, ratings, max_labelled, bits)
    if not rows:
        return OrdinalModel(bits, np.zeros(1 << bits, np.float32), np.zeros(levels - 1) + np.arange(levels - 1) * 1e-6)
    return fit([np.frombuffer(r["features"], np.int32) for r in rows], np.array([r["grade"] for r in rows]), levels, bits, **how)


def _scored(model, min_grade: int, min_tail: float):
    def run(batches):
        m: OrdinalModel = model.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for block in blocks(batch.column("text")):
                owner, f = features(block, m.bits)
                n = np.bincount(owner, minlength=len(block.rows))
                scores[block.rows] = np.bincount(owner, m.weights[f] * worth(n, owner, f), len(block.rows))
            tails = m.tails(scores)
            columns = [batch.column("doc_id"), pa.array(scores), pa.array(tails.sum(axis=1)), pa.array(tails[:, min_grade - 1]), pa.array(tails[:, min_grade - 1] >= min_tail)]
            yield pa.record_batch(columns, names=["doc_id", "score", "expected_grade", "tail_probability", "selected"])

    return run


def classify(documents: DataFrame, model: OrdinalModel, *, min_grade: int = 2, min_tail: float = 0.6) -> DataFrame:
    """One row a document: doc_id, score, expected_grade, tail_probability of min_grade, selected."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_scored(shared, min_grade, min_tail), "doc_id long, score double, expected_grade double, tail_probability double, selected boolean")


def graded(labels: DataFrame) -> DataFrame:
    """Grades from two marks: 0 for toxic, 1 for low quality and not toxic, 2 for good and not toxic."""
    marks = labels.where("quality is not null and toxic is not null")
    return marks.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))
