"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence's score is a logistic function of its words, and
the document's is the noisy-or of its sentences. The weights are trained from document labels
alone, by gradient steps on the likelihood of the noisy-or, and then point out the sentences at fault.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .quality import labelled
from .words import LOWER, pieces, prefix_sums, slice_hash, trimmed, words_of

DIMS, SAMPLE, STEPS, RATE, PENALTY, EVIDENCE, THRESHOLD = 1 << 18, 8_000, 200, 0.15, 0.05, 18.0, 0.5


def sentences(data: np.ndarray, offsets: np.ndarray, dims: int = DIMS):
    """Words as features and the sentence of each; start, end and row of the sentences.

    A sentence ends after a word that closes with . ! or ? or before a line feed. Rows without
    words have one empty sentence without features.
    """
    n = len(offsets) - 1
    start, end, row = words_of(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), offsets[:-1].copy(), offsets[:-1].copy(), np.arange(n)
    lines = np.r_[0, np.cumsum(data == 10)]
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | (lines[start[1:]] != lines[end[:-1]]) | np.isin(data[end[:-1] - 1], np.frombuffer(b".!?", np.uint8))
    head = np.flatnonzero(new)
    s, e = trimmed(data, start, end)
    f = (slice_hash(prefix_sums(LOWER[data]), s, e) % np.uint64(dims)).astype(np.int64)
    sentence = np.cumsum(new) - 1
    first, last, of = start[head], end[np.r_[head[1:], len(start)] - 1], row[head]
    bare = np.setdiff1d(np.arange(n), of)
    if len(bare):  # behind the others, put into order of rows
        order = np.argsort(np.r_[of, bare], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first, last, of = np.r_[first, offsets[bare]][order], np.r_[last, offsets[bare]][order], np.r_[of, bare][order]
        sentence = rank[sentence]
    pair = np.unique(sentence * dims + f)
    return pair % dims, pair // dims, first, last, of


class Model:
    """A weight for each word feature and an offset."""

    def __init__(self, weights: np.ndarray, offset: float):
        self.weights, self.offset = weights, offset

    def logits(self, f: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(sentence, self.weights[f], n) + self.offset

    def score(self, column):
        """Per row: noisy-or score, sentences at 0.5 or more, byte span of the worst sentence."""
        for lo, hi, data, offsets in pieces(column):
            f, sentence, first, last, of = sentences(data, offsets, len(self.weights))
            z = np.clip(self.logits(f, sentence, len(of)), -30, 30)
            p = 1 / (1 + np.exp(-z))
            score = -np.expm1(-np.bincount(of, np.logaddexp(0, z), hi - lo))
            order = np.lexsort((-np.arange(len(of)), p, of))
            worst = order[np.searchsorted(of[order], np.arange(hi - lo), "right") - 1]
            yield np.clip(score, 0, 1), np.bincount(of, p >= 0.5, hi - lo).astype(np.int64), first[worst] - offsets[:-1], last[worst] - offsets[:-1], p[worst]


def associated(bags: list[np.ndarray], label: np.ndarray, dims: int, evidence: float) -> np.ndarray:
    """Features whose presence in a bag goes with the label: twice the log-likelihood ratio is `evidence` or more.

    With hundreds of thousands of words, a bound near 20 lets hardly any pass by chance.
    """
    pos = np.bincount(np.concatenate([b for b, y in zip(bags, label, strict=True) if y]), minlength=dims).astype(float)
    neg = np.bincount(np.concatenate([b for b, y in zip(bags, label, strict=True) if not y]), minlength=dims).astype(float)
    n, k = float(len(label)), float(label.sum())

    def part(seen, row, col):
        return seen * np.log(np.maximum(seen, 1e-12) * n / np.maximum(row * col, 1e-12))

    met = pos + neg
    g = 2 * (part(pos, met, k) + part(neg, met, n - k) + part(k - pos, n - met, k) + part(n - k - neg, n - met, n - k))
    return np.flatnonzero((g >= evidence) & (met > 0))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, dims: int = DIMS, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY, evidence: float = EVIDENCE) -> Model:
    """Maximise the noisy-or likelihood of label over bags (features, sentence of each), with an L2 penalty.

    Features that don't go with the label have weight 0. Without both classes the score is near a constant.
    """
    if len(label) < 2 or label.min() == label.max():
        p = min(max((label.sum() + 0.5) / (len(label) + 1), 1e-3), 1 - 1e-3)
        return Model(np.zeros(dims), float(np.log(p / (1 - p))))
    sizes = np.array([int(s.max()) + 1 if len(s) else 1 for _, s in bags])
    base = np.cumsum(sizes) - sizes
    f = np.concatenate([x for x, _ in bags])
    sentence = np.concatenate([s + b for (_, s), b in zip(bags, base, strict=True)])
    bag = np.repeat(np.arange(len(bags)), sizes)
    kept = associated([np.unique(x) for x, _ in bags], label, dims, evidence)
    number = np.full(dims, -1)
    number[kept] = np.arange(len(kept))
    keep = number[f] >= 0
    f, sentence, n = number[f[keep]], sentence[keep], int(sizes.sum())
    w, b = np.zeros(len(kept)), -4.0 - np.log(np.median(sizes))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(sentence, w[f], n) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(bag, np.logaddexp(0, z), len(label))  # -log of the chance that no sentence is at fault
        pull = np.where(label > 0, np.exp(-none) / np.maximum(-np.expm1(-none), 1e-9), -1.0)
        g = -pull[bag] * p
        grad = np.r_[np.bincount(f, g[sentence], len(kept)) + penalty * w, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(dims)
    weights[kept] = w
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dims: int = DIMS) -> Model:
    """Fit on labels (doc_id, toxic) joined to docs; at most `sample` rows pass the driver, as feature numbers."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in pieces(b.column("text")):
                f, sentence, _, _, of = sentences(data, offsets, dims)
                row = of[sentence]
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                base = np.searchsorted(of, np.arange(hi - lo))
                own = (sentence - base[row]).astype("<i4")
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], b.column("y")[lo:hi], *(pa.array([x[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (f.astype("<i4"), own))], ["doc_id", "y", "f", "s"])

    got = labelled(docs, labels, "toxic", sample).mapInArrow(run, "doc_id long, y int, f binary, s binary").toArrow().sort_by("doc_id")
    bags = [(np.frombuffer(f, "<i4").astype(np.int64), np.frombuffer(s, "<i4").astype(np.int64)) for f, s in zip(got.column("f").to_pylist(), got.column("s").to_pylist(), strict=True)]
    return fit(bags, got.column("y").to_numpy(), dims)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, dims: int = DIMS) -> DataFrame:
    """(doc_id, toxic_score, toxic_pred, n_offending, worst_start, worst_end, worst_score) per row of docs.

    The worst sentence is given in UTF-8 bytes, the first of equals. Null texts score as empty
    ones: one sentence without words. Repeated rows score alike, other columns are ignored, an
    empty table gives no rows, and without usable labels the score is near a constant.
    """
    import pyarrow as pa

    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, dims))  # `dims` weights, whatever the corpus
    small_batches(docs.sparkSession)
    names = ["doc_id", "toxic_score", "n_offending", "worst_start", "worst_end", "worst_score"]

    def run(batches):
        for b in batches:
            parts = list(shipped.value.score(b.column("text")))
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0), *[np.zeros(0, np.int64)] * 3, np.zeros(0)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c) for c in cols)], names)

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, toxic_score double, n_offending long, worst_start long, worst_end long, worst_score double")
    return out.withColumn("toxic_pred", (F.col("toxic_score") >= threshold).cast("int"))
