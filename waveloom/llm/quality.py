"""Quality classifier: Naive Bayes support vectors.

A document is its set of n-gram indicators: words, and runs of one to three word shapes (case,
digits, closing marks, length, whether the word repeats the one before). Each indicator is
scaled by the log-count ratio of the classes, a linear model with hinge loss is fitted on the scaled
indicators by dual coordinate descent, and a logistic curve fitted on margins of rows left out
turns margins into scores. The fit sees at most `sample` labelled rows; scoring is a scan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_rows, small_batches, written
from .words import LOWER, MARK, mix, pieces, prefix_sums, slice_hash, words_of

DIMS, SAMPLE, COST, ROUNDS, SEED, THRESHOLD = 1 << 18, 8_000, 1.0, 12, 11, 0.3


def held_out(doc_id):
    """Whether labels of a document are kept from learning; not so without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def indicators(data: np.ndarray, offsets: np.ndarray, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), each pair once, ordered by row; feature 0 is in every row, 1 in rows without words."""
    n = len(offsets) - 1
    start, end, row = words_of(data, offsets)
    rows, feats = [np.arange(n)], [np.zeros(n, np.int64)]
    empty = np.flatnonzero(np.bincount(row, minlength=n) == 0)
    rows.append(empty)
    feats.append(np.ones(len(empty), np.int64))
    if len(start):
        word = slice_hash(prefix_sums(LOWER[data]), start, end)
        again = np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
        kind = np.zeros(256, np.uint64)  # letters and bytes above 127 are alike
        kind[65:91], kind[48:58] = 1, 2
        kind[MARK] = np.flatnonzero(MARK)
        first, last, before = kind[data[start]], kind[data[end - 1]], kind[data[np.maximum(start, end - 2)]]
        length = np.minimum(np.frexp((end - start).astype(float))[1], 6).astype(np.uint64)
        shape = mix(((first * np.uint64(256) + before) * np.uint64(256) + last) * np.uint64(16) + length * np.uint64(2) + again)
        two = mix(shape[:-1] * np.uint64(3) + shape[1:])
        three = mix(two[:-1] * np.uint64(5) + shape[2:])
        for values, k in ((word, 0), (shape, 0), (two, 1), (three, 2)):
            same = row[k:] == row[: len(row) - k] if k else np.ones(len(row), bool)
            rows.append(row[k:][same])
            feats.append((values[same] % np.uint64(dims - 2)).astype(np.int64) + 2)
    pair = np.unique(np.concatenate(rows) * dims + np.concatenate(feats))
    return pair // dims, pair % dims


def dual_descent(features: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, rounds: int, seed: int) -> np.ndarray:
    """Weights of a linear model on scaled indicators; hinge loss, L2 penalty, costs balanced by class."""
    w, alpha = np.zeros(len(scale)), np.zeros(len(y))
    share = np.where(y > 0, len(y) / 2 / max(1, (y > 0).sum()), len(y) / 2 / max(1, (y < 0).sum()))
    most = cost * share
    xs = [scale[f] for f in features]
    square = np.array([max(x @ x, 1e-9) for x in xs])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, x = features[i], xs[i]
            gradient = y[i] * (w[f] @ x) - 1
            step = min(max(alpha[i] - gradient / square[i], 0.0), most[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[f] += step * y[i] * x
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve for margins, by Newton steps on smoothed labels."""
    pos, neg = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, v = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(d * margin).sum() + 1e-3 * (a - 1), d.sum()])
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-7:
            break
    return float(max(a, 1e-3)), float(b)


class Model:
    """weights of all indicators, and the curve from margin to score."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights, slope, offset

    def score(self, column) -> np.ndarray:
        out = []
        for lo, hi, data, offsets in pieces(column):
            row, f = indicators(data, offsets, len(self.weights))
            margin = np.bincount(row, self.weights[f], hi - lo)
            out.append(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(features: list[np.ndarray], label: np.ndarray, dims: int = DIMS, cost: float = COST, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """A model of label (0 or 1). With one class alone or no rows: a constant score near that class."""
    if len(label) < 2 or label.min() == label.max():
        p = (label.sum() + 1) / (len(label) + 2)
        return Model(np.zeros(dims), 1.0, float(np.log(p / (1 - p))))

    def learn(rows):
        own = label[rows]
        counts = [np.bincount(np.concatenate([features[i] for i in rows[own == k]] or [np.zeros(0, np.int64)]), minlength=dims) + 1.0 for k in (0, 1)]
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        ratio[(counts[0] + counts[1]) < 4] = 0  # met once
        return ratio * dual_descent([features[i] for i in rows], np.where(own > 0, 1.0, -1.0), ratio, cost, rounds, seed)

    order = np.random.default_rng(seed).permutation(len(label))
    out, kept = order[: len(order) // 4], order[len(order) // 4 :]
    a, b = 1.0, 0.0
    if len(set(label[out])) == 2 and len(set(label[kept])) == 2:
        part = learn(kept)
        a, b = curve(np.array([part[features[i]].sum() for i in out]), label[out])
    return Model(learn(order), a, b)


def labelled(docs: DataFrame, labels: DataFrame, column: str, sample: int) -> DataFrame:
    """(doc_id, text, y) of at most `sample` labelled rows that may be learned from, the same at each run.

    Of rows of docs with one id the least text by hash counts, so that repeats add nothing; of
    labels of one id the greater; labels other than 0 and 1 and those without id are left out.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    y = written(y, "labels")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), "doc_id")  # at most `sample` rows
    return own.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dims: int = DIMS) -> Model:
    """Fit on labels (doc_id, quality) joined to docs; at most `sample` rows pass the driver, as feature numbers."""
    import pyarrow as pa

    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in pieces(b.column("text")):
                row, f = indicators(data, offsets, dims)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], b.column("y")[lo:hi], pa.array([f[s:e].astype("<i4").tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["doc_id", "y", "f"])

    got = labelled(docs, labels, "quality", sample).mapInArrow(run, "doc_id long, y int, f binary").toArrow().sort_by("doc_id")
    return fit([np.frombuffer(f, "<i4").astype(np.int64) for f in got.column("f").to_pylist()], got.column("y").to_numpy(), dims)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, dims: int = DIMS) -> DataFrame:
    """docs with quality_score and quality_pred (1 where the score is `threshold` or more).

    Null texts score as empty ones. Repeated rows score alike; columns of docs by the new names
    are replaced; an empty table gives no rows; without usable labels the score is a constant.
    """
    import pyarrow as pa

    model = train(docs, labels, sample, dims)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # `dims` weights, whatever the corpus
    docs = docs.drop("quality_score", "quality_pred")
    small_batches(docs.sparkSession)
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            row = b.column("row")
            yield pa.RecordBatch.from_arrays([row, pa.array(shipped.value.score(row.field("text")))], ["row", "quality_score"])

    rows = docs.select(as_rows(docs))
    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("quality_score", T.DoubleType())]))
    return out.select("row.*", "quality_score", (F.col("quality_score") >= threshold).cast("int").alias("quality_pred"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, dims: int = DIMS) -> DataFrame:
    """The rows of docs whose score is `threshold` or more, all columns as they are; see `scored` for the score."""
    import pyarrow as pa

    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, dims))  # `dims` weights, whatever the corpus
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shipped.value.score(b.column("row").field("text")) >= threshold))

    rows = docs.select(as_rows(docs))
    return rows.mapInArrow(run, rows.schema).select("row.*")
