"""Hard-negative mining by filtering on segment summaries.

Vectors of whole numbers are turned by a fixed orthonormal basis, which keeps their products, and
cut into segments. Of each segment its mean and its deviation (the length of what is left without
the mean) are stored with the vector. Over a segment of L entries the product of two vectors lies
within L mean mean' plus or minus deviation deviation', so the sum over segments bounds the score
from both sides. Pairs that the bounds of few, long segments can't rule out meet those of more and
shorter ones, and what is left is scored exactly. The basis puts the axes on which most of the
vectors' length lies into the means; it is fitted on a bounded sample and changes no result.

The anchors go through in chunks of bounded size: each chunk is broadcast and every partition of
the vectors is searched where it lies, so no vector is ever dealt out by label or by anchor, and a
label that a third of the rows hold is no hot key. A task keeps the best few of each anchor and
gives up only those.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, small_batches, written

#: Positives of an anchor and negatives of a positive; what a negative's score is of its positive's, in hundredths; anchors are rows whose id is divisible by EVERY; whole numbers are floor(SCALE x).
POSITIVES, NEGATIVES, LOW, HIGH, EVERY, SCALE = 5, 3, 50, 95, 50, 256.0
#: Segments of each level; vectors that the basis is fitted on.
LEVELS, SAMPLE = (4, 16), 4096
#: Bytes and rows of a chunk of anchors, and anchors of a tile.
CHUNK_BYTES, CHUNK, TILE = 1 << 25, 16_384, 1024
#: Below this share of a tile's pairs, those that are left are worked on one by one.
FEW = 0.15
#: Squared lengths from which scores need not fit 64 bits, and up to which doubles are exact.
TOO_LONG, EXACT = float(1 << 62), float(1 << 53)
#: Rounding of the stored summaries and their products, as a share of the product of the lengths.
SLACK = 1e-5


def _usable():
    return F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")


def basis(sample: np.ndarray, levels=LEVELS) -> np.ndarray:
    """An orthonormal basis in rows whose segment means, from the longest segments on, take up the axes with most of the sample's length."""
    d = sample.shape[1]
    wide = -(-d // levels[-1]) * levels[-1]
    marks = [np.repeat(np.eye(n), wide // n, 1).T for n in levels] + [np.eye(wide)]
    # the means of each level in turn, then what completes them
    means, _, rank = np.zeros((wide, 0)), None, 0
    for m in marks:
        rest = m - means @ (means.T @ m)
        u, s, _ = np.linalg.svd(rest, full_matrices=False)
        means = np.concatenate([means, u[:, s > 1e-9]], 1)
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    full = np.zeros((wide, wide))
    full[:d, :d] = axes.T
    full[d:, d:] = np.eye(wide - d)
    return means @ full  # turned vector = basis @ (vector, padded by zeros)


def whole(v: list[bytes], kind: str, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(np.frombuffer(b"".join(v), kind).reshape(len(v), -1).astype(np.float64) * scale)


def summaries(x: np.ndarray, turn: np.ndarray, levels=LEVELS) -> np.ndarray:
    """Means (times the root of the segment's length) and deviations of each level's segments, then the length of the whole."""
    y = x @ turn[:, : x.shape[1]].T
    out = []
    for n in levels:
        seg = y.reshape(len(y), n, -1)
        mean = seg.mean(2)
        out += [mean * np.sqrt(seg.shape[2]), np.sqrt(((seg - mean[:, :, None]) ** 2).sum(2))]
    return np.concatenate([*out, np.sqrt((x * x).sum(1))[:, None]], 1).astype(np.float32)


def _summarised(kind: str, scale: float, turn):
    """Arrow function: each vector as bytes, with its summaries; those too long for 64-bit scores are left out."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind)
            d = len(raw) // b.num_rows
            v = [r.tobytes() for r in raw.reshape(-1, d)]
            x = whole(v, kind, scale)
            with np.errstate(over="ignore", invalid="ignore"):
                fit = np.flatnonzero((x * x).sum(1) * (1 + 1e-12) < TOO_LONG)
            s = summaries(x[fit], turn.value)
            yield pa.RecordBatch.from_arrays([b.column("at").take(pa.array(fit)), b.column("vec_id").take(pa.array(fit)), b.column("label").take(pa.array(fit)), pa.array([v[i] for i in fit], pa.binary()), pa.array([r.tobytes() for r in s], pa.binary())], ["at", "vec_id", "label", "v", "s"])

    return run


@dataclass
class Block:
    """Rows side by side: numbers, ids, labels, whole vectors and summaries."""

    at: np.ndarray
    id: np.ndarray
    label: np.ndarray
    x: np.ndarray
    s: np.ndarray

    @classmethod
    def of(cls, t, kind: str, scale: float) -> Block:
        v = t.column("v").to_pylist()
        return cls(*(t.column(c).to_numpy() for c in ("at", "vec_id", "label")), whole(v, kind, scale), np.frombuffer(b"".join(t.column("s").to_pylist()), np.float32).reshape(len(v), -1))

    def take(self, rows) -> Block:
        return Block(self.at[rows], self.id[rows], self.label[rows], self.x[rows], self.s[rows])


def scored(a: Block, b: Block, low: np.ndarray, high: np.ndarray | None, wanted: np.ndarray | None, levels=LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, score) of the pairs whose score lies between low and high of the row of a, and where `wanted`, if given, holds.

    Pairs are ruled out by the bounds of each level in turn; the rest is scored exactly.
    """
    slack = SLACK * a.s[:, -1:].astype(np.float64) * b.s[:, -1].astype(np.float64) + 1
    alive = np.ones((len(a.x), len(b.x)), bool) if wanted is None else wanted.copy()
    first = 0
    for n in levels:
        m, v = slice(first, first + n), slice(first + n, first + 2 * n)
        first += 2 * n
        if not np.isfinite(low).any() and high is None:
            continue
        left = np.count_nonzero(alive)
        if not left:
            break
        if left < FEW * alive.size:
            i, j = np.nonzero(alive)
            middle, radius = np.einsum("ij,ij->i", a.s[i, m], b.s[j, m]), np.einsum("ij,ij->i", a.s[i, v], b.s[j, v]) + slack[i, j]
            keep = middle + radius >= low[i]
            keep &= True if high is None else middle - radius <= high[i]
            alive[i[~keep], j[~keep]] = False
        else:
            middle, radius = a.s[:, m] @ b.s[:, m].T, a.s[:, v] @ b.s[:, v].T + slack
            alive &= middle + radius >= low[:, None]
            if high is not None:
                alive &= middle - radius <= high[:, None]
    i, j = np.nonzero(alive)
    if not len(i):
        return i, j, np.zeros(0, np.int64)
    exact = float(a.s[:, -1].max()) * float(b.s[:, -1].max()) * (1 + SLACK) < EXACT
    x, y = (a.x, b.x) if exact else (a.x.astype(np.int64), b.x.astype(np.int64))
    if len(i) < FEW * alive.size:
        score = np.concatenate([np.einsum("ij,ij->i", x[p], y[q]) for p, q in zip(np.array_split(i, len(i) // 65536 + 1), np.array_split(j, len(i) // 65536 + 1), strict=True)])
    else:
        score = (x @ y.T)[i, j]
    keep = score >= low[i]
    keep &= True if high is None else score <= high[i]
    return i[keep], j[keep], score[keep].astype(np.int64)


@dataclass
class Best:
    """The `most` best entries of each key so far: higher scores first, ties by smaller id, then by row number."""

    most: int
    keys: int
    worst: np.ndarray = field(init=False)
    held: tuple = field(init=False)

    def __post_init__(self):
        self.worst = np.full(self.keys, -np.inf)  # scores below can't get in
        self.held = tuple(np.zeros(0, np.int64) for _ in range(4))

    def add(self, key, score, id, at) -> None:
        if not len(key):
            return
        key, score, id, at = (np.concatenate(p) for p in zip(self.held, (key, score, id, at), strict=True))
        order = np.lexsort((at, id, -score, key))
        key = key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        order, key = order[place < self.most], key[place < self.most]
        self.held = (key, score[order], id[order], at[order])
        full = place[place < self.most] == self.most - 1
        self.worst[key[full]] = self.held[1][full]


def _batch(best: Best, names: list[str], of: np.ndarray):
    import pyarrow as pa

    key, score, id, at = best.held
    return pa.RecordBatch.from_arrays([pa.array(of[key]), pa.array(key), pa.array(score), pa.array(id), pa.array(at)], names)


def _nearest(chunk, kind: str, scale: float, most: int):
    """Arrow function: of each anchor, the best other rows of its label in a partition."""

    def run(batches):
        a = Block.of(chunk.value, kind, scale)
        order = np.argsort(a.label, kind="stable")
        a = a.take(order)
        best = Best(most, len(a.at))
        for t in batches:
            if not t.num_rows:
                continue
            b = Block.of(t, kind, scale)
            for label in np.unique(b.label):
                lo, hi = np.searchsorted(a.label, label), np.searchsorted(a.label, label, "right")
                own = b.take(np.flatnonzero(b.label == label))
                for s in range(lo, hi, TILE):
                    e = min(s + TILE, hi)
                    i, j, score = scored(a.take(slice(s, e)), own, best.worst[s:e], None, None)
                    other = a.at[s + i] != own.at[j]
                    i, j, score = i[other], j[other], score[other]
                    best.add(s + i, score, own.id[j], own.at[j])
        yield _batch(best, ["anchor", "key", "score", "id", "at"], a.at)

    return run


def _between(chunk, windows, kind: str, scale: float, most: int):
    """Arrow function: of each anchor and positive, the best rows of other labels within its window of scores in a partition."""

    def run(batches):
        a = Block.of(chunk.value, kind, scale)
        low, high = windows.value  # (anchors, positives); empty where low > high
        k = low.shape[1]
        best = Best(most, low.size)
        for t in batches:
            if not t.num_rows:
                continue
            b = Block.of(t, kind, scale)
            for s in range(0, len(a.at), TILE):
                rows = slice(s, s + TILE)
                tile = a.take(rows)
                from_ = np.where(low[rows] <= high[rows], np.maximum(low[rows], best.worst.reshape(-1, k)[rows]), np.inf)
                i, j, score = scored(tile, b, from_.min(1), np.where(low[rows] <= high[rows], high[rows], -np.inf).max(1), tile.label[:, None] != b.label[None, :])
                for p in range(k):
                    hit = np.flatnonzero((score >= from_[i, p]) & (score <= high[s + i, p]))
                    best.add((s + i[hit]) * k + p, score[hit], b.id[j[hit]], b.at[j[hit]])
        yield _batch(best, ["anchor", "key", "score", "id", "at"], np.repeat(a.at, k))

    return run


def _first(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group; a group has as many rows for each partition at most."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "at")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(table: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, every: int = EVERY, scale: float = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over table (vec_id, embedding, label, ...).

    Rows without vec_id or label, or with a vector that is null, empty or holds null or non-finite
    components take no part, nor do vectors whose length is not that of most (the longer, where
    two are as frequent), or whose squared length in whole numbers is 2**62 or more, as scores with
    them need not fit 64 bits. Repeated rows take part each; of rows alike in score and id the order
    is that of reading. Other columns are ignored; an empty table gives no rows. Negatives' scores
    lie between low and high hundredths of their positive's.
    """
    import pyarrow as pa

    spark = table.sparkSession
    small_batches(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    kind = "<f4" if dict(table.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>").alias("embedding")).where(_usable())
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    d = most["d"]
    rows = rows.where(F.size("embedding") == d)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(SAMPLE).toArrow().column("embedding").combine_chunks()  # bounded
    sample = np.clip(sample.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d), -1e100, 1e100)
    turn = spark.sparkContext.broadcast(basis(sample / np.abs(sample).max() if sample.any() else sample))
    stored = written(rows.withColumn("at", F.monotonically_increasing_id()).mapInArrow(_summarised(kind, scale, turn), "at long, vec_id long, label long, v binary, s binary"), "summaries")
    anchors = stored.where(F.col("vec_id") % every == 0)
    size = max(1, min(CHUNK, CHUNK_BYTES // (8 * d + 400)))
    n = anchors.count()
    if not n:
        return spark.createDataFrame([], schema)
    anchors = anchors.repartition(-(-n // size)).withColumn("no", F.monotonically_increasing_id())
    anchors = written(anchors.withColumn("chunk", F.shiftright("no", 33) * (1 << 20) + (F.col("no") % (1 << 33) / size).cast("long")).drop("no"), "anchors")
    out = scratch_path(spark, "negatives")
    for c in sorted(r["chunk"] for r in anchors.select("chunk").distinct().collect()):  # a row for each chunk of `size` anchors
        chunk = anchors.where(F.col("chunk") == c).drop("chunk").orderBy("label", "at").toArrow()
        shipped = spark.sparkContext.broadcast(chunk)
        found = stored.mapInArrow(_nearest(shipped, kind, scale, positives), "anchor long, key long, score long, id long, at long")
        near = _first(found, ["anchor"], positives).select("anchor", "rank", "score", "id").toArrow()  # at most `positives` for each anchor of the chunk
        at = chunk.column("at").to_numpy()
        order = np.argsort(at)
        row = order[np.searchsorted(at[order], near.column("anchor").to_numpy())]
        place = near.column("rank").to_numpy() - 1
        score = [int(s) for s in near.column("score").to_pylist()]
        windows = np.ones((len(at), positives), np.int64), np.zeros((len(at), positives), np.int64)
        windows[0][row, place], windows[1][row, place] = [-(-low * s // 100) for s in score], [high * s // 100 for s in score]
        found = stored.mapInArrow(_between(shipped, spark.sparkContext.broadcast(windows), kind, scale, negatives), "anchor long, key long, score long, id long, at long")
        mined = _first(found, ["key"], negatives).select("anchor", (F.col("key") % positives).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        pairs = spark.createDataFrame(pa.table({"anchor": near.column("anchor"), "place": pa.array(place, pa.int64()), "anchor_id": chunk.column("vec_id").take(pa.array(row)), "positive_id": near.column("id"), "positive_score": near.column("score")}))
        mined.join(F.broadcast(pairs), ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score").write.mode("append").parquet(out)
        shipped.unpersist()
    return spark.read.schema(schema).parquet(out)
