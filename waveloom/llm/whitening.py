"""Whitening of embeddings by an incremental eigendecomposition that Spark's partitions share out.

Every partition keeps the spectrum of the vectors it has read: their number, mean and the
eigendecomposition of their scatter. One more vector x is a centred rank-one update,
scatter + n / (n + 1) (x - mean)(x - mean)', done by the secular equation with deflation (`secular`).
A task keeps a few spectra and updates them together, so that a step is arithmetic on whole arrays.
Two spectra are combined by as many successive rank-one updates as one has eigenvalues, and one
more for the means; partitions are combined in a tree, so that no task and not the driver holds
more than FAN of them. The leading vectors are then refined by distributed Rayleigh-Ritz steps with
the exact mean, until what is left over is rounding.

Components of the vectors are whole numbers, floor(scale c) + offset, so counts, sums and
deviations are exact.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .secular import EPS, updated

COMPONENTS, SCALE, OFFSET = 8, 1024.0, 100_000
#: Further vectors that the refinement carries along, spectra that are combined in one task, and most steps of the refinement.
GUARD, FAN, ROUNDS = 24, 16, 5
#: A refinement ends once what is left over is this share of the largest eigenvalue; eigenvalues below it count as none.
LEFT, NONE = 1e-14, 1e-13
#: Entries of all the spectra that a task updates together, and most of them.
TOGETHER, LANES = 1 << 16, 16
#: Whole numbers beyond this count as this.
MOST = 1 << 62


def _usable():
    return F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")


def whole(batch, d: int, scale: float, offset: int) -> np.ndarray:
    """The vectors of an Arrow batch as rows of whole numbers."""
    c = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * scale), -float(MOST), float(MOST)).astype(np.int64) + offset


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S exactly: as 64-bit numbers where these hold it, else as Python's."""
    most = max(int(x.max()), -int(x.min())) if x.size else 0
    if n * most + max(map(abs, sums)) < MOST:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


@dataclass
class Spectra:
    """m spectra of vectors of d components: how many vectors, their means, and the eigendecompositions of their scatters."""

    n: np.ndarray
    mean: np.ndarray
    d: np.ndarray
    q: np.ndarray

    @classmethod
    def empty(cls, m: int, d: int) -> Spectra:
        return cls(np.zeros(m), np.zeros((m, d)), np.zeros((m, d)), np.tile(np.eye(d), (m, 1, 1)))

    def add(self, x: np.ndarray) -> None:
        """One vector to each of the first len(x) spectra."""
        r = len(x)
        diff = x - self.mean[:r]
        more = self.n[:r] + 1
        v = np.sqrt(self.n[:r] / more)[:, None] * diff
        self.mean[:r] += diff / more[:, None]
        self.n[:r] = more
        self.d[:r], self.q[:r] = updated(self.d[:r], self.q[:r], v)

    def combined(self) -> Spectra:
        """All of them as one: halves are combined pair by pair, the second of each pair as rank-one updates of the first."""
        s = self
        while len(s.n) > 1:
            half = len(s.n) // 2
            a, b = slice(0, half), slice(half, 2 * half)
            n = s.n[a] + s.n[b]
            share = np.where(n > 0, s.n[b] / np.maximum(n, 1), 0)
            apart = s.mean[b] - s.mean[a]
            d, q = updated(s.d[a], s.q[a], np.sqrt(s.n[a] * share)[:, None] * apart)
            for i in range(s.d.shape[1]):
                d, q = updated(d, q, np.sqrt(np.maximum(s.d[b, i], 0))[:, None] * s.q[b][:, :, i])
            rest = slice(2 * half, None)
            s = Spectra(np.concatenate([n, s.n[rest]]), np.concatenate([s.mean[a] + share[:, None] * apart, s.mean[rest]]), np.concatenate([d, s.d[rest]]), np.concatenate([q, s.q[rest]]))
        return s

    def packed(self) -> bytes:
        return b"".join(np.ascontiguousarray(x[0], np.float64).tobytes() for x in (self.n.reshape(-1, 1), self.mean, self.d, self.q))

    @classmethod
    def unpacked(cls, parts: list[bytes], d: int) -> Spectra:
        flat = np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1)
        return cls(flat[:, 0].copy(), flat[:, 1 : d + 1].copy(), flat[:, d + 1 : 2 * d + 1].copy(), flat[:, 2 * d + 1 :].reshape(-1, d, d).copy())


def _ints(values: list[int]) -> bytes:
    return b"".join(v.to_bytes(16, "little", signed=True) for v in values)


def _of_ints(data: bytes) -> list[int]:
    return [int.from_bytes(data[i : i + 16], "little", signed=True) for i in range(0, len(data), 16)]


def _summed(x: np.ndarray) -> list[int]:
    """Sums of the columns of at most 2**31 rows, without overflow."""
    return [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]


def _spectrum(d: int, scale: float, offset: int):
    """Arrow function: the spectrum of a partition and the exact sums of its components."""
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        s = Spectra.empty(max(1, min(LANES, TOGETHER // (d * d))), d)
        total, n = [0] * d, 0
        for b in batches:
            if not b.num_rows:
                continue
            x = whole(b, d, scale, offset)
            total, n = [a + c for a, c in zip(total, _summed(x), strict=True)], n + len(x)
            for lo in range(0, len(x), len(s.n)):
                s.add(x[lo : lo + len(s.n)].astype(np.float64))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([struct.pack("<q", n) + _ints(total) + s.combined().packed()], pa.binary())], ["part", "state"])

    return run


def _merge_spectra(d: int):
    def merge(states: list[bytes]) -> bytes:
        head = 8 + 16 * d
        n = sum(struct.unpack_from("<q", s)[0] for s in states)
        total = [sum(t) for t in zip(*[_of_ints(s[8:head]) for s in states], strict=True)]
        return struct.pack("<q", n) + _ints(total) + Spectra.unpacked([s[head:] for s in states], d).combined().packed()

    return merge


def _products(d: int, scale: float, offset: int, n: int, sums: list[int], basis):
    """Arrow function: over a partition's centred vectors y, the sum of y y' times the basis, and that of their squares."""
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        z, squares = np.zeros_like(basis.value), 0.0
        for b in batches:
            if b.num_rows:
                y = (deviations(whole(b, d, scale, offset), n, sums) / n).astype(np.float64)
                z += y.T @ (y @ basis.value)
                squares += float((y * y).sum())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.append(z, squares).tobytes()], pa.binary())], ["part", "state"])

    return run


def _add(states: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(s, np.float64) for s in states], 0).tobytes()


def _spread(d: int, scale: float, offset: int, n: int, sums: list[int], turn):
    """Arrow function: number, mean and scatter of a partition's whitened vectors."""
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        parts = []
        for b in batches:
            if b.num_rows:
                w = (deviations(whole(b, d, scale, offset), n, sums) / n).astype(np.float64) @ turn.value
                mean = w.mean(0)
                parts.append(np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()]).tobytes())
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_merge_spread(turn.value.shape[1])(parts)], pa.binary())], ["part", "state"])

    return run


def _merge_spread(k: int):
    def merge(states: list[bytes]) -> bytes:
        n, mean, scatter = 0.0, np.zeros(k), np.zeros((k, k))
        for s in states:
            flat = np.frombuffer(s, np.float64)
            more, apart = n + flat[0], flat[1 : k + 1] - mean
            scatter = scatter + flat[k + 1 :].reshape(k, k) + np.outer(apart, apart) * (n * flat[0] / more)
            n, mean = more, mean + apart * (flat[0] / more)
        return np.concatenate([[n], mean, scatter.ravel()]).tobytes()

    return merge


def _folded(states: DataFrame, merge) -> bytes | None:
    """One state out of those of all partitions (part, state), by a tree in which a task meets at most FAN of them."""
    import pyarrow as pa

    def fold(t):
        return pa.table({"part": pa.array([t.column("part")[0].as_py() // FAN], pa.int64()), "state": pa.array([merge([s for _, s in sorted(zip(t.column("part").to_pylist(), t.column("state").to_pylist(), strict=True))])], pa.binary())})

    states = written(states, "states")
    most = states.agg(F.max("part")).first()[0]
    while most:
        states = states.groupBy((F.col("part") / FAN).cast("long").alias("of")).applyInArrow(fold, "part long, state binary")
        most //= FAN
    first = states.select("state").first()
    return bytes(first[0]) if first else None


@dataclass
class Model:
    """What whitening needs: number and sums of the vectors, eigenvectors in columns, eigenvalues by falling size, trace, and the error of identity."""

    length: int
    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float | None
    rounds: int

    @property
    def turn(self) -> np.ndarray:
        """The matrix that whitens; components without variance are NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.vectors / np.where(self.values > NONE * self.values[0], np.sqrt(np.abs(self.values)), np.nan)


def kept(table: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) of the vectors that take part, written once, and their length (0 where there is none).

    Vectors that are null or hold null or non-finite entries are dropped. A covariance is of
    vectors of one length: that of most of them, of the longest where lengths tie; others are dropped.
    """
    rows = written(table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(_usable()), "whiten")
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows, 0) if most is None else (rows.where(F.size("embedding") == most["d"]), most["d"])


def fit(rows: DataFrame, d: int, components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET) -> Model | None:
    """The model of rows (vec_id, embedding) of d components each; None if there is no row."""
    context = rows.sparkSession.sparkContext
    vectors = rows.select("embedding")
    state = _folded(vectors.mapInArrow(_spectrum(d, scale, offset), "part long, state binary"), _merge_spectra(d))
    if state is None:
        return None
    n, sums = struct.unpack_from("<q", state)[0], _of_ints(state[8 : 8 + 16 * d])
    s = Spectra.unpacked([state[8 + 16 * d :]], d)
    k = min(d, components + GUARD)
    basis = s.q[0][:, ::-1][:, :k]
    for rounds in range(1, ROUNDS + 1):
        flat = np.frombuffer(_folded(vectors.mapInArrow(_products(d, scale, offset, n, sums, context.broadcast(basis)), "part long, state binary"), _add), np.float64)
        z, trace = flat[:-1].reshape(d, k) / n, flat[-1] / n
        small = basis.T @ z
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1], inner[:, ::-1]
        turned, image = basis @ inner, z @ inner
        rest = np.linalg.norm(image - turned * values, axis=0)[:components].max()
        basis = np.linalg.qr(turned)[0] * np.sign(np.einsum("ij,ij->j", np.linalg.qr(turned)[0], turned))
        if not values[0] > 0 or rest <= LEFT * values[0] * np.sqrt(d):
            break
        if rounds < ROUNDS and k < d:  # a power step, whose errors shrink by the ratio of the eigenvalues
            basis = np.linalg.qr(np.where(values > NONE * values[0], image, turned))[0]
    c = min(components, d)
    vectors_, values = basis[:, :c], np.maximum(values[:c], 0)
    vectors_ = vectors_ * np.where(np.take_along_axis(vectors_, np.abs(vectors_).argmax(0)[None], 0) < 0, -1, 1)
    model = Model(d, n, sums, vectors_, values, float(trace), None, rounds)
    live = np.flatnonzero(np.isfinite(model.turn).all(0)) if values[0] > 0 else []
    if len(live):
        flat = np.frombuffer(_folded(vectors.mapInArrow(_spread(d, scale, offset, n, sums, context.broadcast(model.turn[:, live])), "part long, state binary"), _merge_spread(len(live))), np.float64)
        model.error = float(np.abs(flat[1 + len(live) :].reshape(len(live), -1) / flat[0] - np.eye(len(live))).max())
    return model


def _emitted(d: int, scale: float, offset: int, model):
    """Arrow function: a row for each vector and component."""
    import pyarrow as pa

    def run(batches):
        m = model.value
        c = len(m.values)
        turn = m.turn if m.values[0] > 0 else np.full((d, c), np.nan)
        told = m.values / m.trace if m.trace > 0 else np.full(c, np.nan)
        for b in batches:
            if not b.num_rows:
                continue
            dev = deviations(whole(b, d, scale, offset), m.n, m.sums)
            if dev.dtype == object or d * float(np.abs(dev).max()) ** 2 >= MOST:
                dev = dev.astype(object)
                far = [v if v < 1 << 63 else None for v in (dev * dev).sum(1)]
            else:
                far = (dev * dev).sum(1)
            w = (dev / m.n).astype(np.float64) @ turn
            n = len(w)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(np.repeat(np.arange(n), c))),
                    pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * c, m.n)),
                    pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(n), c))),
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.tile(told, n), from_pandas=True),
                    pa.array([m.error] * (n * c), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whitened(table: DataFrame, components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector of table (vec_id, embedding, ...) and component.

    Vectors that are null or hold null or non-finite entries have no rows, nor have those whose
    length is not that of most vectors (the longer, where two lengths are as frequent). Repeated
    rows and rows without vec_id count and get their rows each; other columns are ignored; a table
    without a usable vector gives no rows. Of components without variance whitened is null, and
    identity_error is told by the others; explained is null where nothing varies. A deviation beyond
    64 bits is null, and entries beyond 2**62 / scale count as that.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows, d = kept(table)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, d, components, scale, offset) if d else None
    if model is None:
        return spark.createDataFrame([], schema)
    return rows.mapInArrow(_emitted(d, scale, offset, spark.sparkContext.broadcast(model)), schema)
