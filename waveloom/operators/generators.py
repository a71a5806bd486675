"""Signals of known truth as rows of samples (capture_id, n, i, q): tones, shift keying, sweeps, multicarrier and noise.

Symbols and noise come from hashes of (seed, capture, number), so any part of a signal can be made anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from a seed and columns."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def _samples(spark: SparkSession, n: int, capture_id: int) -> DataFrame:
    return spark.range(n).select(F.lit(capture_id).cast("long").alias("capture_id"), F.col("id").alias("n"))


def _turned(rows: DataFrame, cycles: Column) -> DataFrame:
    """Unit samples at a phase given in cycles."""
    return rows.select("capture_id", "n", F.cos(2 * math.pi * cycles).alias("i"), F.sin(2 * math.pi * cycles).alias("q"))


def tone(spark: SparkSession, f: float, rate: float, n: int, capture_id: int = 0) -> DataFrame:
    """A complex tone of frequency f."""
    return _turned(_samples(spark, n, capture_id), F.col("n") * (f / rate))


def chirp(spark: SparkSession, f0: float, f1: float, duration: float, rate: float, capture_id: int = 0) -> DataFrame:
    """A linear sweep from f0 to f1."""
    t, slope = F.col("n") / rate, (f1 - f0) / duration
    return _turned(_samples(spark, round(duration * rate), capture_id), f0 * t + 0.5 * slope * t * t)


def fsk(spark: SparkSession, order: int, deviation: float, per_symbol: int, rate: float, symbols: int, seed: int = 0, capture_id: int = 0) -> DataFrame:
    """Frequency shift keying with levels from -deviation to deviation and continuous phase."""
    own = _samples(spark, symbols * per_symbol, capture_id).withColumn("m", F.floor(uniform(seed, F.floor(F.col("n") / per_symbol)) * order))
    level = (F.col("m") - (order - 1) / 2) * (2 * deviation / max(order - 1, 1)) if order > 1 else F.lit(0.0)
    return _turned(own.withColumn("phase", F.sum(level / rate).over(Window.partitionBy("capture_id").orderBy("n"))), F.col("phase"))


def pulse(beta: float, per_symbol: int, span: int) -> list[float]:
    """Root-raised-cosine taps of unit energy over `span` symbols."""
    out = []
    for k in range(-span * per_symbol // 2, span * per_symbol // 2 + 1):
        t = k / per_symbol
        if k == 0:
            out.append(1 - beta + 4 * beta / math.pi)
        elif beta and abs(abs(4 * beta * t) - 1) < 1e-9:
            out.append(beta / math.sqrt(2) * ((1 + 2 / math.pi) * math.sin(math.pi / 4 / beta) + (1 - 2 / math.pi) * math.cos(math.pi / 4 / beta)))
        else:
            out.append((math.sin(math.pi * t * (1 - beta)) + 4 * beta * t * math.cos(math.pi * t * (1 + beta))) / (math.pi * t * (1 - (4 * beta * t) ** 2)))
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out]


def psk(spark: SparkSession, order: int, per_symbol: int, symbols: int, beta: float = 0.35, span: int = 8, seed: int = 0, capture_id: int = 0) -> DataFrame:
    """Phase shift keying with root-raised-cosine pulses: every sample adds up the pulses of the symbols around it."""
    taps = pulse(beta, per_symbol, span)
    half, n = len(taps) // 2, symbols * per_symbol
    places = spark.createDataFrame([(k - half, x) for k, x in enumerate(taps)], "by int, tap double")  # a row per tap
    marks = spark.range(symbols).withColumn("m", F.floor(uniform(seed, F.col("id")) * order))
    spread = marks.crossJoin(F.broadcast(places)).select((F.col("id") * per_symbol + F.col("by")).alias("n"), (F.col("tap") * F.cos(2 * math.pi * F.col("m") / order)).alias("i"), (F.col("tap") * F.sin(2 * math.pi * F.col("m") / order)).alias("q"))
    own = spread.where(F.col("n").between(0, n - 1)).groupBy("n").agg(F.sum("i").alias("i"), F.sum("q").alias("q"))
    zero = _samples(spark, n, capture_id).join(own, "n", "left")
    return zero.select("capture_id", "n", F.coalesce("i", F.lit(0.0)).alias("i"), F.coalesce("q", F.lit(0.0)).alias("q"))


def ofdm(spark: SparkSession, carriers: int, prefix: int, symbols: int, seed: int = 0, capture_id: int = 0) -> DataFrame:
    """Multicarrier symbols of QPSK on each carrier, each with its end repeated before it."""
    own = _samples(spark, symbols * (carriers + prefix), capture_id)
    own = own.withColumn("s", F.floor(F.col("n") / (carriers + prefix))).withColumn("at", F.pmod(F.col("n") % (carriers + prefix) - prefix, F.lit(carriers)))
    each = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(carriers - 1))))
    sign = lambda part: F.when(uniform(seed, F.lit(part), F.col("s"), F.col("k")) < 0.5, -1.0).otherwise(1.0) / math.sqrt(2)
    turn = 2 * math.pi / carriers * (F.col("k") * F.col("at") % carriers)
    re, im = sign(0), sign(1)
    return each.groupBy("capture_id", "n").agg((F.sum(re * F.cos(turn) - im * F.sin(turn)) / math.sqrt(carriers)).alias("i"), (F.sum(re * F.sin(turn) + im * F.cos(turn)) / math.sqrt(carriers)).alias("q"))


def with_noise(signal: DataFrame, snr_db: float, seed: int = 0) -> DataFrame:
    """The signal with white Gaussian noise at a ratio to each capture's mean power."""
    power = F.avg(F.col("i") * F.col("i") + F.col("q") * F.col("q")).over(Window.partitionBy("capture_id"))
    size = F.sqrt(power / 10 ** (snr_db / 10) / 2) * F.sqrt(-2 * F.log(uniform(seed, F.col("capture_id"), F.col("n"), F.lit(1))))
    turn = 2 * math.pi * uniform(seed, F.col("capture_id"), F.col("n"), F.lit(2))
    return signal.select("capture_id", "n", (F.col("i") + size * F.cos(turn)).alias("i"), (F.col("q") + size * F.sin(turn)).alias("q"))
