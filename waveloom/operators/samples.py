"""Complex samples: decoding, conditioning, moments, lags and spectra, all keyed by capture."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waveloom.functions.columns import db

#: Theoretical |C40| and |C42| over squared power.
CONSTELLATIONS = {"bpsk": (2.0, 2.0), "qpsk": (1.0, 1.0), "8psk": (0.0, 1.0), "qam16": (0.68, 0.68), "qam64": (0.62, 0.62), "noise": (0.0, 0.0)}


def in_order() -> Window:
    return Window.partitionBy("capture_id").orderBy("n")


def decode(arrays: DataFrame, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """(capture_id, n, i, q) from interleaved arrays; an odd last value is dropped."""
    pair = F.expr(f"transform(sequence(0, cast(size({values}) / 2 as int) - 1), k -> struct(k as n, double({values}[2 * k]) as i, double({values}[2 * k + 1]) as q))")
    return arrays.where(F.size(values) >= 2).select(F.col(key).alias("capture_id"), F.explode(pair).alias("s")).select("capture_id", F.col("s.n").cast("long").alias("n"), "s.i", "s.q")


def condition(iq: DataFrame) -> DataFrame:
    """Samples without their mean and at unit power, with the power taken out as dBFS."""
    whole = Window.partitionBy("capture_id")
    own = iq.withColumn("i", F.col("i") - F.avg("i").over(whole)).withColumn("q", F.col("q") - F.avg("q").over(whole))
    own = own.withColumn("scale", F.sqrt(F.avg(F.col("i") * F.col("i") + F.col("q") * F.col("q")).over(whole)))
    by = F.when(F.col("scale") > 0, F.col("scale"))
    return own.select("capture_id", "n", (F.col("i") / by).alias("i"), (F.col("q") / by).alias("q"), (20 * F.log10(by)).alias("dbfs"))


def mix_down(iq: DataFrame, cycles: float, every: int = 1, first: int = 0, last: int | None = None) -> DataFrame:
    """Samples [first, last) turned by -cycles a sample, each every-th of them."""
    iq = iq.where((F.col("n") >= first) & (F.lit(True) if last is None else F.col("n") < last)).withColumn("n", F.col("n") - first)
    turn = F.lit(2 * math.pi * cycles) * F.col("n")
    return iq.where(F.col("n") % every == 0).select("capture_id", (F.col("n") / every).cast("long").alias("n"), (F.col("i") * F.cos(turn) + F.col("q") * F.sin(turn)).alias("i"), (F.col("q") * F.cos(turn) - F.col("i") * F.sin(turn)).alias("q"))


def instantaneous(iq: DataFrame) -> DataFrame:
    """Amplitude, phase, unwrapped phase and frequency (cycles a sample, to the sample before)."""
    pi_, pq = F.lag("i").over(in_order()), F.lag("q").over(in_order())
    own = iq.withColumn("a", F.hypot("i", "q")).withColumn("phase", F.atan2("q", "i"))
    own = own.withColumn("freq", F.atan2(F.col("q") * pi_ - F.col("i") * pq, F.col("i") * pi_ + F.col("q") * pq) / (2 * math.pi))
    step = F.col("phase") - F.lag("phase").over(in_order())
    own = own.withColumn("jump", F.coalesce(F.when(step > math.pi, -2 * math.pi).when(step < -math.pi, 2 * math.pi), F.lit(0.0)))
    return own.withColumn("unwrapped", F.col("phase") + F.sum("jump").over(in_order())).drop("jump")


def envelope_measures(iq: DataFrame) -> DataFrame:
    """AM depth from the 1st and 99th percentile of amplitude, FM deviation from the 99th of frequency, and envelope statistics."""
    p = lambda c, x: F.percentile(c, F.lit(x))
    own = instantaneous(iq).groupBy("capture_id").agg(p("a", 0.01).alias("lo"), p("a", 0.99).alias("hi"), p(F.abs("freq"), 0.99).alias("fm_deviation"), (F.var_pop("a") / F.pow(F.avg("a"), 2)).alias("envelope_var"), F.stddev_pop("freq").alias("sigma_af"), F.kurtosis("a").alias("kurtosis_a"), (10 * F.log10(F.max(F.col("a") * F.col("a")) / F.avg(F.col("a") * F.col("a")))).alias("papr_db"))
    depth = (F.col("hi") - F.col("lo")) / (F.col("hi") + F.col("lo"))
    return own.select("capture_id", depth.alias("am_depth"), F.when(F.col("envelope_var") < 0.005, 0.3).otherwise(0.8).alias("am_confidence"), "fm_deviation", F.when(F.col("envelope_var") < 0.05, 0.85).otherwise(0.45).alias("fm_confidence"), "envelope_var", "sigma_af", "kurtosis_a", "papr_db")


def cumulants(iq: DataFrame) -> DataFrame:
    """Ratios |C40| and |C42| over C21 squared; NULL below 16 samples or without power."""
    i, q = F.col("i"), F.col("q")
    p, sr, si = i * i + q * q, i * i - q * q, 2 * i * q
    m = iq.groupBy("capture_id").agg(F.count("*").alias("n"), F.avg(p).alias("m21"), F.avg(sr).alias("m20r"), F.avg(si).alias("m20i"), F.avg(sr * sr - si * si).alias("m40r"), F.avg(2 * sr * si).alias("m40i"), F.avg(p * p).alias("m42"))
    c40 = F.hypot(F.col("m40r") - 3 * (F.col("m20r") * F.col("m20r") - F.col("m20i") * F.col("m20i")), F.col("m40i") - 6 * F.col("m20r") * F.col("m20i"))
    c42 = F.abs(F.col("m42") - (F.col("m20r") * F.col("m20r") + F.col("m20i") * F.col("m20i")) - 2 * F.col("m21") * F.col("m21"))
    ok = (F.col("n") >= 16) & (F.col("m21") > 0)
    return m.select("capture_id", F.when(ok, c40 / (F.col("m21") * F.col("m21"))).alias("c40_ratio"), F.when(ok, c42 / (F.col("m21") * F.col("m21"))).alias("c42_ratio"))


def nearest_constellation(moments: DataFrame) -> DataFrame:
    """The constellation whose theoretical ratios lie nearest, the first of equals."""
    table = moments.sparkSession.createDataFrame([(k, name, *r) for k, (name, r) in enumerate(CONSTELLATIONS.items())], "k int, label string, t40 double, t42 double")
    far = F.hypot(F.col("c40_ratio") - F.col("t40"), F.col("c42_ratio") - F.col("t42"))
    near = moments.crossJoin(F.broadcast(table)).groupBy("capture_id").agg(F.min(F.struct(far.alias("distance"), "k", "label")).alias("x"))  # six fixed rows
    return near.select("capture_id", F.col("x.label").alias("label"), F.col("x.distance").alias("distance"))


def autocorrelation(iq: DataFrame, lags: int) -> DataFrame:
    """Normalised magnitude of the autocorrelation at lags 1 to `lags`."""
    power = F.sum(F.col("i") * F.col("i") + F.col("q") * F.col("q"))
    sums = [f(k) for k in range(1, lags + 1) for f in (lambda k: F.sum(F.col("i") * F.col(f"i{k}") + F.col("q") * F.col(f"q{k}")).alias(f"r{k}"), lambda k: F.sum(F.col("q") * F.col(f"i{k}") - F.col("i") * F.col(f"q{k}")).alias(f"s{k}"))]
    own = iq.select("*", *[F.lag(c, k).over(in_order()).alias(f"{c}{k}") for k in range(1, lags + 1) for c in "iq"])
    own = own.groupBy("capture_id").agg(power.alias("power"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), (F.hypot(F.coalesce(f"r{k}", F.lit(0.0)), F.coalesce(f"s{k}", F.lit(0.0))) / F.col("power")).alias("r")) for k in range(1, lags + 1)]))
    return own.where("power > 0").select("capture_id", rows.alias("x")).select("capture_id", "x.*")


def dft_power(iq: DataFrame, size: int, order: int = 1) -> DataFrame:
    """(capture_id, k, p): power of bin k of the transform over `size` samples of the order-th power of the samples.

    A join of samples with bins, summed per bin: the reference form of the Arrow transform.
    """
    i, q = F.col("i"), F.col("q")
    for _ in range(order - 1):
        i, q = i * F.col("i") - q * F.col("q"), i * F.col("q") + q * F.col("i")
    own = iq.select("capture_id", "n", i.alias("i"), q.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k"))
    turn = F.lit(-2 * math.pi / size) * ((F.col("k") * F.col("n")) % size)
    sums = own.groupBy("capture_id", "k").agg(F.sum(F.col("i") * F.cos(turn) - F.col("q") * F.sin(turn)).alias("re"), F.sum(F.col("i") * F.sin(turn) + F.col("q") * F.cos(turn)).alias("im"))
    return sums.select("capture_id", F.col("k").cast("long").alias("k"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))


def fft_power(arrays: DataFrame, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """The same as dft_power over each array, by the fast transform in Arrow batches."""
    import numpy as np

    def run(frames):
        for pdf in frames:
            pdf["p"] = [np.abs(np.fft.fft(np.asarray(x, float)[0 : len(x) // 2 * 2 : 2] + 1j * np.asarray(x, float)[1::2])) ** 2 for x in pdf["v"]]
            yield pdf[["capture_id", "p"]]

    own = arrays.where(F.size(values) >= 2).select(F.col(key).alias("capture_id"), F.expr(f"slice({values}, 1, cast(size({values}) / 2 as int) * 2)").alias("v"))
    return own.mapInPandas(run, "capture_id long, p array<double>").select("capture_id", F.posexplode("p").alias("k", "p")).select("capture_id", F.col("k").cast("long").alias("k"), "p")


def spectral_shape(power: DataFrame, size: int, fraction: float = 0.99) -> DataFrame:
    """Flatness, centroid, sideband asymmetry and occupied width of spectra (capture_id, k, p) in bins from -size/2."""
    own = power.withColumn("f", F.when(F.col("k") >= size // 2, F.col("k") - size).otherwise(F.col("k")))
    w = Window.partitionBy("capture_id")
    own = own.withColumn("cum", F.sum("p").over(w.orderBy("f")) / F.sum("p").over(w))
    edge = (1 - fraction) / 2
    return own.groupBy("capture_id").agg(
        (F.exp(F.avg(F.log(F.greatest("p", F.lit(1e-30))))) / F.avg("p")).alias("flatness"),
        (F.sum(F.col("p") * F.col("f")) / F.sum("p")).alias("centroid"),
        (db(F.sum(F.when(F.col("f") > 0, F.col("p")))) - db(F.sum(F.when(F.col("f") < 0, F.col("p"))))).alias("asymmetry_db"),
        (F.min(F.when(F.col("cum") >= 1 - edge, F.col("f"))) - F.min(F.when(F.col("cum") >= edge, F.col("f"))) + 1).cast("long").alias("obw_bins"),
        F.max_by("f", F.struct("p", -F.col("f"))).cast("long").alias("peak_bin"),
    )


def mth_power_line(iq: DataFrame, size: int, orders: tuple[int, ...] = (2, 4, 8), least_db: float = 10.0) -> DataFrame:
    """The order of phase modulation whose power has the sharpest line; NULL below `least_db`."""
    parts = None
    for m in orders:
        p = dft_power(iq, size, m).groupBy("capture_id").agg((10 * F.log10(F.max("p") / F.median("p"))).alias("sharpness_db")).withColumn("psk_order", F.lit(m).cast("long"))
        parts = p if parts is None else parts.union(p)
    best = parts.groupBy("capture_id").agg(F.max(F.struct("sharpness_db", (-F.col("psk_order")).alias("o"))).alias("x"))
    return best.select("capture_id", F.when(F.col("x.sharpness_db") >= least_db, -F.col("x.o")).alias("psk_order"), F.col("x.sharpness_db").alias("sharpness_db"))


def windows(iq: DataFrame, size: int, step: int) -> DataFrame:
    """(capture_id, w, power): mean power of each full window of `size` samples, `step` apart."""
    total = F.max("n").over(Window.partitionBy("capture_id")) + 1
    own = iq.withColumn("total", total).withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("n") - size) / step) + 1), F.floor(F.col("n") / step))))
    return own.where(F.col("w") * step + size <= F.col("total")).groupBy("capture_id", "w").agg(F.avg(F.col("i") * F.col("i") + F.col("q") * F.col("q")).alias("power"))
