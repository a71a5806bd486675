"""Measurements of captures: frames, spectra, widths, lines, lags, sweeps, tones and filters.

Arrow batches do only what has no expression in Spark, the transform or filter of one bounded
block; what is measured on their rows are columns and grouped aggregates. Frequencies are in
cycles a sample. Long recordings come as overlapping blocks (`sources.recordings`), so that no
block holds more than a fixed number of samples. What can't be measured is NULL.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveloom.functions.columns import clip, logistic, refine
from waveloom.functions.session import byte_batches

#: Coefficients of the four-term Blackman-Harris window.
BLACKMAN_HARRIS = (0.35875, -0.48829, 0.14128, -0.01168)
MOST_POINTS = 1 << 22
#: Numbers of results that an Arrow batch holds, about.
PIECE = 1 << 18


def blocks(iq: DataFrame) -> DataFrame:
    """(capture_id, i, q): the samples of each capture in order, as arrays; a capture here is a block of bounded length."""
    own = iq.groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct("n", "i", "q"))).alias("s"))
    return own.select("capture_id", F.col("s.i").alias("i"), F.col("s.q").alias("q"))


def _cosines(n: int, terms: tuple[float, ...]) -> np.ndarray:
    return sum(a * np.cos(2 * np.pi * k * np.arange(n) / n) for k, a in enumerate(terms))


def _arrays(df: DataFrame, keys: str, given: list[str], each) -> DataFrame:
    """keys and v: `each` of the arrays of a row, in Arrow batches; keys is a schema, v an array.

    Batches come by their bytes, and results leave once they have PIECE numbers, so memory does not grow with the rows of a partition.
    """
    import pandas as pd

    names = [k.split()[0] for k in keys.split(", ")]
    byte_batches(df.sparkSession)

    def run(frames):
        for pdf in frames:
            v, first, held = [], 0, 0
            for row in zip(*(pdf[c] for c in given), strict=True):
                v.append(each(*(np.asarray(x, float) for x in row)))
                held += len(v[-1])
                if held >= PIECE or first + len(v) == len(pdf):
                    part = pdf[names].iloc[first : first + len(v)]
                    yield pd.concat([part, pd.Series(v, index=part.index, name="v", dtype=object)], axis=1)
                    v, first, held = [], first + len(v), 0

    return df.select(*names, *given).mapInPandas(run, f"{keys}, v array<double>")


def frame_power(own: DataFrame, size: int, hop: int) -> DataFrame:
    """(capture_id, t, f, p): power of bin f, from -size/2, of each whole Hann frame t, `hop` samples apart."""
    window = _cosines(size, (0.5, -0.5))
    scale = float(window @ window)

    def each(i, q):
        return np.abs(np.fft.fftshift(np.fft.fft((i + 1j * q) * window))) ** 2 / scale

    starts = own.where(F.size("i") >= size).select("capture_id", "i", "q", F.posexplode(F.expr(f"sequence(0, size(i) - {size}, {hop})")).alias("t", "s"))
    cut = starts.select("capture_id", F.col("t").cast("long").alias("t"), F.slice("i", F.col("s") + 1, size).alias("i"), F.slice("q", F.col("s") + 1, size).alias("q"))
    rows = _arrays(cut, "capture_id long, t long", ["i", "q"], each).select("capture_id", "t", F.posexplode("v").alias("k", "p"))
    return rows.select("capture_id", "t", (F.col("k") - size // 2).cast("long").alias("f"), "p")


def welch(own: DataFrame, size: int) -> DataFrame:
    """(capture_id, f, p): mean power over frames that overlap by half."""
    return frame_power(own, size, size // 2).groupBy("capture_id", "f").agg(F.avg("p").alias("p"))


def humps(heights: Column, rise: Column | float = 6.0) -> Column:
    """Number of peaks of an array that stand out by `rise` on both sides: one fold that waits for a rise, then a fall."""
    state = F.struct(F.lit(False).alias("up"), F.element_at(heights, 1).alias("edge"), F.lit(0).alias("n"))

    def step(s, x):
        high, low = F.greatest(s["edge"], x), F.least(s["edge"], x)
        fell, rose = s["up"] & (high - x >= rise), ~s["up"] & (x - low >= rise)
        return F.struct((rose | (s["up"] & ~fell)).alias("up"), F.when(fell | rose, x).when(s["up"], high).otherwise(low).alias("edge"), (s["n"] + fell.cast("int")).alias("n"))

    return F.aggregate(heights, state, step, lambda s: s["n"])


def _prominences(x: np.ndarray) -> list[tuple[int, float, float]]:
    """(position, height, prominence) of the maxima of an array; a plateau counts at its middle, the ends never.

    A maximum's prominence is its height over the higher of the two lowest points between it and the
    nearest higher value on either side, or the end. One pass each way keeps a stack of falling
    heights, each with the lowest point since the higher one before it.
    """
    if len(x) < 3:
        return []
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    v = x[first].tolist()
    middle_of = (first + np.r_[first[1:], len(x)] - 1) // 2

    def lowest(order):
        out, stack = [0.0] * len(v), []
        for k in order:
            low = v[k]
            while stack and stack[-1][0] <= v[k]:
                low = min(low, stack.pop()[1])
            stack.append((v[k], low))
            out[k] = low
        return out

    left, right = lowest(range(len(v))), lowest(range(len(v) - 1, -1, -1))
    return [(int(middle_of[k]), v[k], v[k] - max(left[k], right[k])) for k in range(1, len(v) - 1) if v[k - 1] < v[k] > v[k + 1]]


def peaks(heights: DataFrame, least: float = 0.0) -> DataFrame:
    """(capture_id, position, height, prominence) of the maxima of arrays (capture_id, d) that stand out by `least` or more; see `_prominences`.

    Arrays are spectra of bounded length. Those without a maximum give no rows.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(c, *r) for c, d in zip(b.column("capture_id").to_pylist(), b.column("d").to_pylist(), strict=True) if d for r in _prominences(np.asarray(d, float)) if r[2] >= least]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["capture_id", "position", "height", "prominence"])

    return heights.select(F.col("capture_id").cast("long").alias("capture_id"), F.col("d").cast("array<double>").alias("d")).mapInArrow(run, "capture_id long, position long, height double, prominence double")


def center_frequency(psd: DataFrame, size: int) -> DataFrame:
    """(capture_id, centroid, peak, humps, confidence) of densities (capture_id, f, p); peak between bins by a parabola in dB."""
    w = Window.partitionBy("capture_id").orderBy("f")
    own = psd.withColumn("d", 10 * F.log10(F.greatest("p", F.lit(1e-30))))
    own = own.withColumn("off", F.coalesce(refine(F.lag("d").over(w), F.col("d"), F.lead("d").over(w)), F.lit(0.0)))
    own = own.groupBy("capture_id").agg((F.sum(F.col("p") * F.col("f")) / F.sum("p") / size).alias("centroid"), (F.max_by(F.col("f") + F.col("off"), F.struct("p", -F.col("f"))) / size).alias("peak"), humps(F.sort_array(F.collect_list(F.struct("f", "d")))["d"]).cast("long").alias("humps"))
    return own.withColumn("confidence", F.when(F.col("humps") == 1, 0.9).when(F.col("humps") == 2, 0.5).otherwise(0.3))


def bandwidths(psd: DataFrame, size: int, fraction: float = 0.99) -> DataFrame:
    """(capture_id, obw, width_3db, width_20db, confidence) above the 10th percentile of the density.

    obw holds `fraction` of the power; a width by level reaches from the first to the last bin
    within it and has two bins at least. A band that fills the span is less sure.
    """
    whole = Window.partitionBy("capture_id")
    own = psd.withColumn("s", F.greatest(F.col("p") - F.expr("percentile(p, 0.1)").over(whole), F.lit(0.0)))
    own = own.withColumn("cum", F.sum("s").over(whole.orderBy("f")) / F.sum("s").over(whole)).withColumn("top", F.max("s").over(whole))
    edge = (1 - fraction) / 2

    def within(drop):
        near = F.when(F.col("s") >= F.col("top") * 10 ** (-drop / 10), F.col("f"))
        return F.greatest(F.max(near) - F.min(near) + 1, F.lit(2)) / size

    first = lambda share: F.min(F.when(F.col("cum") >= share, F.col("f")))
    out = own.groupBy("capture_id").agg(((first(1 - edge) - first(edge) + 1) / size).alias("obw"), within(3).alias("width_3db"), within(20).alias("width_20db"))
    return out.withColumn("confidence", F.when(F.col("obw") > 0.9, 0.35).when(F.col("obw") > 0.75, 0.6).otherwise(0.85))


def with_series(own: DataFrame) -> DataFrame:
    """Blocks with `power`, the squared envelope, `freq`, the step of phase in cycles, and `jumps`, the size of its changes."""
    # neighbours meet as two shifted arrays: an index into an array inside a lambda may work the array out anew for each element
    later, earlier = (lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))), (lambda x: F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))
    turn = lambda b, a: F.atan2(b["q"] * a["i"] - b["i"] * a["q"], b["i"] * a["i"] + b["q"] * a["q"]) / (2 * math.pi)
    z = F.arrays_zip("i", "q")
    own = own.withColumn("power", F.zip_with("i", "q", lambda a, b: a * a + b * b))
    own = own.withColumn("freq", F.zip_with(later(z), earlier(z), turn))
    return own.withColumn("jumps", F.zip_with(later(F.col("freq")), earlier(F.col("freq")), lambda b, a: F.abs(b - a)))


def lines(own: DataFrame, series: str, pad: int = 8) -> DataFrame:
    """(capture_id, d): amplitudes in dB of a real series, without its mean, under a Blackman-Harris window, padded.

    d runs in even steps from frequency 0 to one half. Series of under 16 values or without variation give no rows.
    """

    def each(x):
        x = x - x.mean() if len(x) else x
        if len(x) < 16 or x.std() < 1e-9:
            return np.zeros(0)
        points = min(MOST_POINTS, 1 << math.ceil(math.log2(pad * len(x))))
        return 20 * np.log10(np.abs(np.fft.rfft(x * _cosines(len(x), BLACKMAN_HARRIS), points)) + 1e-12)

    return _arrays(own, "capture_id long", [series], each).where(F.size("v") > 0).select("capture_id", F.col("v").alias("d"))


def line_rate(spectrum: DataFrame, low: float = 0.001, high: float = 0.5) -> DataFrame:
    """(capture_id, rate, height_db, confidence) of the highest line from low to high, over (capture_id, d) as `lines` gives it.

    Where a quarter, third or half of its frequency, tried in this order and taken within 2 %,
    has three quarters of its height over the median and 10 dB at least, the line is a harmonic of that.
    """
    between = lambda first, last: F.slice("d", (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int"))
    own = spectrum.withColumn("steps", 2.0 * (F.size("d") - 1)).withColumn("first", F.ceil(low * F.col("steps"))).withColumn("last", F.floor(high * F.col("steps")))
    own = own.withColumn("part", between(F.col("first"), F.col("last"))).withColumn("best", F.array_max("part")).where("best is not null")
    own = own.withColumn("mid", middle(F.col("part"))).withColumn("peak", F.array_position("part", F.col("best")) - 1 + F.col("first")).withColumn("height_db", F.col("best") - F.col("mid"))
    # a harmonic's root is looked for among the few bins within 2 % of its part of the peak
    near = lambda k: F.array_max(between(F.greatest(F.ceil(0.98 * F.col("peak") / k), F.col("first")), F.floor(1.02 * F.col("peak") / k))) - F.col("mid")
    own = own.select("capture_id", "height_db", (F.col("peak") / F.col("steps")).alias("rate"), *[near(k).alias(f"h{k}") for k in (4, 3, 2)])
    part = [F.when(F.col(f"h{k}") >= F.greatest(0.75 * F.col("height_db"), F.lit(10.0)), F.col("rate") / k) for k in (4, 3, 2)]
    return own.select("capture_id", F.coalesce(*part, "rate").alias("rate"), "height_db", logistic(F.col("height_db"), 0.398, 6.48).alias("confidence"))


def _lags(x: np.ndarray) -> np.ndarray:
    """Autocorrelation from lag 0 as a share of the power, its magnitude for complex samples; empty without power."""
    n = len(x)
    r = np.fft.ifft(np.abs(np.fft.fft(x, 2 * max(n, 1))) ** 2)[:n]
    r = np.abs(r) if np.iscomplexobj(x) else r.real
    return r / r[0] if n and r[0] > 0 else np.zeros(0)


def middle(values: Column) -> Column:
    """Median of an array, which is sorted once."""
    half = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return F.get(F.transform(F.array(F.sort_array(values)), half), F.lit(0))


def envelope_lag_rate(own: DataFrame, least: float = 0.25, over: float = 5.0) -> DataFrame:
    """(capture_id, rate, confidence) from the first strong lag of the squared envelope; NULL where none stands out."""
    r = _arrays(with_series(own), "capture_id long", ["power"], lambda x: _lags(x - x.mean()) if len(x) >= 16 else np.zeros(0)).withColumn("mid", middle(F.transform("v", F.abs)))
    lag = F.get(F.expr(f"filter(sequence(2, greatest(2, cast(size(v) / 2 as int))), k -> v[k] >= {least} and v[k] >= {over} * mid and v[k] > v[k - 1] and v[k] >= v[k + 1])"), F.lit(0))
    r = r.where(F.size("v") >= 16).withColumn("lag", lag)
    return r.select("capture_id", (1.0 / F.col("lag")).alias("rate"), F.coalesce(F.least(F.lit(0.6), F.get("v", F.col("lag"))), F.lit(0.0)).alias("confidence"))


def cyclic_prefix(own: DataFrame, most: int = 4096) -> DataFrame:
    """(capture_id, useful_length, cp_length, ratio, confidence) from the strongest lag beyond the main lobe.

    Lags run from 8, or where the main lobe has ended, to `most` or a quarter of the samples. The
    lag counts if it is 8 times the median and its share lies between 0.03 and 0.35. Blocks of under 256 samples tell nothing.
    """
    r = _arrays(own.where(F.size("i") >= 256), "capture_id long", ["i", "q"], lambda i, q: _lags(i + 1j * q)).where(F.size("v") > 0)
    lobe = F.coalesce(F.get(F.expr("filter(sequence(1, size(v) - 2), k -> v[k + 1] > v[k])"), F.lit(0)), F.size("v"))
    r = r.withColumn("first", F.greatest(F.lit(8), lobe + 1)).withColumn("last", F.least(F.lit(most), F.floor(F.size("v") / 4).cast("int"))).where("first < last")
    r = r.withColumn("part", F.expr("slice(v, first + 1, last - first + 1)")).withColumn("top", F.array_max("part"))
    r = r.withColumn("lag", (F.array_position("part", F.col("top")) - 1 + F.col("first")).cast("long")).withColumn("ratio", F.col("top") / middle(F.col("part")))
    ok = (F.col("ratio") >= 8) & F.col("top").between(0.03, 0.35)
    return r.select("capture_id", F.when(ok, F.col("lag")).alias("useful_length"), F.when(ok, F.col("top") * F.col("lag") / (1 - F.col("top"))).alias("cp_length"), "ratio", F.when(ok, clip(0.5 + 0.012 * (F.col("ratio") - 8), 0.5, 0.95)).otherwise(0.0).alias("confidence"))


def sweep(frames: DataFrame, size: int, hop: int, rise: float = 6.0, least: int = 8) -> DataFrame:
    """(capture_id, columns, rate, span, r2, nonlinear, confidence): a line through the strongest bins of frames.

    A frame counts if its strongest bin is `rise` dB over its median. The rate, in cycles a sample
    squared, is NULL below `least` frames, at R2 of 0.9 or less, or a span of 2 % of the band or
    less. A parabola that explains over 0.02 more makes the sweep nonlinear.
    """
    d = 10 * F.log10(F.greatest("p", F.lit(1e-30)))
    ridge = frames.groupBy("capture_id", "t").agg(F.max_by("f", F.struct("p", -F.col("f"))).cast("double").alias("y"), (F.max(d) - F.median(d)).alias("over")).where(F.col("over") > rise)
    x, z = F.col("t").cast("double"), F.col("t").cast("double") * F.col("t")
    own = ridge.groupBy("capture_id").agg(F.count("*").alias("columns"), F.regr_slope("y", x).alias("slope"), F.regr_r2("y", x).alias("r2"), (F.max("t") - F.min("t")).alias("length"), F.corr(x, "y").alias("xy"), F.corr(z, "y").alias("zy"), F.corr(x, z).alias("xz"))
    curved = (F.col("xy") * F.col("xy") + F.col("zy") * F.col("zy") - 2 * F.col("xy") * F.col("zy") * F.col("xz")) / F.when(F.col("xz") * F.col("xz") < 1, 1 - F.col("xz") * F.col("xz"))
    span = F.abs(F.col("slope")) * F.col("length") / size
    ok = (F.col("columns") >= least) & (F.col("r2") > 0.9) & (span > 0.02)
    return own.select("capture_id", "columns", F.when(ok, F.col("slope") / (size * hop)).alias("rate"), F.when(ok, span).alias("span"), "r2", F.coalesce(ok & (curved > F.col("r2") + 0.02), F.lit(False)).alias("nonlinear"), F.when(ok, 0.9 * clip((F.col("r2") - 0.9) / 0.1, 0.0, 1.0)).otherwise(0.0).alias("confidence"))


def tones(own: DataFrame, bins: int = 200, share: float = 0.15) -> DataFrame:
    """(capture_id, n_tones, deviation, spacing, confidence): peaks of the distribution of frequency steps.

    The histogram of `bins` bins is smoothed over five; a peak has `share` of the highest at
    least. 2 to 8 peaks are tones: deviation is half the outer distance, spacing the mean gap.
    """
    freq = with_series(own).select("capture_id", "freq", F.array_min("freq").alias("lo"), ((F.array_max("freq") - F.array_min("freq")) / bins).alias("width"))
    freq = freq.where("width > 0").select("capture_id", "lo", "width", F.explode("freq").alias("x"))
    cells = freq.groupBy("capture_id", "lo", "width", F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int").alias("k")).count()
    h = cells.groupBy("capture_id", "lo", "width").agg(F.map_from_entries(F.collect_list(F.struct("k", "count"))).alias("m"))
    h = h.withColumn("s", F.expr(f"transform(sequence(-1, {bins}), k -> coalesce(m[k - 2], 0) + coalesce(m[k - 1], 0) + coalesce(m[k], 0) + coalesce(m[k + 1], 0) + coalesce(m[k + 2], 0))"))
    h = h.withColumn("at", F.expr(f"filter(sequence(1, {bins}), k -> s[k] >= {share} * array_max(s) and s[k] > s[k - 1] and s[k] >= s[k + 1])"))
    h = h.withColumn("n", F.size("at")).withColumn("gaps", F.expr("transform(slice(at, 2, greatest(n, 1)), (x, k) -> (x - at[k]) * width)"))
    mean = F.aggregate("gaps", F.lit(0.0), lambda a, b: a + b) / F.size("gaps")
    h = h.withColumn("ok", F.col("n").between(2, 8)).withColumn("mean", F.when(F.col("ok"), mean))
    spread = F.sqrt(F.aggregate(F.transform("gaps", lambda g: (g - F.col("mean")) * (g - F.col("mean"))), F.lit(0.0), lambda a, b: a + b) / F.size("gaps"))
    return h.select("capture_id", F.when(F.col("ok"), F.col("n").cast("long")).alias("n_tones"), F.when(F.col("ok"), F.col("mean") * (F.col("n") - 1) / 2).alias("deviation"), F.col("mean").alias("spacing"), F.when(F.col("ok"), clip(0.9 - 2 * spread / F.col("mean"), 0.2, 0.9)).otherwise(0.0).alias("confidence"))


def _filtered(own: DataFrame, taps_of) -> DataFrame:
    def part(k):
        def each(i, q):
            x = (i, q)[k]
            taps = taps_of(len(x))
            return np.convolve(x, taps)[len(taps) // 2 : len(taps) // 2 + len(x)] if len(x) else x

        return each

    i = _arrays(own, "capture_id long, q array<double>", ["i"], lambda x: part(0)(x, x)).select("capture_id", "q", F.col("v").alias("i"))
    return _arrays(i, "capture_id long, i array<double>", ["q"], lambda x: part(1)(x, x)).select("capture_id", "i", F.col("v").alias("q"))


def low_pass_taps(cutoff: float, n: int, taps: int = 101) -> np.ndarray:
    """A Hamming-windowed low-pass of gain 1; the taps shrink to an odd number below n, the length of what it filters."""
    m = max(1, min(taps, n - 1 - n % 2 if n > 2 else 1))
    k = np.arange(m) - m // 2
    h = np.sinc(2 * cutoff * k) * (0.54 + 0.46 * np.cos(2 * np.pi * k / max(m - 1, 1)))
    return h / h.sum()


def low_passed(own: DataFrame, cutoff: float, taps: int = 101) -> DataFrame:
    """Blocks behind a Hamming-windowed low-pass without delay."""
    return _filtered(own, lambda n: low_pass_taps(cutoff, n, taps))


def matched(own: DataFrame, per_symbol: int, rolloff: float = 0.35, span: int = 8) -> DataFrame:
    """Blocks behind a root-raised-cosine filter of unit energy over `span` symbols."""
    t = np.arange(-span * per_symbol // 2, span * per_symbol // 2 + 1) / per_symbol
    b = 4 * rolloff * t
    with np.errstate(divide="ignore", invalid="ignore"):
        h = (np.sin(np.pi * t * (1 - rolloff)) + b * np.cos(np.pi * t * (1 + rolloff))) / (np.pi * t * (1 - b * b))
    h[t == 0] = 1 - rolloff + 4 * rolloff / np.pi
    a = np.pi / (4 * rolloff)
    h[np.isclose(np.abs(b), 1)] = rolloff / math.sqrt(2) * ((1 + 2 / np.pi) * math.sin(a) + (1 - 2 / np.pi) * math.cos(a))
    h /= math.sqrt(h @ h)
    return _filtered(own, lambda n: h)
