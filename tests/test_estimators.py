"""Estimators on signals of known truth, and against plain numpy."""

import math

import numpy as np
import pytest

from waveloom.operators import estimators as est


def captures(spark, **signals):
    rows = [(k, [float(v) for v in z.real], [float(v) for v in z.imag]) for k, z in enumerate(signals.values())]
    return spark.createDataFrame(rows, "capture_id long, i array<double>, q array<double>"), list(signals)


def by_name(df, names):
    return {names[r["capture_id"]]: r for r in df.collect()}


def tone(n, freq):
    return np.exp(2j * np.pi * freq * np.arange(n))


def pulses(n, per, seed=1):
    rng = np.random.default_rng(seed)
    symbols = np.exp(1j * np.pi / 2 * rng.integers(0, 4, -(-n // per)))
    x = np.zeros(len(symbols) * per, complex)
    x[::per] = symbols
    return np.convolve(x, np.hanning(2 * per + 1)[1:-1])[:n] + 0.01 * rng.standard_normal(n)


def test_welch_equals_numpy(spark):
    rng = np.random.default_rng(3)
    z = rng.standard_normal(200) + 1j * rng.standard_normal(200)
    own, _ = captures(spark, z=z)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
    want = np.mean([np.abs(np.fft.fftshift(np.fft.fft(z[s : s + 32] * w))) ** 2 / (w @ w) for s in range(0, 200 - 31, 16)], axis=0)
    got = [r["p"] for r in est.welch(own, 32).orderBy("f").collect()]
    assert got == pytest.approx(list(want))


def test_center_and_width(spark):
    rng = np.random.default_rng(4)
    noise = 0.01 * (rng.standard_normal(2048) + 1j * rng.standard_normal(2048))
    own, names = captures(spark, one=tone(2048, 0.137) + noise, two=tone(2048, -0.25) + tone(2048, 0.25) + noise)
    psd = est.welch(own, 128)
    got = by_name(est.center_frequency(psd, 128), names)
    assert abs(got["one"]["peak"] - 0.137) < 1 / 256 and got["one"]["confidence"] in (0.9, 0.5, 0.3)
    assert abs(got["two"]["centroid"]) < 0.01 and got["two"]["humps"] >= 2
    widths = by_name(est.bandwidths(psd, 128), names)
    assert widths["one"]["obw"] < 0.05 and 0.4 < widths["two"]["obw"] < 0.6


@pytest.mark.parametrize(("heights", "n"), [([0, 10, 0], 1), ([10, 0, 10], 0), ([0, 10, 5, 10, 0], 1), ([0, 10, 3, 10, 0], 2), ([0.0], 0)])
def test_humps(spark, heights, n):
    row = spark.createDataFrame([([float(h) for h in heights],)], "h array<double>")
    assert row.select(est.humps(row["h"]).alias("n")).first()["n"] == n


def test_line_and_lag_rates(spark):
    keyed = tone(2000, 0.1) * (1 + 0.8 * np.sign(np.sin(2 * np.pi * np.arange(2000) / 50)))
    own, names = captures(spark, qpsk=pulses(4000, 10), keyed=keyed, flat=tone(500, 0.1))
    line = by_name(est.line_rate(est.lines(est.with_series(own), "power")), names)
    assert line["qpsk"]["rate"] == pytest.approx(0.1, rel=0.02)
    assert "flat" not in line  # without variation there is no line
    assert by_name(est.envelope_lag_rate(own), names)["keyed"]["rate"] == pytest.approx(1 / 50, rel=0.02)


def test_cyclic_prefix(spark):
    rng = np.random.default_rng(5)
    body = [np.fft.ifft(np.exp(1j * np.pi / 2 * rng.integers(0, 4, 64))) for _ in range(60)]
    own, names = captures(spark, ofdm=np.concatenate([np.r_[b[-16:], b] for b in body]), noise=rng.standard_normal(2000) + 1j * rng.standard_normal(2000), short=tone(100, 0.1))
    got = by_name(est.cyclic_prefix(own), names)
    assert got["ofdm"]["useful_length"] == 64 and got["ofdm"]["cp_length"] == pytest.approx(16, rel=0.25)
    assert got["noise"]["useful_length"] is None and "short" not in got


def test_sweep_and_tones(spark):
    n = np.arange(4096)
    rng = np.random.default_rng(6)
    fsk = np.exp(2j * np.pi * np.cumsum(np.repeat(rng.choice([-0.15, -0.05, 0.05, 0.15], 64), 64)))
    own, names = captures(spark, chirp=np.exp(2j * np.pi * (-0.3 * n + 0.5 * 0.0001 * n * n)), fsk=fsk + 0.01 * rng.standard_normal(4096))
    got = by_name(est.sweep(est.frame_power(own, 64, 32), 64, 32), names)
    assert got["chirp"]["rate"] == pytest.approx(0.0001, rel=0.05) and not got["chirp"]["nonlinear"]
    assert got["fsk"]["rate"] is None
    t = by_name(est.tones(own), names)["fsk"]
    assert t["n_tones"] == 4 and t["deviation"] == pytest.approx(0.15, rel=0.05) and t["spacing"] == pytest.approx(0.1, rel=0.05)


def test_filters(spark):
    own, names = captures(spark, low=tone(600, 0.02), high=tone(600, 0.4), none=np.zeros(0, complex))
    power = {k: np.mean(np.square(r["i"]) + np.square(r["q"])) if r["i"] else None for k, r in by_name(est.low_passed(own, 0.1), names).items()}
    assert power["low"] == pytest.approx(1, abs=0.15) and power["high"] < 0.01 and power["none"] is None
    assert math.sqrt(sum(v * v for v in by_name(est.matched(captures(spark, d=np.r_[np.zeros(40), 1, np.zeros(40)].astype(complex))[0], 4), ["d"])["d"]["i"])) == pytest.approx(1)
