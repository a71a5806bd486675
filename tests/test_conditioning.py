"""Conditioning over many blocks, prominences and symbol-spaced samples against plain numpy."""

import numpy as np
import pytest

from waveloom.operators import conditioning, estimators, samples, symbols


def rows(spark, captures):
    data = [(c, n, float(v.real), float(v.imag)) for c, x in captures.items() for n, v in enumerate(x)]
    return spark.createDataFrame(data, "capture_id long, n long, i double, q double").repartition(6)


def recurrence(x, a):
    y, last, before = np.empty(len(x), complex), 0, 0
    for n, v in enumerate(x):
        last = v - before + a * last
        y[n], before = last, v
    return y


def series(df):
    out = {}
    for r in df.orderBy("capture_id", "n").collect():
        out.setdefault(r["capture_id"], []).append(complex(r["i"], r["q"]))
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("pole,length,fan", [(0.9995, None, 4096), (0.9995, 64, 3), (0.5, None, 4096), (0.0, None, 2), (0.999, 7, 4)])
def test_dc_block(spark, pole, length, fan):
    rng = np.random.default_rng(2)
    captures = {k: rng.normal(size=n) + 1j * rng.normal(size=n) + 3 for k, n in enumerate((1, 6, 7, 700, 5000))}
    got = series(conditioning.dc_blocked(rows(spark, captures), pole, length, fan))
    for k, x in captures.items():
        assert np.allclose(got[k], recurrence(x, pole), atol=1e-9)


def test_conditioned(spark):
    rng = np.random.default_rng(3)
    n = 3000
    drift = np.r_[np.ones(1000), -np.ones(2000) / 2] * 5  # no mean over all, a spike over the first thousand
    captures = {1: rng.normal(size=n) + 2 + 1j * rng.normal(size=n), 2: drift + 0.1 * (rng.normal(size=n) + 1j * rng.normal(size=n)), 3: np.full(40, 2.0 + 1j)}
    got = conditioning.conditioned(rows(spark, captures), probe=1000)
    flags = {r["capture_id"]: (r["notched"], r["scale"]) for r in got.select("capture_id", "notched", "scale").distinct().collect()}
    assert flags[1][0] is False and flags[2][0] is True and flags[3] == (False, 0.0)
    out = series(got)
    x = captures[1] - captures[1].mean()
    assert np.allclose(out[1], x / np.sqrt(np.mean(np.abs(x) ** 2))) and np.allclose(out[3], 0)
    y = recurrence(captures[2] - captures[2].mean(), 0.9995)
    assert np.allclose(out[2], y / np.sqrt(np.mean(np.abs(y) ** 2)), atol=1e-9)
    assert conditioning.conditioned(rows(spark, captures).limit(0)).count() == 0


def brute(x):
    out = []
    for i in range(1, len(x) - 1):
        if x[i] == x[i - 1]:
            continue
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if j == len(x) - 1 or x[i - 1] > x[i] or x[j + 1] > x[i]:
            continue
        left, right = i, j
        while left > 0 and x[left - 1] <= x[i]:
            left -= 1
        while right < len(x) - 1 and x[right + 1] <= x[i]:
            right += 1
        out.append(((i + j) // 2, x[i], x[i] - max(min(x[left : i + 1]), min(x[i : right + 1]))))
    return out


def test_prominences(spark):
    rng = np.random.default_rng(5)
    arrays = {k: rng.integers(0, 6, rng.integers(0, 40)).astype(float).tolist() for k in range(200)} | {900: [], 901: [1.0, 2.0], 902: [0.0, 1.0, 1.0, 1.0, 0.0], 903: None}
    table = spark.createDataFrame(list(arrays.items()), "capture_id long, d array<double>")
    got = {}
    for r in estimators.peaks(table).orderBy("capture_id", "position").collect():
        got.setdefault(r["capture_id"], []).append((r["position"], r["height"], r["prominence"]))
    assert got == {k: brute(v) for k, v in arrays.items() if v and brute(v)}
    assert {(r["capture_id"], r["position"]) for r in estimators.peaks(table, 3.0).collect()} == {(k, p) for k, v in got.items() for p, _, s in v if s >= 3}


@pytest.mark.parametrize("order,theory", [(2, (2.0, 2.0)), (4, (1.0, 1.0)), (8, (0.0, 1.0))])
@pytest.mark.parametrize("each", [5.0, 7.3, 12.84])
def test_symbols_of_a_fractional_rate(spark, order, theory, each):
    rng = np.random.default_rng(order)
    points = np.exp(2j * np.pi * rng.integers(0, order, 700) / order)
    fine = 100  # the pulse train on a fine grid, then its samples `each` apart from one symbol to the next
    pulse = symbols.root_raised_cosine(fine)
    up = np.zeros(len(points) * fine, complex)
    up[::fine] = points
    wave = np.convolve(up, pulse)[len(pulse) // 2 :][: len(up)]
    t = np.arange(int(len(points) * each)) / each * fine
    x = np.interp(t, np.arange(len(wave)), wave.real) + 1j * np.interp(t, np.arange(len(wave)), wave.imag)
    x = x * np.exp(2j * np.pi * 0.031 * np.arange(len(x)))
    own = spark.createDataFrame([(1, x.real.tolist(), x.imag.tolist(), 1 / each, 0.031), (2, [1.0] * 9, [0.0] * 9, 0.2, None), (3, [1.0] * 90, [0.0] * 90, None, 0.0)], "capture_id long, i array<double>, q array<double>, rate double, centre double")
    got = symbols.symbol_samples(own)
    assert {r["capture_id"] for r in got.select("capture_id").distinct().collect()} == {1}
    inner = got.where("n >= 20 and n < 660")
    ratios = samples.cumulants(inner).first()
    assert abs(ratios["c40_ratio"] - theory[0]) < 0.06 and abs(ratios["c42_ratio"] - theory[1]) < 0.06
    label = samples.nearest_constellation(samples.cumulants(inner)).first()["label"]
    assert label == {2: "bpsk", 4: "qpsk", 8: "8psk"}[order]
    z = series(inner)[1]
    assert np.abs(np.abs(z) / np.abs(z).mean() - 1).max() < 0.12 and len(z) == 640


def test_resampling_keeps_a_tone():
    n = np.arange(4000)
    for every in (0.37, 1.0, 1.7, 3.1):
        y = symbols.resampled(np.exp(2j * np.pi * 0.05 * n), every)
        m = np.arange(len(y))
        inner = slice(int(60 / min(every, 1)), -int(60 / min(every, 1)))
        assert np.abs(y - np.exp(2j * np.pi * 0.05 * every * m))[inner].max() < 0.01
