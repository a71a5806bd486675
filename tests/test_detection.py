"""Detection, evaluation, example sets, generators and files against plain numpy."""

import io
import wave

import numpy as np
import pytest

from waveloom.operators import detection, features, generators, reports
from waveloom.sources import examples


def value(df):
    rows = df.orderBy("capture_id", "n").collect()
    return np.array([complex(r["i"], r["q"]) for r in rows])


def test_generators(spark):
    n = np.arange(100)
    assert np.allclose(value(generators.tone(spark, 30.0, 1000.0, 100)), np.exp(2j * np.pi * 0.03 * n))
    t = np.arange(200) / 1000
    assert np.allclose(value(generators.chirp(spark, -50.0, 150.0, 0.2, 1000.0)), np.exp(2j * np.pi * (-50 * t + 500 * t**2)))
    z = value(generators.fsk(spark, 4, 90.0, 10, 1000.0, 60))
    f = np.angle(z[1:] * z[:-1].conj()) / 2 / np.pi * 1000
    assert set(np.round(f).astype(int)) == {-90, -30, 30, 90} and np.allclose(np.abs(z), 1)
    z = value(generators.psk(spark, 4, 8, 200))
    taps = np.array(generators.pulse(0.35, 8, 8))
    points = np.convolve(z, taps, "same")[::8][8:-8]  # the matched filter makes the pair Nyquist
    assert np.allclose(np.abs(points), 1, atol=0.05) and np.allclose(np.abs((points**4).mean()), 1, atol=0.1)
    z = value(generators.ofdm(spark, 64, 16, 20)).reshape(20, 80)
    assert np.allclose(z[:, :16], z[:, 64:]) and np.allclose(np.abs(np.fft.fft(z[:, 16:], axis=1)), 8)
    clean = generators.tone(spark, 30.0, 1000.0, 20_000)
    noise = value(generators.with_noise(clean, 10.0)) - value(clean)
    assert np.mean(np.abs(noise) ** 2) == pytest.approx(0.1, rel=0.03) and abs(noise.mean()) < 0.01
    assert np.allclose(noise, value(generators.with_noise(clean, 10.0)) - value(clean))  # reruns agree


def test_example_sets(spark, tmp_path):
    rows = [(m, float(s), k, [float(k)] * 8, [0.5] * 8) for m in ("am", "fm", "qpsk") for s in (-5, 0, 5) for k in range(20)]
    table = spark.createDataFrame(rows, "modulation string, snr_db double, example long, i array<double>, q array<double>")
    path = str(tmp_path / "set")
    examples.convert(table, path, 8)
    examples.convert(table.limit(9).where("false").union(table.where("snr_db = 0")), path)  # what is there stays
    assert examples.load(spark, path).count() == len(rows)
    one = examples.load(spark, path, "fm", 5.0)
    assert one.count() == 20 and {(r["modulation"], r["snr_db"]) for r in one.collect()} == {("fm", 5.0)}
    assert one.select(examples.complex_iq().alias("z")).first()["z"][0]["q"] == 0.5
    with pytest.raises(ValueError, match="gaps"):
        examples.convert(table.where("modulation <> 'am' or snr_db > 0"), str(tmp_path / "other"))
    with pytest.raises(ValueError, match="samples"):
        examples.convert(table, str(tmp_path / "other"), 9)
    keyed = table.selectExpr("*", "concat(modulation, snr_db, ':', example) as id")
    parts = examples.split(keyed, "id", "modulation", "snr_db")
    assert parts.count() == len(rows) == parts.select("id").distinct().count()  # complete and disjoint
    assert {(r["split"], r["count"]) for r in parts.groupBy("modulation", "snr_db", "split").count().collect()} == {("train", 14), ("validation", 3), ("test", 3)}


def test_box_snr_of_a_known_ratio(spark):
    """Chi-squared noise at unit power in 64 bins and a box of bins 20 to 29 with nine times as much on top."""
    rng = np.random.default_rng(2)
    p = rng.exponential(size=(64, 400))
    p[20:30, 100:300] += 9 * rng.exponential(size=(10, 200))
    cells = spark.createDataFrame([(0, f, t, float(10 * np.log10(p[f, t]))) for f in range(64) for t in range(400)], "capture_id long, f long, t long, s_db double")
    boxes = spark.createDataFrame([(0, 1, 20, 29, 100, 299), (0, 2, 40, 44, 0, 399), (0, 3, 0, 63, 0, 399)], "capture_id long, id long, f0 long, f1 long, t0 long, t1 long")
    got = {r["id"]: r for r in detection.box_snr(boxes, cells).collect()}
    assert got[1]["snr_db"] == pytest.approx(10 * np.log10(9), abs=0.3) and not got[1]["below_floor"]
    assert got[1]["power_dbfs"] == pytest.approx(20, abs=0.3) and got[1]["confidence"] == pytest.approx(0.35 + 0.055 * got[1]["snr_db"])
    assert got[2]["snr_db"] is None or got[2]["snr_db"] < -8
    assert got[3]["snr_db"] is None and got[3]["confidence"] == 0


def test_robust_line_leaves_outliers_out(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(x), 3.0 * x + 2 + float(rng.normal()) + (12.0 if x % 25 == 3 else 0.0)) for x in range(100)] + [("b", float(x), 1.0 * x) for x in range(5)]
    got = {r["k"]: r for r in detection.robust_line(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y").collect()}
    assert got["a"]["slope"] == pytest.approx(3, abs=0.02) and got["a"]["r2"] > 0.999 and 85 <= got["a"]["n"] <= 96
    assert got["b"]["slope"] == pytest.approx(1) and got["b"]["n"] == 5


def test_windows_keep_tails_and_pad(spark):
    own = spark.createDataFrame([(0, [1.0] * 5, [0.0] * 5), (1, [float(k) for k in range(20)], [0.0] * 20), (2, [], [])], "capture_id long, i array<double>, q array<double>")
    got = {(r["capture_id"], r["w"]): (r["first"], r["i"]) for r in detection.padded_windows(own, 8).collect()}
    assert got == {(0, 0): (0, [1.0] * 5 + [0.0] * 3)} | {(1, w): (s, [float(k) for k in range(s, s + 8)]) for w, s in enumerate((0, 4, 8, 12))}


def test_files(spark, tmp_path):
    sound = spark.createDataFrame([(1, [0.0, 1.0, -2.0, 0.5])], "capture_id long, audio array<double>")
    with wave.open(io.BytesIO(bytes(features.wav_bytes(sound, 8000).first()["wav"]))) as w:
        assert w.getparams()[:4] == (1, 2, 8000, 4) and np.frombuffer(w.readframes(4), "<i2").tolist() == [0, 32767, -32767, 16384]
    found = spark.createDataFrame([(1, 0.5, 1.0, 2.0, 3.0, ["a", "b"])], "capture_id long, t0 double, t1 double, f_lo double, f_hi double, evidence array<string>")
    reports.write_all(found, str(tmp_path / "out"), 10.0)
    assert spark.read.json(str(tmp_path / "out/annotations")).first()["sample_start"] == 5
    assert '"id":1' in spark.read.json(str(tmp_path / "out/reports")).first()["report"]
    assert spark.read.option("header", True).csv(str(tmp_path / "out/detections")).columns == ["capture_id", "t0", "t1", "f_lo", "f_hi"]


def test_saved_models(spark, tmp_path, monkeypatch):
    rows = [(k, "x" if k % 2 else "y", *[float((k % 2) * 3 + (k * j) % 5) for j in range(len(features.FEATURES))]) for k in range(40)]
    table = spark.createDataFrame(rows, ["capture_id", "label", *features.FEATURES])
    model = features.fitted(table, rounds=2, depth=2)
    features.saved(model, str(tmp_path / "m"))
    again = features.loaded(spark, str(tmp_path / "m"))
    assert {tuple(r) for r in features.classified(again, table).collect()} == {tuple(r) for r in features.classified(model, table).collect()}
    monkeypatch.setattr(features, "FEATURES", features.FEATURES[::-1])
    with pytest.raises(ValueError):
        features.loaded(spark, str(tmp_path / "m"))
