"""Weights that follow what was measured, permutation importance, the check of nested reports and metadata documents."""

import json

import numpy as np
from pyspark.sql import functions as F

from waveloom.operators import features, reports, scoring
from waveloom.plans.checked import GOOD


def test_blend_follows_the_measured_weights(spark):
    votes = lambda rows: spark.createDataFrame(rows, "id int, label string, p double")
    feature, window = votes([(1, "a", 0.9), (1, "b", 0.1)]), votes([(1, "a", 0.2), (1, "b", 0.8)])
    snr = spark.createDataFrame([(1, 10.0)], "id int, snr_db double")
    table = lambda a, b: spark.createDataFrame([("feature", "mid", a), ("window", "mid", b), ("feature", "high", 0.1)], "model string, band string, accuracy double")
    top = lambda m: scoring.blend(feature, window, snr, m).select("confidence", "runner_up").first()
    assert abs(top(None)["confidence"] - 0.55) < 1e-9  # the prior: one half each
    assert top(table(0.9, 0.1))["runner_up"] == "b" and top(table(0.1, 0.9))["runner_up"] == "a"
    assert top(table(0.0, 0.0)) == top(None)
    weights = {r["band"]: (round(r["wf"], 6), r["prior"]) for r in scoring.band_weights(table(0.6, 0.2), spark).collect()}
    assert weights == {"low": (0.35, True), "mid": (0.75, False), "high": (0.65, True)}


def test_importance_and_accuracy_kept_with_a_model(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(240):
        x = rng.normal(size=len(features.FEATURES))
        rows.append((k, "yes" if x[3] + 0.3 * x[10] > 0 else "no", *map(float, x)))
    table = spark.createDataFrame(rows, "capture_id long, label string, " + ", ".join(f"{c} double" for c in features.FEATURES)).cache()
    model = features.fitted(table.where("capture_id < 160"), rounds=6, depth=3)
    held = table.where("capture_id >= 160")
    got = features.permutation_importance(model, held, repeats=2, seed=3).collect()
    assert got[0]["feature"] == features.FEATURES[3] and got[0]["importance"] > 0.2 and len(got) == len(features.FEATURES)
    assert all(abs(r["importance"]) < 0.15 for r in got if r["feature"] not in (features.FEATURES[3], features.FEATURES[10]))
    dealt = features.permuted(held, "capture_id", [features.FEATURES[0]], 1, 3).collect()
    own = {r["capture_id"]: r[features.FEATURES[0]] for r in held.collect()}
    assert sorted(r["value"] for r in dealt) == sorted(own.values()) and {r["capture_id"] for r in dealt} == set(own) and any(own[r["capture_id"]] != r["value"] for r in dealt)
    told = features.classified(model, held).join(held.select("capture_id", F.col("label").alias("truth")), "capture_id").select(F.lit("feature").alias("model"), "truth", F.col("label").alias("predicted"), (F.col("capture_id") % 30).cast("double").alias("snr_db"))
    accuracy = scoring.measured_accuracy(told)
    features.saved(model, str(tmp_path / "m"), accuracy)
    assert sorted(map(tuple, features.kept_accuracy(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, accuracy.collect()))
    assert features.classified(features.loaded(spark, str(tmp_path / "m")), held).count() == 80
    table.unpersist()


def test_numbers_in_order(spark):
    rows = spark.createDataFrame([(int(k),) for k in np.random.default_rng(1).permutation(500)], "k int").repartition(7)
    got = features.numbered(rows, F.col("k")).collect()
    assert len(got) == 500 and all(r["k"] == r["_at"] for r in got)


def faults(spark, *texts):
    return {(r["capture_id"], r["place"], r["fault"]) for r in reports.report_faults(spark.createDataFrame(list(enumerate(texts)), "capture_id int, report string")).collect()}


def test_report_faults(spark):
    good = GOOD % ("1e6", "12.5", "0.5", '["a","b"]', "", "")
    assert not faults(spark, good, good.replace('"symbol_rate_hz":{"value":9.5,"confidence":0.5,"method":"m"}', '"symbol_rate_hz":null'), good.replace("12.5", '"< 0 dB"'), GOOD % ("1", "null", "0", '["a","b","c"]', '"w"', ""))
    two = json.loads(good)
    two["detections"].append({**two["detections"][0], "duration_s": None, "extra": 3, "modulation": {**two["detections"][0]["modulation"], "label": "", "evidence": "x"}})
    del two["file"]["bytes"]
    assert faults(spark, json.dumps(two)) == {
        (0, "report.detections[1].duration_s", "expected a number, got null"),
        (0, "report.detections[1].extra", "expected an object, got number"),
        (0, "report.detections[1].modulation.label", "expected a text"),
        (0, "report.detections[1].modulation.evidence", "expected a list, got text"),
        (0, "report.file", "missing bytes"),
    }
    assert faults(spark, "[]", "3", "", None) == {(0, "report", "expected an object, got list"), (1, "report", "expected an object, got number"), (2, "report", "not JSON"), (3, "report", "not JSON")}


def test_meta_documents(spark):
    captures = spark.createDataFrame([(1, 1000.0, 5e6, "2024-01-01T00:00:00Z"), (2, 500.0, None, None)], "capture_id int, sample_rate double, center_freq double, start_time string")
    found = spark.createDataFrame([(1, 0.5, 1.0, -50.0, 50.0, "fm"), (1, 0.1, 0.1, 10.0, 20.0, "am")], "capture_id int, t0 double, t1 double, f_lo double, f_hi double, label string")
    got = {r["capture_id"]: json.loads(r["meta"]) for r in reports.meta_documents(found, captures).collect()}
    assert got[1]["global"] == {"core:datatype": "cf32_le", "core:version": "1.0.0", "core:num_channels": 1, "core:sample_rate": 1000.0}
    assert got[1]["captures"] == [{"core:sample_start": 0, "core:frequency": 5e6, "core:datetime": "2024-01-01T00:00:00Z"}]
    assert [(a["core:sample_start"], a["core:sample_count"], a["core:freq_lower_edge"], a["core:label"]) for a in got[1]["annotations"]] == [(100, 1, 5000010.0, "am"), (500, 500, 4999950.0, "fm")]
    assert got[2]["annotations"] == []
