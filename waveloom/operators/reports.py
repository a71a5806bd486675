"""Reports: nested rows per capture, their check, annotations and flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0"


def report_rows(detections: DataFrame) -> DataFrame:
    """(capture_id, report): JSON per capture over (capture_id, t0, f_lo, ...), numbered by time and frequency, nulls kept."""
    fields = [c for c in detections.columns if c != "capture_id"]
    ordered = F.sort_array(F.collect_list(F.struct("t0", "f_lo", *[c for c in fields if c not in ("t0", "f_lo")])))
    own = detections.groupBy("capture_id").agg(ordered.alias("d"))
    numbered = F.transform("d", lambda d, k: F.struct((k + 1).alias("id"), *[d[c].alias(c) for c in fields]))
    return own.select("capture_id", F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("capture_id"), numbered.alias("detections")), {"ignoreNullFields": "false"}).alias("report"))


def faults(detections: DataFrame) -> DataFrame:
    """Rows that break the contract: confidences outside 0 to 1, numbers that aren't finite, fewer than two sentences of evidence."""
    bad = F.lit(False)
    for name, kind in detections.dtypes:
        if kind in ("double", "float"):
            bad = bad | F.coalesce(F.isnan(name) | (F.abs(F.col(name)) == float("inf")), F.lit(False))
        if name.endswith("confidence"):
            bad = bad | F.coalesce(~F.col(name).between(0, 1), F.lit(True))
        if name == "evidence":
            bad = bad | (F.size(name) < 2) | (F.size(name) > 5)
    return detections.where(bad)


#: The keys of each object of a report, by path; [] stands for any place of a list.
KEYS = {
    "report": "schema_version file capture noise_floor_dbfs detections warnings runtime_s",
    "report.file": "name sha256 bytes",
    "report.capture": "sample_rate_hz center_freq_hz center_freq_source duration_s dtype dtype_confidence frequencies_are_normalised notes",
    "report.detections[]": "id time_start_s time_stop_s duration_s center_freq_hz center_freq_offset_hz bandwidth_hz snr_db power_dbfs symbol_rate_hz modulation extra",
    "report.detections[].bandwidth_hz": "occupied_99 minus_3db minus_20db",
    "report.detections[].symbol_rate_hz": "value confidence method",
    "report.detections[].modulation": "label confidence runner_up runner_up_confidence votes evidence",
}
#: What stands at a path: numbers, those that may be null, shares of 1, texts that aren't empty, lists, objects and objects that may be null.
NUMBERS = [f"report.{k}" for k in ("runtime_s", "capture.sample_rate_hz")] + [f"report.detections[].{k}" for k in ("time_start_s", "time_stop_s", "duration_s")]
NULLABLE = ["report.noise_floor_dbfs", "report.capture.center_freq_hz"] + [f"report.detections[].{k}" for k in ("center_freq_hz", "center_freq_offset_hz", "power_dbfs", "bandwidth_hz.occupied_99", "bandwidth_hz.minus_3db", "bandwidth_hz.minus_20db", "symbol_rate_hz.value")]
SHARES = [f"report.detections[].{k}.confidence" for k in ("symbol_rate_hz", "modulation")]
TEXTS = ["report.detections[].symbol_rate_hz.method", "report.detections[].modulation.label", "report.warnings[]"]
LISTS = ["report.warnings", "report.detections", "report.detections[].modulation.evidence"]
OBJECTS = ["report", "report.file", "report.capture", "report.detections[]", "report.detections[].bandwidth_hz", "report.detections[].extra"]
MAYBE = ["report.detections[].symbol_rate_hz", "report.detections[].modulation"]
BELOW = "< 0 dB"


def nodes(reports: DataFrame, depth: int = 4) -> DataFrame:
    """(capture_id, path, place, kind, value, keys, size) of every value of reports (capture_id, report), JSON texts, down to `depth` steps.

    place is the path with the numbers of list places, path the same with [] for them; kind is
    object, list, text, number, truth or null, and `not JSON` of a report that can't be read.
    """
    # a level adds the children of what the one before has added: each report is read and parsed once
    out = reports.select("capture_id", F.lit("report").alias("path"), F.lit("report").alias("place"), F.try_parse_json("report").alias("v"), F.lit(True).alias("new"))
    named = "transform(map_entries(try_variant_get(v, '$', 'map<string,variant>')), e -> struct(path || '.' || e.key as path, place || '.' || e.key as place, e.value as v, true as new))"
    listed = "transform(try_variant_get(v, '$', 'array<variant>'), (x, k) -> struct(path || '[]' as path, place || '[' || k || ']' as place, x as v, true as new))"
    for _ in range(depth):
        out = out.select("capture_id", F.expr(f"inline(concat(array(struct(path, place, v, false as new)), coalesce(if(new, coalesce({named}, {listed}), null), array())))"))
    form = F.schema_of_variant("v")
    kind = F.when(F.col("v").isNull(), "not JSON").when(F.is_variant_null("v"), "null").when(form.startswith("OBJECT"), "object").when(form.startswith("ARRAY"), "list").when(form == "STRING", "text").when(form == "BOOLEAN", "truth").otherwise("number")
    text = F.to_json("v")
    return out.select("capture_id", "path", "place", kind.alias("kind"), F.when(form == "STRING", F.try_variant_get("v", "$", "string")).otherwise(text).alias("value"), F.when(form.startswith("OBJECT"), F.json_object_keys(text)).alias("keys"), F.when(form.startswith("ARRAY"), F.json_array_length(text)).alias("size"))


def report_faults(reports: DataFrame) -> DataFrame:
    """(capture_id, place, fault), a row for each fault of reports (capture_id, report): keys that are missing or too many, values of another kind, shares outside 0 to 1, under two sentences of evidence, another version."""
    all_ = nodes(reports)
    keys = F.create_map(*[x for k, v in KEYS.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])
    want = keys[F.col("path")]
    number = F.col("value").cast("double")
    is_in = lambda paths: F.col("path").isin(paths)
    fault = (
        F.when(F.col("kind") == "not JSON", "not JSON")
        .when(is_in(OBJECTS) & (F.col("kind") != "object"), F.concat(F.lit("expected an object, got "), "kind"))
        .when(is_in(MAYBE) & ~F.col("kind").isin("object", "null"), F.concat(F.lit("expected an object or null, got "), "kind"))
        .when(is_in(LISTS) & (F.col("kind") != "list"), F.concat(F.lit("expected a list, got "), "kind"))
        .when(is_in(NUMBERS + SHARES) & (F.col("kind") != "number"), F.concat(F.lit("expected a number, got "), "kind"))
        .when(is_in(NULLABLE) & ~F.col("kind").isin("number", "null"), F.concat(F.lit("expected a number or null, got "), "kind"))
        .when(is_in(SHARES) & ~number.between(0, 1), "outside 0 to 1")
        .when(is_in(TEXTS) & ((F.col("kind") != "text") | (F.col("value") == "")), F.lit("expected a text"))
        .when((F.col("path") == "report.detections[].snr_db") & ~F.col("kind").isin("number", "null") & ~((F.col("kind") == "text") & (F.col("value") == BELOW)), F.lit("expected a number, null or the mark of no signal"))
        .when((F.col("path") == "report.detections[].modulation.evidence") & (F.col("size") < 2), "under two sentences")
        .when((F.col("path") == "report.schema_version") & ~((F.col("kind") == "text") & (F.col("value") == SCHEMA_VERSION)), "another version")
    )
    others = lambda a, b, said: F.when(want.isNotNull() & (F.col("kind") == "object"), F.transform(F.array_except(a, b), lambda k: F.concat(F.lit(f"{said} "), k)))
    none = F.array().cast("array<string>")
    each = F.concat(F.array(fault), *[F.coalesce(others(*x), none) for x in ((want, F.col("keys"), "missing"), (F.col("keys"), want, "unexpected"))])
    return all_.select("capture_id", "place", F.explode(each).alias("fault")).where("fault is not null")


def meta_documents(detections: DataFrame, captures: DataFrame) -> DataFrame:
    """(capture_id, meta): the metadata document of each capture of captures (capture_id, sample_rate, center_freq, start_time), with an annotation for each of its detections (capture_id, t0, t1, f_lo, f_hi, label), in seconds and Hz from the centre."""
    rate, centre = F.col("sample_rate"), F.col("center_freq")
    first = F.round(F.col("t0") * rate).cast("long")
    edge = lambda c: F.when(F.col("f_hi") > F.col("f_lo"), centre + F.col(c))
    note = F.struct(first.alias("core:sample_start"), F.greatest(F.lit(1), F.round((F.col("t1") - F.col("t0")) * rate)).cast("long").alias("core:sample_count"), edge("f_lo").alias("core:freq_lower_edge"), edge("f_hi").alias("core:freq_upper_edge"), F.col("label").alias("core:label"))
    notes = detections.join(captures.select("capture_id", "sample_rate", "center_freq"), "capture_id").groupBy("capture_id").agg(F.sort_array(F.collect_list(note)).alias("annotations"))
    kind = "array<struct<`core:sample_start`:bigint,`core:sample_count`:bigint,`core:freq_lower_edge`:double,`core:freq_upper_edge`:double,`core:label`:string>>"
    head = F.struct(F.lit("cf32_le").alias("core:datatype"), F.lit("1.0.0").alias("core:version"), F.lit(1).alias("core:num_channels"), rate.alias("core:sample_rate"))
    start = F.struct(F.lit(0).alias("core:sample_start"), centre.alias("core:frequency"), F.col("start_time").alias("core:datetime"))
    return captures.join(notes, "capture_id", "left").select("capture_id", F.to_json(F.struct(head.alias("global"), F.array(start).alias("captures"), F.coalesce("annotations", F.array().cast(kind)).alias("annotations"))).alias("meta"))


def annotations(detections: DataFrame, sample_rate: float, center: float | None = None) -> DataFrame:
    """(capture_id, sample_start, sample_count, freq_lower_edge, freq_upper_edge) of detections (t0, t1, f_lo, f_hi)."""
    edge = lambda c: F.when(F.col("f_hi") > F.col("f_lo"), F.lit(center).cast("double") + F.col(c))
    return detections.select("capture_id", F.round(F.col("t0") * sample_rate).cast("long").alias("sample_start"), F.greatest(F.lit(1), F.round((F.col("t1") - F.col("t0")) * sample_rate)).cast("long").alias("sample_count"), edge("f_lo").alias("freq_lower_edge"), edge("f_hi").alias("freq_upper_edge"))


def batch_rows(detections: DataFrame) -> DataFrame:
    """A row per capture over (capture_id, label, snr_db): number, distinct labels, strongest label."""
    best = F.max_by("label", F.struct("snr_db", F.lit(0)))
    return detections.groupBy("capture_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels"), best.alias("strongest"), F.max("snr_db").alias("max_snr_db"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def write_all(detections: DataFrame, path: str, sample_rate: float, center: float | None = None) -> None:
    """Write reports (JSON lines), annotations and the flat rows of all captures below path, each by Spark in parts."""
    report_rows(detections).write.mode("overwrite").json(f"{path}/reports")
    annotations(detections, sample_rate, center).write.mode("overwrite").json(f"{path}/annotations")
    flat = [c for c, k in detections.dtypes if not k.startswith(("array", "struct", "map"))]
    detections.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/detections")
