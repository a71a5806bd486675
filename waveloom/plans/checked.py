"""Queries of measured weights, permutations, and the check of nested reports, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waveloom.functions.session import spread
from waveloom.operators import features, reports, scoring
from waveloom.plans.catalogue import VOTES, _table, query, rounded

# both voters are measured on labelled documents, whose lengths stand for predictions and bands; none for the window voter in the high band
MEASURED = """v AS (SELECT quality AS truth, n_chars, ((n_chars % 25) - 2)::DOUBLE AS snr_db FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL
), m AS (SELECT 'feature' AS model, truth, (n_chars % 3 > 0)::INT AS predicted, snr_db FROM v UNION ALL SELECT 'window', truth, (n_chars % 5 > 0)::INT, snr_db FROM v WHERE snr_db < 15
), acc AS (SELECT model, CASE WHEN snr_db < 5 THEN 'low' WHEN snr_db < 15 THEN 'mid' ELSE 'high' END AS band, avg((truth = predicted)::INT) AS accuracy, count(*) AS n FROM m GROUP BY ALL)"""


def _measured(spark, d):
    own = _table(spark, d, "labels").where("quality is not null").join(_table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("truth"), "n_chars", ((F.col("n_chars") % 25) - 2).cast("double").alias("snr_db"))
    said = lambda name, k: own.select(F.lit(name).alias("model"), "truth", (F.col("n_chars") % k > 0).cast("int").alias("predicted"), "snr_db")
    return scoring.measured_accuracy(said("feature", 3).union(said("window", 5).where("snr_db < 15")))


@query(f"WITH {MEASURED} SELECT model, band, round(accuracy, 6)::DOUBLE AS accuracy, n FROM acc")
def measured_accuracy(spark, d):
    return rounded(_measured(spark, d))


@query(f"""WITH {MEASURED}, {VOTES}, own AS (SELECT band, max(accuracy) FILTER (model = 'feature') AS a, max(accuracy) FILTER (model = 'window') AS b FROM acc GROUP BY band
), weight AS (SELECT x.band, CASE WHEN a + b > 0 THEN a / (a + b) ELSE x.p END AS wf FROM (VALUES ('low', 0.35), ('mid', 0.5), ('high', 0.65)) x(band, p) LEFT JOIN own ON own.band = x.band
), b AS (SELECT id, label, coalesce(pf, 0) AS pf, coalesce(pw, 0) AS pw, CASE WHEN id % 20 < 5 THEN 'low' WHEN id % 20 < 15 THEN 'mid' ELSE 'high' END AS band FROM f FULL JOIN w USING (id, label)),
p AS (SELECT *, (wf * pf + (1 - wf) * pw) / sum(wf * pf + (1 - wf) * pw) OVER (PARTITION BY id) AS p, first_value(label) OVER (PARTITION BY id ORDER BY pf DESC, label) = first_value(label) OVER (PARTITION BY id ORDER BY pw DESC, label) AS agree FROM b JOIN weight USING (band)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(p, 12) DESC, label) AS rank FROM p),
t AS (SELECT id, max(label) FILTER (rank = 1) AS top, max(p) FILTER (rank = 1) AS p, max(label) FILTER (rank = 2) AS second, bool_and(agree) AS agree FROM r GROUP BY id),
s AS (SELECT *, CASE WHEN agree THEN p ELSE least(p, 0.6) END AS sure FROM t)
SELECT id, CASE WHEN sure < 0.45 THEN 'unknown' ELSE top END AS label, round(sure, 6)::DOUBLE AS confidence, CASE WHEN sure < 0.45 THEN top ELSE second END AS runner_up, agree FROM s""")
def measured_blend(spark, d):
    own = _table(spark, d, "events").where("user_id is not null").select(F.col("user_id").alias("id"), F.col("event_type").alias("label"), "event_id")
    share = lambda df: df.groupBy("id", "label").count().select("id", "label", (F.col("count") / F.sum("count").over(Window.partitionBy("id"))).alias("p"))
    snr = own.select("id").distinct().withColumn("snr_db", (F.col("id") % 20).cast("double"))
    return rounded(scoring.blend(share(own), share(own.where("event_id % 3 = 0")), snr, _measured(spark, d)))


@query("""WITH x AS (SELECT p_partkey AS key, c, r, CASE c WHEN 'p_size' THEN p_size ELSE p_retailprice END::DOUBLE AS value FROM part, (VALUES ('p_size'), ('p_retailprice')) a(c), (VALUES (0), (1), (2)) b(r)
), h AS (SELECT *, row_number() OVER (PARTITION BY c, r ORDER BY md5('7:' || c || ':' || r || ':' || key), key) AS rank FROM x), k AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rank FROM part)
SELECT p_partkey, c AS "column", CAST(r AS INTEGER) AS repeat, value FROM h JOIN k USING (rank)""")
def feature_permutation(spark, d):
    return features.permuted(_table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"], 3, 7)


# one whole report for each part, and what breaks it by the part's number
GOOD = '{"schema_version":"1.0","file":{"name":"a","sha256":"b","bytes":1},"capture":{"sample_rate_hz":%s,"center_freq_hz":null,"center_freq_source":null,"duration_s":1.5,"dtype":"int16","dtype_confidence":0.9,"frequencies_are_normalised":false,"notes":[]},"noise_floor_dbfs":-90.5,"detections":[{"id":1,"time_start_s":0,"time_stop_s":1,"duration_s":1,"center_freq_hz":null,"center_freq_offset_hz":1.5,"bandwidth_hz":{"occupied_99":1,"minus_3db":null,"minus_20db":2},"snr_db":%s,"power_dbfs":-3,"symbol_rate_hz":{"value":9.5,"confidence":%s,"method":"m"},"modulation":{"label":"qpsk","confidence":0.5,"runner_up":null,"runner_up_confidence":null,"votes":{},"evidence":%s},"extra":{}}],"warnings":[%s],"runtime_s":1%s}'


@query("""WITH f(k, place, fault) AS (VALUES (1, 'report.capture.sample_rate_hz', 'expected a number, got text'), (2, 'report.detections[0].snr_db', 'expected a number, null or the mark of no signal'), (3, 'report.detections[0].symbol_rate_hz.confidence', 'outside 0 to 1'),
(4, 'report.detections[0].modulation.evidence', 'under two sentences'), (5, 'report.warnings[1]', 'expected a text'), (6, 'report', 'unexpected more'), (7, 'report', 'not JSON'), (8, 'report.detections[0].bandwidth_hz', 'missing minus_3db'), (8, 'report.detections[0].bandwidth_hz', 'unexpected minus_3'), (9, 'report.file', 'expected an object, got list'), (9, 'report.schema_version', 'another version'))
SELECT p_partkey AS capture_id, place, fault FROM part JOIN f ON p_partkey % 11 = k""")
def report_check(spark, d):
    k = F.col("p_partkey") % 11
    by = lambda n, broken, good: F.when(k == n, F.lit(broken)).otherwise(good)
    text = F.format_string(GOOD.replace("%s", "%s"), by(1, '"1e6"', F.col("p_size").cast("string")), by(2, '"low"', F.when(k == 10, '"< 0 dB"').otherwise("12.5")), by(3, "1.5", F.lit("0.75")), by(4, '["one"]', F.lit('["one","two"]')), by(5, '"a",3', F.lit('"a"')), by(6, ',"more":1', F.lit("")))
    text = F.when(k == 7, F.substring(text, 1, 200)).when(k == 8, F.replace(text, F.lit("minus_3db"), F.lit("minus_3"))).when(k == 9, F.replace(F.replace(text, F.lit('{"name":"a","sha256":"b","bytes":1}'), F.lit("[]")), F.lit('"1.0"'), F.lit('"1.1"'))).otherwise(text)
    own = spread(_table(spark, d, "part").select("p_partkey", "p_size"))  # a file of few bytes is one partition, and its reports are many
    return reports.report_faults(own.select(F.col("p_partkey").alias("capture_id"), text.alias("report")))
